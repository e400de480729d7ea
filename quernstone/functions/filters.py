"""Metadata predicates compiled to Column expressions.

A key that a row lacks fails every comparison, "not equal" too; comparisons are
strict about JSON types.  Hence no predicate is ever null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

EQ, NE, GT, LT, IN, TEXT_MATCH = "eq", "ne", "gt", "lt", "in", "text_match"
AND, OR, NOT = "and", "or", "not"


@dataclass(frozen=True)
class MetadataFilter:
    key: str
    value: Any
    op: str = EQ


@dataclass(frozen=True)
class MetadataFilters:
    filters: list[MetadataFilter] = field(default_factory=list)
    condition: str = AND


#: How a key becomes the JSON text of its value: a function of the key.
Resolver = Callable[[str], Column]


def resolver(meta: Column, fixed: tuple[str, ...] = ("url", "file_path", "genre", "timestamp"), more: tuple[str, ...] = ()) -> Resolver:
    """Keys of a metadata struct: the fixed ones as strings, all others from ``extra``.  ``more`` opens number fields too."""

    def json_text(key: str) -> Column:
        if key == "timestamp":
            text = F.date_format(meta["timestamp"], "yyyy-MM-dd'T'HH:mm:ssXXX")
        elif key in fixed:
            text = meta[key]
        elif key in more:
            return meta[key].cast("double").cast("string")
        else:
            return F.element_at(meta["extra"], key)
        return F.regexp_replace(F.to_json(F.struct(text.alias("v"))), r'^\{"v":(.*)\}$', "$1") if key != "timestamp" else F.when(text.isNotNull(), F.concat(F.lit('"'), text, F.lit('"')))

    def guarded(key: str) -> Column:
        value = json_text(key)
        return F.when(value != "{}", value)

    return guarded


def columns(by_key: Mapping[str, Column]) -> Resolver:
    """Keys that are typed columns: predicates on them reach the files' statistics through :func:`compile_filter`'s fast path."""
    return lambda key: by_key.get(key, F.lit(None).cast("string"))


def _kind(v: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(v), r"\(.*", "")


def _same(value: Column, wanted: Any) -> Column:
    mine, other = F.try_parse_json(value), F.parse_json(F.lit(json.dumps(wanted)))
    return (_kind(mine) == _kind(other)) & (F.to_json(mine) == F.to_json(other))


def compile_filter(f: MetadataFilter, resolve: Resolver) -> Column:
    """One predicate over values held as JSON text."""
    value = resolve(f.key)
    if f.op == EQ:
        hit = _same(value, f.value)
    elif f.op == NE:
        hit = ~_same(value, f.value)
    elif f.op in (GT, LT):
        if isinstance(f.value, bool) or not isinstance(f.value, (int, float)):
            return F.lit(False)
        v = F.try_parse_json(value)
        number = F.when(_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, "$", "double"))
        hit = number > float(f.value) if f.op == GT else number < float(f.value)
    elif f.op == IN:
        if not isinstance(f.value, list) or not f.value:
            return F.lit(False)
        hit = reduce(lambda a, b: a | b, [_same(value, v) for v in f.value])
    elif f.op == TEXT_MATCH:
        if not isinstance(f.value, str):
            return F.lit(False)
        v = F.try_parse_json(value)
        hit = F.when(_kind(v) == "STRING", F.contains(F.try_variant_get(v, "$", "string"), F.lit(f.value)))
    else:
        raise ValueError(f"no such operator: {f.op}")
    return F.coalesce(hit & value.isNotNull(), F.lit(False))


def compile_typed(f: MetadataFilter, column: Column) -> Column:
    """One predicate over a typed column, which the scan's statistics can use."""
    if f.op == EQ:
        hit = column == F.lit(f.value)
    elif f.op == NE:
        hit = column != F.lit(f.value)
    elif f.op == GT:
        hit = column > F.lit(f.value)
    elif f.op == LT:
        hit = column < F.lit(f.value)
    elif f.op == IN:
        hit = column.isin(*f.value) if f.value else F.lit(False)
    elif f.op == TEXT_MATCH:
        hit = F.contains(column, F.lit(f.value))
    else:
        raise ValueError(f"no such operator: {f.op}")
    return F.coalesce(hit, F.lit(False))


def combine(predicates: list[Column], condition: str = AND) -> Column:
    """All, any, or not all.  No predicate at all is true under every condition."""
    if not predicates:
        return F.lit(True)
    if condition == AND:
        return reduce(lambda a, b: a & b, predicates)
    if condition == OR:
        return reduce(lambda a, b: a | b, predicates)
    if condition == NOT:
        return ~reduce(lambda a, b: a & b, predicates)
    raise ValueError(f"no such condition: {condition}")


def compile_filters(filters: MetadataFilters, resolve: Resolver) -> Column:
    return combine([compile_filter(f, resolve) for f in filters.filters], filters.condition)


def compile_typed_filters(filters: MetadataFilters, by_key: Mapping[str, Column]) -> Column:
    return combine([compile_typed(f, by_key[f.key]) if f.key in by_key else F.lit(False) for f in filters.filters], filters.condition)


def keywords(text: Column, required: list[str] | None = None, excluded: list[str] | None = None) -> Column:
    """All required and no excluded keywords as substrings, in any case; a text that is gone fails."""
    low = F.lower(text)
    parts = [F.contains(low, F.lit(k.lower())) for k in required or []] + [~F.contains(low, F.lit(k.lower())) for k in excluded or []]
    return F.coalesce(combine([text.isNotNull(), *parts]), F.lit(False))
