"""Incremental ingestion: rows that are already known by id and hash are skipped, the rest go through transformations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Transformation = Callable[[DataFrame], DataFrame]


def in_batch(nodes: DataFrame, keys: tuple[str, ...] = ("node_id", "node_hash"), order: str | None = None) -> DataFrame:
    """One row of each key; the first by ``order``, if given."""
    if order is None:
        return nodes.dropDuplicates(list(keys))
    rest = [c for c in nodes.columns if c not in keys]
    return nodes.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in rest]).select(*nodes.columns)


def unseen(nodes: DataFrame, *known: DataFrame, keys: tuple[str, ...] = ("node_id", "node_hash")) -> DataFrame:
    """Rows whose keys none of the ``known`` tables has: anti-joins, which broadcast where a table is small and sort otherwise."""
    return reduce(lambda df, k: df.join(k.select(*keys).distinct(), list(keys), "left_anti"), known, nodes)


def run(nodes: DataFrame, transformations: list[Transformation], cache: DataFrame | None = None, docstore_hashes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(transformed rows, hashes to commit once those are safely written).

    Nothing is marked as seen here: a run that fails leaves no trace, so its
    rows come again.
    """
    fresh = unseen(in_batch(nodes), *[k for k in (cache, docstore_hashes) if k is not None])
    return reduce(lambda df, t: df.transform(t), transformations, fresh), fresh.select("node_id", "node_hash")


def upsert(existing: DataFrame, new: DataFrame, key: str, allow_update: bool = True, order: str | None = None) -> DataFrame:
    """``existing`` with ``new``: the new row of a key wins, or the old one where updates aren't allowed.

    Of new rows that share a key the last by ``order`` counts.
    """
    if order is not None:
        latest = W.partitionBy(key).orderBy(F.col(order).desc())
        new = new.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    if allow_update:
        return existing.join(new.select(key), key, "left_anti").select(*existing.columns).unionByName(new.select(*existing.columns))
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(*existing.columns))


def lookup(table: DataFrame, ids: DataFrame, key: str, id_key: str | None = None) -> DataFrame:
    """Rows of ``table`` whose key is among ``ids``."""
    return table.join(ids.select(F.col(id_key or key).alias(key)).distinct(), key, "left_semi")


def delete(table: DataFrame, ids: DataFrame, key: str, id_key: str | None = None) -> DataFrame:
    """``table`` without the rows whose key is among ``ids``."""
    return table.join(ids.select(F.col(id_key or key).alias(key)), key, "left_anti")
