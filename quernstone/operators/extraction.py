"""Metadata that a model extracts from nodes.  Replies come in a column, so any model or table of replies serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone import schema as S

EXAM_SCHEMA = '{"question": string, "options": [string], "answer": string, "explanation": string}'


def title_prompt(text: Column) -> Column:
    return F.concat(F.lit("Give a short title for this text. Reply with the title alone.\n\n"), text)


def summary_prompt(text: Column) -> Column:
    return F.concat(F.lit("Summarise this section in a few sentences.\n\n"), text)


def refine_prompt(text: Column, shape: str = EXAM_SCHEMA) -> Column:
    return F.concat(F.lit(f"Rewrite the text in this form, and reply with nothing else: {shape}\n\n"), text)


def strata_prompt(text: Column) -> Column:
    return F.concat(F.lit('Judge the text from 0 to 1. Reply as JSON with the keys "confidence" and "importance".\n\n'), text)


def with_extra(df: DataFrame, key: str, value: Column) -> DataFrame:
    """``metadata.extra[key]`` set to a string where ``value`` isn't null; earlier values of the key go."""
    old = F.coalesce(F.col("metadata.extra"), F.create_map().cast("map<string,string>"))
    # one-element arrays are what to_json quotes; the brackets go
    quoted = F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
    new = F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), quoted))
    return df.withColumn("metadata", F.col("metadata").withField("extra", F.when(value.isNull(), F.col("metadata.extra")).otherwise(new)))


def apply_title(df: DataFrame, reply: str = "reply") -> DataFrame:
    """A failed reply (null) leaves the node as it is."""
    return with_extra(df, "document_title", F.trim(F.col(reply)))


def apply_summary(df: DataFrame, reply: str = "reply") -> DataFrame:
    return with_extra(df, "section_summary", F.trim(F.col(reply)))


def apply_refined(df: DataFrame, reply: str = "reply") -> DataFrame:
    """The trimmed reply as the text of a new node, marked as refined; a failed reply keeps the original."""
    ok = F.col(reply).isNotNull() & (F.col("kind") == S.TEXT)
    extra = F.map_concat(F.map_filter(F.coalesce(F.col("metadata.extra"), F.create_map().cast("map<string,string>")), lambda k, _: k != "is_refined"), F.create_map(F.lit("is_refined"), F.lit("true")))
    out = df.withColumn("text", F.when(ok, F.trim(F.col(reply))).otherwise(F.col("text")))
    out = out.withColumn("metadata", F.col("metadata").withField("extra", F.when(ok, extra).otherwise(F.col("metadata.extra"))))
    return S.with_identity(out)


def strata(reply: Column) -> Column:
    """struct<confidence, importance>: numbers of a JSON reply, each null unless it is a number."""
    v = F.try_parse_json(reply)

    def number(key: str) -> Column:
        part = F.try_variant_get(v, f"$.{key}", "variant")
        kind = F.regexp_replace(F.schema_of_variant(part), r"\(.*", "")
        return F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.try_variant_get(v, f"$.{key}", "double")).alias(key)

    return F.struct(number("confidence"), number("importance"))


def apply_strata(df: DataFrame, reply: str = "reply", now: Column | None = None) -> DataFrame:
    """Confidence and importance where the reply has them, and a timestamp where the node has none."""
    s = strata(F.col(reply))
    meta = F.col("metadata")
    meta = meta.withField("confidence", F.coalesce(s["confidence"].cast("float"), F.col("metadata.confidence"))).withField("importance", F.coalesce(s["importance"].cast("float"), F.col("metadata.importance")))
    return df.withColumn("metadata", meta.withField("timestamp", F.coalesce(F.col("metadata.timestamp"), now if now is not None else F.current_timestamp())))
