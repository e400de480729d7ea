"""Rank fusion of several retrievers' lists.

A list is (query_id, id, score) with more columns as payload; the payload of the
first list and best rank that has a row is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _union(lists: list[DataFrame], id_col: str, query_id: str) -> DataFrame:
    order = W.partitionBy(query_id).orderBy(F.col("score").desc_nulls_last(), id_col)
    ranked = [df.withColumn("_list", F.lit(i)).withColumn("_rank", F.row_number().over(order)) for i, df in enumerate(lists)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def _fuse(rows: DataFrame, score: Column, id_col: str, query_id: str) -> DataFrame:
    payload = [c for c in rows.columns if c not in (id_col, query_id, "score", "_list", "_rank")]
    kept = [F.min_by(F.col(c), F.struct("_list", "_rank")).alias(c) for c in payload]
    return rows.groupBy(query_id, id_col).agg(score.alias("score"), *kept)


def weighted_sum(lists: list[DataFrame], id_col: str = "id", query_id: str = "query_id", weights: list[float] | None = None) -> DataFrame:
    """Sum of scores by id, a null score adding 0; every list weighs 1 unless told otherwise."""
    weights = weights or [1.0] * len(lists)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_list") + 1)
    return _fuse(_union(lists, id_col, query_id), F.sum(F.coalesce("score", F.lit(0.0)) * weight), id_col, query_id)


def reciprocal_rank(lists: list[DataFrame], id_col: str = "id", query_id: str = "query_id", constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) by id, ranks from 1; an id that stands in a list twice counts twice."""
    return _fuse(_union(lists, id_col, query_id), F.sum(1.0 / (constant + F.col("_rank"))), id_col, query_id)


def best_first(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col("score").desc_nulls_last(), id_col)


def hybrid(lists: list[DataFrame], method: str = "rrf", boost=None, **more) -> DataFrame:
    """Fuses the lists and, where ``boost`` is a function of the frame to a factor, scores again."""
    fused = {"rrf": reciprocal_rank, "sum": weighted_sum}[method](lists, **more)
    return fused if boost is None else fused.withColumn("score", F.col("score") * boost(fused))
