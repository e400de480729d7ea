"""A corpus from raw documents to placed shards, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns
is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import common, decontaminate, mixing, placement, quality, simhash
from quernstone.llm.queries import SHARDS, SLOTS


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this table's labels, does not reject."""
    return quality.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: whole documents, each as often as it was drawn (not at all, once or twice)."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard that each goes to."""
    return placement.place(docs, "doc_id", SHARDS, SLOTS)


STAGES = [("quality", classify), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Classifier, fingerprints and sampled grid are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder, read by the next and then deleted; the last one's input stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        common.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)
