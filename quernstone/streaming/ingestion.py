"""Ingestion of a stream of documents: content-addressed, deduplicated within a watermark, committed by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone import schema as S
from quernstone.operators import ingest
from quernstone.sources.store import StorageContext


def unseen(stream: DataFrame, text: str, event_time: str, lateness: str = "1 hour") -> DataFrame:
    """The stream with ``node_id``; copies that arrive within ``lateness`` of the first are dropped, and state is let go after that."""
    return stream.withColumn("node_id", S.node_id(F.col(text))).withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["node_id"])


def counts(stream: DataFrame, event_time: str, window: str, *by: Column | str, lateness: str = "1 hour") -> DataFrame:
    """Rows by window of event time and ``by``, each window once it is past the watermark."""
    return stream.withWatermark(event_time, lateness).groupBy(F.window(event_time, window), *by).agg(F.count("*").alias("n"))


def start(stream: DataFrame, context: StorageContext, transformations: list[ingest.Transformation], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Runs the ingestion pipeline on each micro-batch of a stream of node rows.

    A micro-batch that comes again after a failure is skipped row by row: its
    nodes are known by id and hash.  Hashes are committed last.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            fresh, hashes = ingest.run(batch, transformations, docstore_hashes=context.docs.hashes.read())
            context.docs.nodes.upsert(fresh.select(*S.NODES.fieldNames()).dropDuplicates(["node_id"]))
            context.docs.set_hashes(hashes)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
