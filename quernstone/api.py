"""A small front: ingest files, ask for the nearest pieces, and ask questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import schema as S
from quernstone.config import SplitterConfig, SynthesizerConfig
from quernstone.operators import chunking, ingest, models, search, synthesis
from quernstone.sources import readers
from quernstone.sources.scratch import drop, stored
from quernstone.sources.store import StorageContext

CHUNK_INDEX = "chunks"


class Engine:
    def __init__(self, spark: SparkSession, folder: str, embedder: models.Embedder | None = None, splitter: SplitterConfig = SplitterConfig()):
        self.spark, self.embedder, self.splitter = spark, embedder or models.HashedBag(), splitter
        self.context = StorageContext.open(spark, folder, self.embedder.dimension)

    def ping(self) -> str:
        return "pong"

    def ingest(self, path: str) -> int:
        """Reads a folder's Markdown and text files, splits, embeds and stores what is new; how many documents were."""
        return self.ingest_nodes(readers.directory(self.spark, path, True, ["md", "txt"]))

    def ingest_nodes(self, nodes: DataFrame) -> int:
        fresh, hashes = ingest.run(nodes, [], cache=self.context.cache.read())
        fresh.persist()
        try:
            n = fresh.count()
            if n:
                chunks = stored(chunking.sentence_chunks(fresh, self.splitter).dropDuplicates(["node_id"]), "chunks")
                # a document of one chunk has the chunk's id, and the chunk stays
                whole = fresh.join(chunks.select("node_id"), "node_id", "left_anti").select(*S.NODES.fieldNames())
                self.context.docs.add(whole.unionByName(chunks.drop("n_tokens")))
                pieces = chunks.where("ref_doc_id is not null")
                links = chunking.links(pieces, fresh)
                self.context.edges.replace(links.dropDuplicates(["src_id", "rel", "dst_id"]), ["src_id"])
                self.context.vectors.add(models.embed(pieces.select("node_id", "text"), "text", self.embedder, batch=32))
                members = pieces.select(F.lit(CHUNK_INDEX).alias("index_id"), "node_id", F.col("ref_doc_id").alias("doc_id"))
                index = self.spark.range(1).select(F.lit(CHUNK_INDEX).alias("index_id"), F.lit(None).cast("string").alias("summary"), F.create_map().cast("map<string,string>").alias("extra"))
                self.context.indexes.put(index)
                self.context.indexes.add_members(members)
                self.context.cache.upsert(hashes.dropDuplicates(["node_id"]))
                drop(chunks)
            return n
        finally:
            fresh.unpersist()

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, node_id, text, metadata, score) for queries (query_id long, query)."""
        asked = models.embed(queries.select("query_id", "query"), "query", self.embedder, "query_vec")
        found = search.top_k_batch(self.context.vectors.read().select("node_id", "embedding"), asked, k, "node_id")
        return found.join(self.context.docs.nodes.read().select("node_id", "text", "metadata"), "node_id").select("query_id", "rank", "node_id", "text", "metadata", "score")

    def query(self, text: str, k: int = 3) -> list[tuple[str, float]]:
        """The nearest pieces and their scores, best first."""
        rows = self.retrieve(self._one(text), k).orderBy("rank").collect()
        return [(r["text"], r["score"]) for r in rows]

    def ask(self, text: str, model: models.LanguageModel, k: int = 3, config: SynthesizerConfig = SynthesizerConfig()) -> str:
        return synthesis.query_engine(self._one(text), lambda q: self.retrieve(q, k), [], model, config).first()["answer"]

    def _one(self, text: str) -> DataFrame:
        return self.spark.range(1).select(F.col("id").alias("query_id"), F.lit(text).alias("query"))
