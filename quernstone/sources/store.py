"""Keyed tables on Parquet: a base and the changes since.

A write adds a folder and then flips a pointer file, by Spark's own file system,
so a reader never meets half a table, a failed job leaves the old state in force,
and any store that Spark writes to will do.  An upsert or a deletion adds a
change, whose cost goes with the change; a reader merges the few changes over the
base, and after ``MOST_CHANGES`` of them they are folded into a new base.  One
writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone import schema as S
from quernstone.operators import ingest

_CURRENT = "_CURRENT"
#: Changes that may lie over a base before a write folds them into it.
MOST_CHANGES = 8

DOC_HASHES = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("node_hash", T.StringType())])
REF_DOCS = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("node_ids", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
INDEXES = T.StructType([T.StructField("index_id", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])
MEMBERS = T.StructType([T.StructField("index_id", T.StringType()), T.StructField("node_id", T.StringType()), T.StructField("doc_id", T.StringType())])
VECTORS = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("dim", T.IntegerType())])


class Table:
    """One table below a folder, whose rows are known by ``key``."""

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: T.StructType, key: tuple[str, ...]):
        self.spark, self.path, self.schema, self.key = spark, f"{folder.rstrip('/')}/{name}", schema, list(key)
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def state(self) -> list[str]:
        """Folders of the base and of the changes since, in order; none where nothing was written."""
        pointer = self._at(_CURRENT)
        if not self.fs.exists(pointer):
            return []
        stream = self.fs.open(pointer)
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _empty(self, schema: T.StructType) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

    def read(self) -> DataFrame:
        """The table as it is; an absent one is empty."""
        state = self.state()
        if not state:
            return self._empty(self.schema)
        base = self.spark.read.schema(self.schema).parquet(f"{self.path}/{state[0]}")
        if len(state) == 1:
            return base
        wider, names = T.StructType([*self.schema.fields, T.StructField("_gone", T.BooleanType())]), self.schema.fieldNames()
        changes = None
        for n, name in enumerate(state[1:]):
            one = self.spark.read.schema(wider).parquet(f"{self.path}/{name}").withColumn("_n", F.lit(n))
            changes = one if changes is None else changes.unionByName(one)
        # the last change of a key counts
        last = changes.groupBy(*self.key).agg(F.max_by(F.struct(*names, "_gone"), "_n").alias("r"))
        kept = base.join(changes.select(*self.key).distinct(), self.key, "left_anti").select(*names)
        return kept.unionByName(last.where("not r._gone").select(*[F.col(f"r.{c}").alias(c) for c in names]))

    def write(self, df: DataFrame) -> None:
        """A new base, current once it is whole.  ``df`` may read the table."""
        name = f"v-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).write.parquet(f"{self.path}/{name}")
        self._point([name])

    def _change(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Adds ``rows`` and drops the keys of ``gone``, in one change."""
        state, name = self.state(), f"d-{uuid.uuid4().hex}"
        if not state:
            self.write(self._empty(self.schema))
            state = self.state()
        made = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], F.lit(False).alias("_gone"))
        if gone is not None:
            kept = set(self.key)
            made = made.unionByName(gone.select(*[(F.col(f.name) if f.name in kept else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(True).alias("_gone")))
        made.write.parquet(f"{self.path}/{name}")
        self._point([*state, name])
        if len(state) > MOST_CHANGES:
            self.write(self.read())

    def upsert(self, rows: DataFrame, allow_update: bool = True) -> None:
        """Adds rows by key; one that the table has wins or stays, as ``allow_update`` says.  ``rows`` has each key once."""
        if not allow_update:
            rows = rows.join(self.read().select(*self.key), self.key, "left_anti")
        self._change(rows)

    def replace(self, rows: DataFrame, by: list[str]) -> None:
        """Adds rows, and drops those others that share their values of ``by``."""
        old = self.read().join(rows.select(*by).distinct(), by, "left_semi").select(*self.key)
        self._change(rows, old.join(rows.select(*self.key), self.key, "left_anti"))

    def delete(self, ids: DataFrame, key: str | None = None) -> None:
        """Drops rows of a table of one key by ``ids``; unknown ones are no error."""
        self._change(self._empty(self.schema), ids.select(F.col(key or self.key[0]).alias(self.key[0])).distinct())

    def _point(self, state: list[str]) -> None:
        temporary = self._at(f"{_CURRENT}.{uuid.uuid4().hex}")
        stream = self.fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(temporary, self._at(_CURRENT), options)

    def vacuum(self) -> int:
        """Drops folders that the table no longer has, and says how many; none may be in use."""
        current, dropped = set(self.state()), 0
        if not current:
            return 0
        for status in self.fs.listStatus(self.root):
            name = status.getPath().getName()
            if name[:2] in ("v-", "d-") and name not in current:
                dropped += bool(self.fs.delete(status.getPath(), True))
        return dropped


class DocStore:
    """Nodes, their hashes, and what is known of their source documents."""

    def __init__(self, spark: SparkSession, folder: str):
        self.nodes = Table(spark, folder, "nodes", S.NODES, ("node_id",))
        self.hashes = Table(spark, folder, "doc_hashes", DOC_HASHES, ("node_id",))
        self.refs = Table(spark, folder, "ref_docs", REF_DOCS, ("doc_id",))

    def add(self, nodes: DataFrame, allow_update: bool = True) -> None:
        nodes = nodes.dropDuplicates(["node_id"])
        self.nodes.upsert(nodes.select(*S.NODES.fieldNames()), allow_update)
        self.set_hashes(nodes.select("node_id", "node_hash"), allow_update)

    def get(self, ids: DataFrame, key: str = "node_id") -> DataFrame:
        return ingest.lookup(self.nodes.read(), ids, "node_id", key)

    def exists(self, node_id: str) -> bool:
        return not self.nodes.read().where(F.col("node_id") == node_id).isEmpty()

    def delete(self, ids: DataFrame, key: str = "node_id") -> None:
        """Drops nodes and their hashes; unknown ids are no error, and source documents' records stay."""
        self.nodes.delete(ids, key)
        self.hashes.delete(ids, key)

    def set_hashes(self, hashes: DataFrame, allow_update: bool = True) -> None:
        self.hashes.upsert(hashes.dropDuplicates(["node_id"]), allow_update)

    def set_ref_docs(self, refs: DataFrame) -> None:
        self.refs.upsert(refs)

    def delete_ref_docs(self, ids: DataFrame) -> None:
        self.refs.delete(ids)


def ref_docs(chunks: DataFrame, doc: str = "ref_doc_id", node: str = "node_id") -> DataFrame:
    """(doc_id, node_ids) as the chunks have them."""
    return chunks.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc_id")).agg(F.array_sort(F.collect_list(node)).alias("node_ids"))


class VectorStore:
    """Vectors by node id.  Rows without a vector, or of another dimension than the store's, are left out of writes."""

    def __init__(self, spark: SparkSession, folder: str, dim: int | None = None):
        self.table = Table(spark, folder, "embeddings", VECTORS, ("node_id",))
        found = self.table.read().select("dim").limit(1).collect()
        if found and dim and found[0]["dim"] != dim:
            raise ValueError(f"the store has vectors of {found[0]['dim']}, not of {dim}")
        self.dim = found[0]["dim"] if found else dim

    def add(self, nodes: DataFrame) -> None:
        rows = with_dimension(nodes, self.dim).select("node_id", "embedding", F.size("embedding").alias("dim")).dropDuplicates(["node_id"])
        self.table.upsert(rows)

    def delete(self, ids: DataFrame, key: str = "node_id") -> None:
        self.table.delete(ids, key)

    def read(self) -> DataFrame:
        return self.table.read()


def with_dimension(rows: DataFrame, dim: int | None, vec: str = "embedding") -> DataFrame:
    has = F.col(vec).isNotNull() & (F.size(vec) > 0)
    return rows.where(has if dim is None else has & (F.size(vec) == dim))


class IndexStore:
    """Descriptors of indexes and their members."""

    def __init__(self, spark: SparkSession, folder: str):
        self.indexes, self.members = Table(spark, folder, "indexes", INDEXES, ("index_id",)), Table(spark, folder, "index_members", MEMBERS, ("index_id", "node_id"))

    def put(self, index: DataFrame, members: DataFrame | None = None) -> None:
        """Keeps a descriptor; ``members``, if given, replace those of the index."""
        self.indexes.upsert(index)
        if members is not None:
            self.members.replace(members.select(*MEMBERS.fieldNames()).dropDuplicates(["index_id", "node_id"]), ["index_id"])

    def add_members(self, members: DataFrame) -> None:
        self.members.upsert(members.select(*MEMBERS.fieldNames()).dropDuplicates(["index_id", "node_id"]))

    def get(self, index_id: str) -> dict:
        rows = self.indexes.read().where(F.col("index_id") == index_id).collect()
        if not rows:
            raise KeyError(f"no index {index_id}")
        return rows[0].asDict(True)


@dataclass
class StorageContext:
    """The three stores below one folder, and the cache of what was ingested."""

    docs: DocStore
    vectors: VectorStore
    indexes: IndexStore
    edges: Table
    cache: Table

    @staticmethod
    def open(spark: SparkSession, folder: str, dim: int | None = None) -> StorageContext:
        """What the folder has; absent tables are empty.  A stored dimension wins over none, and must equal one that is given."""
        return StorageContext(DocStore(spark, folder), VectorStore(spark, folder, dim), IndexStore(spark, folder), Table(spark, folder, "edges", S.EDGES, ("src_id", "rel", "dst_id")), Table(spark, folder, "ingest_cache", DOC_HASHES, ("node_id",)))

    def export_documents(self, path: str) -> None:
        """All documents as lines of JSON."""
        self.docs.nodes.read().write.mode("overwrite").json(path)
