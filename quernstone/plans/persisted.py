"""Named queries that go through files and stores: readers, splitters with overlap, tables that are changed and opened again, and kept trees."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import schema as S
from quernstone.config import SplitterConfig, SynthesizerConfig
from quernstone.functions import text as TX
from quernstone.operators import ann, chunking, export, ingest, models, rescoring, search, synthesis, tree
from quernstone.plans.catalog import _COS, _PHRASES, docs, embeddings, query, table
from quernstone.sources import readers, scratch, store
from quernstone.sources.scratch import stored


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex}"


def _files(df: DataFrame, name: str) -> str:
    """Writes a file for each row (name, content) of ``df`` below a new shared folder, and returns the folder."""
    folder = _folder(df.sparkSession, name)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in it:
            for file, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
                at.create_dir(base, recursive=True)
                with at.open_output_stream(f"{base}/{file}") as out:
                    out.write(content.encode())
            yield pa.record_batch([pa.array([b.num_rows])], names=["n"])

    df.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return folder


def _items(spark: SparkSession, sf_dir: str, content: Column, ending: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit(ending)).alias("name"), content.alias("content"))


def _item_id(path: Column) -> Column:
    return F.regexp_extract(path, r"item-([^/]*)\.[^./]+$", 1).alias("item_id")


# ---- readers over files ----


@query("SELECT CAST(item_id AS VARCHAR) AS item_id, sha256(text) AS node_id FROM benchmark")
def directory_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each benchmark item, and one of another ending that the reader must leave."""
    every = _items(spark, sf_dir, F.col("text"), ".txt").unionByName(_items(spark, sf_dir, F.lit("other"), ".log").limit(1))
    nodes = readers.directory(spark, _files(every, "directory"), True, ["md", "txt"])
    return nodes.select(_item_id(F.col("metadata.file_path")), "node_id")


@query("SELECT CAST(item_id AS VARCHAR) AS item_id, unnest([sha256(text), sha256('plain ' || item_id)]) AS node_id, unnest([1, 0]) AS n_extra FROM benchmark")
def json_file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.to_json(F.struct(F.col("text").alias("text"), F.lit(1).alias("k")))
    content = F.concat(F.lit("["), value, F.lit(', "plain '), F.col("item_id").cast("string"), F.lit('"]'))
    nodes = readers.json_file(spark, _files(_items(spark, sf_dir, content, ".json"), "json"))
    return nodes.select(_item_id(F.col("metadata.file_path")), "node_id", F.greatest(F.coalesce(F.size("metadata.extra"), F.lit(0)), F.lit(0)).alias("n_extra"))


@query("SELECT CAST(item_id AS VARCHAR) AS item_id, sha256('QUESTION' || chr(10) || text || chr(10) || 'OPTIONS' || chr(10) || 'yes' || chr(10) || 'no' || chr(10) || 'EXPLANATION' || chr(10) || 'of ' || item_id) AS node_id FROM benchmark")
def exam_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.to_json(F.struct(F.col("text").alias("question"), F.array(F.lit("yes"), F.lit("no")).alias("options"), F.concat(F.lit("of "), F.col("item_id").cast("string")).alias("explanation")))
    return readers.exam(spark, _files(_items(spark, sf_dir, value, ".json"), "exam")).select(_item_id(F.col("metadata.file_path")), "node_id")


# ---- splitting with overlap ----

_N = lambda x: f"CAST(len(regexp_extract_all({x}, '\\w+|[^\\w\\s]')) AS BIGINT)"
_SIZE, _OVERLAP = 128, 16
_PARTS = f"""CASE WHEN {_N("text")} <= room THEN [text]
  WHEN len(list_filter(string_split(text, repeat(chr(10), 3)), lambda x: x <> '')) > 1 THEN list_filter(string_split(text, repeat(chr(10), 3)), lambda x: x <> '')
  WHEN len({_PHRASES}) > 1 THEN {_PHRASES}
  WHEN len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 1 THEN list_filter(string_split(text, ' '), lambda x: x <> '') ELSE [text] END"""
#: Chunks (doc_id, ref, ord, text, n_tokens) of the documents' texts: paragraphs, phrases, words; then greedy filling that carries a tail over.
_CHUNKS = f"""
WITH RECURSIVE l0 AS (SELECT doc_id, sha256(text) AS ref, {_SIZE} - {_N("'file_path: ' || source || chr(10) || 'genre: ' || lang")} AS room, text FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, ref, room, unnest(p) AS text, generate_subscripts(p, 1) AS i1 FROM (SELECT *, {_PARTS} AS p FROM l0)),
l2 AS (SELECT doc_id, ref, room, i1, unnest(p) AS text, generate_subscripts(p, 1) AS i2 FROM (SELECT *, {_PARTS} AS p FROM l1)),
l3 AS (SELECT doc_id, ref, room, i1, i2, unnest(p) AS text, generate_subscripts(p, 1) AS i3 FROM (SELECT *, {_PARTS} AS p FROM l2)),
pieces AS (SELECT doc_id, ref, room, text, row_number() OVER w AS k, sum({_N("text")}) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM l3 WINDOW w AS (PARTITION BY doc_id ORDER BY i1, i2, i3)),
sums AS (SELECT doc_id, any_value(ref) AS ref, any_value(room) AS room, list_prepend(0, list(CAST(upto AS BIGINT) ORDER BY k)) AS s, count(*) AS n FROM pieces GROUP BY doc_id),
fill(doc_id, held, i, a, b) AS (
  SELECT doc_id, 1::BIGINT, 1::BIGINT, NULL::BIGINT, NULL::BIGINT FROM sums
  UNION ALL
  SELECT doc_id, CASE WHEN closes AND i <= n THEN list_min(list_filter(range(held, i + 1), lambda x: s[i] - s[x] <= {_OVERLAP})) ELSE held END, i + 1, CASE WHEN closes THEN held END, CASE WHEN closes THEN i - 1 END
  FROM (SELECT f.*, s, n, i > n OR (i > held AND s[i + 1] - s[held] > room) AS closes FROM fill f JOIN sums USING (doc_id) WHERE i <= n + 1)),
chunks AS (SELECT f.doc_id, ref, CAST(row_number() OVER (PARTITION BY f.doc_id ORDER BY a, b) - 1 AS INTEGER) AS ord, a, b, CAST(s[b + 1] - s[a] AS INTEGER) AS n_tokens FROM fill f JOIN sums USING (doc_id) WHERE a IS NOT NULL),
texts AS (SELECT c.doc_id, c.ref, c.ord, c.n_tokens, string_agg(p.text, '' ORDER BY k) AS text FROM chunks c JOIN pieces p ON p.doc_id = c.doc_id AND p.k BETWEEN a AND b GROUP BY c.doc_id, c.ref, c.ord, c.n_tokens)
"""


def _chunked(rows: DataFrame) -> DataFrame:
    nodes = S.text_nodes(rows, F.col("text"), S.metadata(genre=F.col("lang"), file_path=F.col("source")))
    return chunking.sentence_chunks(nodes, SplitterConfig(chunk_size=_SIZE, chunk_overlap=_OVERLAP))


@query(f"{_CHUNKS} SELECT ref AS ref_doc_id, ord, sha256(text) AS node_id, n_tokens, CAST(length(text) AS INTEGER) AS n_chars FROM texts")
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(docs(spark, sf_dir)).select("ref_doc_id", "ord", "node_id", "n_tokens", F.length("text").alias("n_chars"))


_ONE_EACH = "doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)"


def _one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    return ingest.in_batch(docs(spark, sf_dir).withColumn("_id", S.node_id(F.col("text"))), ("_id",), "doc_id")


@query(f"""{_CHUNKS}, t AS (SELECT ref, ord, sha256(text) AS id FROM texts WHERE {_ONE_EACH}),
e AS (SELECT id AS src_id, ord, ref, lag(id) OVER w AS p, lead(id) OVER w AS n FROM t WINDOW w AS (PARTITION BY ref ORDER BY ord))
SELECT src_id, 'SOURCE' AS rel, ord, ref AS dst_id, 'Document' AS dst_type FROM e UNION ALL SELECT src_id, 'PREVIOUS', ord, p, 'Text' FROM e WHERE p IS NOT NULL UNION ALL SELECT src_id, 'NEXT', ord, n, 'Text' FROM e WHERE n IS NOT NULL""")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.links(_chunked(_one_each(spark, sf_dir))).drop("dst_hash")


_BUFFERED = """WITH r AS (SELECT vec_id // 25 AS run, vec_id % 25 AS pos, list(embedding::DOUBLE[]) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a, list(embedding::DOUBLE[]) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS b FROM embeddings WINDOW w AS (PARTITION BY vec_id // 25 ORDER BY vec_id)),
m AS (SELECT run, pos, list_transform(range(1, 65), lambda i: list_avg(list_transform(a, lambda v: v[i]))) AS x, list_transform(range(1, 65), lambda i: list_avg(list_transform(b, lambda v: v[i]))) AS y FROM r WHERE len(b) > 0)
SELECT run, pos, round(1 - list_cosine_similarity(x, y), 6) AS dist FROM m"""


@query(_BUFFERED)
def semantic_distances_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the means of two vectors on either side."""
    runs = embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 25).cast("long").alias("run"), (F.col("vec_id") % 25).alias("pos"), "embedding")
    return chunking.semantic_distances(runs, "run", "pos", buffer=2).withColumn("dist", F.round("dist", 6))


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'purged' ELSE 'text' END AS kind, sha256(text) AS content_sha FROM documents")
def purged_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of purged nodes, read again from their cached tokens."""
    rows = docs(spark, sf_dir).select("doc_id", "lang", "text", F.lit(S.TEXT).alias("kind"), F.lit(None).cast("binary").alias("bytes"), F.col("doc_id").cast("string").alias("node_id"))
    purged = S.purge(S.cache_tokens(rows, TX.ByteTokenizer()), F.col("lang") == "fr")
    return S.readable(purged, TX.ByteTokenizer(), strict=True).select("doc_id", "kind", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))


@query("SELECT DISTINCT sha256('about ' || lang) AS prompt_hash, 'about ' || lang AS reply FROM documents WHERE lang <> 'en'")
def prompt_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New memo rows: prompts that a memo of the English ones lacks, sent once each."""
    prompts = docs(spark, sf_dir).select("doc_id", F.concat(F.lit("about "), F.col("lang")).alias("prompt"))
    known = models.complete_once(prompts.where("prompt = 'about en'"), "prompt", models.Echo())[1]
    return models.complete_once(prompts, "prompt", models.Echo(), known)[1].select("prompt_hash", "reply")


# ---- stores, changed and opened again ----

_UNIQUE = f"(SELECT sha256(text) AS node_id, * FROM documents WHERE {_ONE_EACH})"


def _nodes(rows: DataFrame, genre: Column | str = "lang") -> DataFrame:
    return S.text_nodes(rows, F.col("text"), S.metadata(genre=F.col(genre) if isinstance(genre, str) else genre))


@query(f"SELECT node_id, CASE WHEN lang = 'de' THEN 'zz' ELSE lang END AS genre, CAST(length(text) AS INTEGER) AS n_chars FROM {_UNIQUE} WHERE lang <> 'es'")
def doc_store_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes added, updated, added where absent, and deleted, and the store opened again."""
    rows, folder = stored(_one_each(spark, sf_dir), "unique"), _folder(spark, "docs")
    docstore = store.StorageContext.open(spark, folder).docs
    docstore.add(_nodes(rows.where("lang <> 'fr'")))
    docstore.add(_nodes(rows.where("lang = 'de'"), F.lit("zz")))
    docstore.add(_nodes(rows), allow_update=False)
    docstore.delete(_nodes(rows.where("lang = 'es'")))
    again = store.StorageContext.open(spark, folder).docs.nodes.read()
    return again.select("node_id", "metadata.genre", F.length("text").alias("n_chars"))


@query(f"SELECT node_id, CASE WHEN lang = 'de' THEN 'changed' ELSE lang END AS node_hash FROM {_UNIQUE} WHERE lang <> 'fr'")
def doc_hash_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, folder = stored(_one_each(spark, sf_dir), "unique"), _folder(spark, "hashes")
    docstore = store.StorageContext.open(spark, folder).docs
    docstore.set_hashes(rows.select(F.col("_id").alias("node_id"), F.col("lang").alias("node_hash")))
    docstore.set_hashes(rows.where("lang = 'de'").select(F.col("_id").alias("node_id"), F.lit("changed").alias("node_hash")))
    docstore.set_hashes(rows.select(F.col("_id").alias("node_id"), F.lit("kept out").alias("node_hash")), allow_update=False)
    docstore.delete(rows.where("lang = 'fr'").select(F.col("_id").alias("node_id")))
    return store.StorageContext.open(spark, folder).docs.hashes.read()


@query("SELECT source AS doc_id, CAST(count(*) AS INTEGER) AS n_nodes FROM documents WHERE source <> 'src1' GROUP BY source")
def ref_doc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "refs")
    docstore = store.StorageContext.open(spark, folder).docs
    refs = store.ref_docs(docs(spark, sf_dir).select(F.col("source").alias("ref_doc_id"), F.col("doc_id").cast("string").alias("node_id")))
    docstore.set_ref_docs(refs.withColumn("metadata", F.create_map().cast("map<string,string>")))
    docstore.delete_ref_docs(spark.createDataFrame([("src1",), ("unknown",)], "doc_id string"))
    return store.StorageContext.open(spark, folder).docs.refs.read().select("doc_id", F.size("node_ids").alias("n_nodes"))


@query("SELECT CAST(vec_id AS VARCHAR) AS node_id, 64 AS dim, round(CASE WHEN label = 4 THEN embedding[64] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings WHERE label <> 3 AND len(embedding) = 64")
def vector_store_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors added, updated and deleted; those of another length are left out."""
    rows, folder = embeddings(spark, sf_dir).select(F.col("vec_id").cast("string").alias("node_id"), F.col("embedding").cast("array<float>").alias("embedding"), "label"), _folder(spark, "vectors")
    vectors = store.VectorStore(spark, folder, 64)
    vectors.add(rows)
    vectors.add(rows.where("label = 4").withColumn("embedding", F.reverse("embedding")))
    vectors.add(rows.limit(3).withColumn("embedding", F.slice("embedding", 1, 5)))
    vectors.delete(rows.where("label = 3"))
    return store.VectorStore(spark, folder).read().select("node_id", "dim", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("SELECT lang AS index_id, CAST(doc_id AS VARCHAR) AS node_id FROM documents WHERE lang <> 'fr' OR doc_id % 2 = 0")
def index_store_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members by language, put, replaced for one language, and added."""
    rows, folder = docs(spark, sf_dir), _folder(spark, "indexes")
    indexes = store.StorageContext.open(spark, folder).indexes
    index = rows.select(F.col("lang").alias("index_id")).distinct().select("index_id", F.lit(None).cast("string").alias("summary"), F.create_map().cast("map<string,string>").alias("extra"))
    members = rows.select(F.col("lang").alias("index_id"), F.col("doc_id").cast("string").alias("node_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("n"))
    indexes.put(index.where("index_id <> 'de'"), members.where("index_id <> 'de'").drop("n"))
    indexes.put(index.where("index_id = 'fr'"), members.where("index_id = 'fr' and n % 4 = 0").drop("n"))
    indexes.put(index)
    indexes.add_members(members.where("index_id = 'de' or (index_id = 'fr' and n % 2 = 0)").drop("n"))
    return store.StorageContext.open(spark, folder).indexes.members.read().select("index_id", "node_id")


@query(f"SELECT node_id, lang AS genre FROM {_UNIQUE}")
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of a store as lines of JSON, read back."""
    folder = _folder(spark, "export")
    context = store.StorageContext.open(spark, folder)
    context.docs.add(_nodes(_one_each(spark, sf_dir)))
    context.export_documents(f"{folder}/lines")
    return spark.read.schema("node_id string, metadata struct<genre:string>").json(f"{folder}/lines").select("node_id", "metadata.genre")


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id FROM conversations UNION ALL SELECT conv_id FROM conversations WHERE role = 'user') GROUP BY conv_id")
def append_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), _folder(spark, "lines")
    export.to_jsonl(rows, path)
    export.to_jsonl(rows.where("role = 'user'"), path, mode="append")
    return export.from_jsonl(spark, path, rows.schema).groupBy("conv_id").agg(F.count("*").alias("n"))


@query("SELECT CAST(conv_id AS VARCHAR) AS query, sha256(string_agg(text, '|' ORDER BY turn)) AS choices_sha, CAST(count(*) FILTER (WHERE role = 'assistant') AS INTEGER) AS n_selected FROM conversations GROUP BY conv_id")
def triplet_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selector triplets of conversations, written as lines of JSON and read back."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("query")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    picked = F.filter(F.transform("r", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    path = _folder(spark, "triplets")
    export.to_jsonl(rows.select("query", F.lit("").alias("parent_context"), F.transform("r", lambda x: x["text"]).alias("choices"), picked.alias("selected_indices")), path)
    back = export.from_jsonl(spark, path)
    return back.select("query", F.sha2(F.array_join("choices", "|").cast("binary"), 256).alias("choices_sha"), F.size("selected_indices").alias("n_selected"))


@query("SELECT DISTINCT sha256(text) AS node_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def ingest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second run still has to do: the first took the labelled documents and committed their hashes to the cache."""
    cache = store.StorageContext.open(spark, _folder(spark, "cache")).cache
    rows = docs(spark, sf_dir)
    _, hashes = ingest.run(_nodes(ingest.lookup(rows, table(spark, sf_dir, "labels"), "doc_id"), F.lit(None).cast("string")), [], cache=cache.read())
    cache.upsert(hashes)
    return ingest.run(_nodes(rows, F.lit(None).cast("string")), [lambda df: df.select("node_id")], cache=cache.read())[0]


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kept index of cells: built of half of the vectors, opened again, added to, and asked for all of them."""
    e, folder = embeddings(spark, sf_dir), _folder(spark, "index")
    ann.VectorIndex.build(e.where("vec_id % 2 = 0"), folder, cells=16)
    index = ann.VectorIndex(spark, folder)
    index.add(e.where("vec_id % 2 = 1"))
    return index.top_k(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), 10, 12, digits=6)


# ---- questions over retrieved texts ----

_ASKED, _CUT = 25, 0.2
_PROMPT = synthesis.ANSWER.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, {_COS.format(a="q.embedding", b="c.embedding")} AS score FROM embeddings q, embeddings c WHERE q.vec_id % {_ASKED} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s),
c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN documents ON doc_id = vec_id WHERE rank <= 3 AND score >= {_CUT} GROUP BY query_id),
a AS (SELECT vec_id AS query_id, context, replace('{_PROMPT}', '{{query}}', 'question ' || vec_id) AS prompt FROM embeddings LEFT JOIN c ON query_id = vec_id WHERE vec_id % {_ASKED} = 0)
SELECT query_id, sha256(CASE WHEN context IS NULL THEN '{synthesis.NOTHING}' ELSE replace(prompt, '{{context}}', context) END) AS answer_sha, CASE WHEN context IS NULL THEN 0 ELSE 1 END AS n_calls FROM a""")
def query_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with vectors: the nearest documents above a cutoff are packed into one prompt, which an echo answers."""
    e = embeddings(spark, sf_dir)
    asked = e.where(F.col("vec_id") % _ASKED == 0).select(F.col("vec_id").alias("query_id"), F.concat(F.lit("question "), F.col("vec_id").cast("string")).alias("query"), F.col("embedding").alias("query_vec"))

    def retrieve(queries: DataFrame) -> DataFrame:
        found = search.top_k_batch(e, queries, 3, digits=6)
        return search.retrieve(found, docs(spark, sf_dir), "vec_id", "doc_id", "text").select("query_id", "rank", "text", "score")

    out = synthesis.query_engine(asked, retrieve, [lambda df: rescoring.similarity_cutoff(df, _CUT)], models.Echo(), SynthesizerConfig(max_tokens=1 << 30))
    return out.select("query_id", F.sha2(F.col("answer").cast("binary"), 256).alias("answer_sha"), "n_calls")


# ---- kept trees ----


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.concat_ws(":", F.lit("doc"), "doc_id").alias("node_id"), tree.group_key(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("ord"), "text")


def _summary(prompt: Column) -> Column:
    return F.concat(F.lit("summary of "), F.length(prompt).cast("string"))


_LEVELS = 8
_TREE = "WITH t0 AS (SELECT source, 'doc:' || doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, doc_id AS ord FROM documents)" + "".join(
    f""",
e{n} AS (SELECT source, pos // 5 AS up, id, ord FROM t{n - 1} WHERE source IN (SELECT source FROM t{n - 1} GROUP BY source HAVING count(*) > 1) OR EXISTS (SELECT 1 FROM t{n - 1} WHERE pos > 0)),
t{n} AS (SELECT source, sha256(string_agg(id, ',' ORDER BY id)) AS id, up AS pos, up AS ord FROM e{n} GROUP BY source, up)"""
    for n in range(1, _LEVELS)
)
_EDGES = " UNION ALL ".join(f"SELECT t.id AS src_id, CAST(e.ord AS BIGINT) AS ord, e.id AS dst_id FROM e{n} e JOIN t{n} t ON t.source = e.source AND t.pos = e.up" for n in range(1, _LEVELS))


@query(f"{_TREE} {_EDGES}")
def hier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge of the tree over the documents of each source, by the ids of its nodes."""
    return tree.build(_leaves(spark, sf_dir), _summary, stored)[1].select("src_id", F.col("ord").cast("long").alias("ord"), "dst_id")


def _last_two(children: DataFrame) -> DataFrame:
    """A selector that takes each parent's two last children."""
    ordered = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("ord", "node_id")))), 1, 2)
    return children.groupBy("query_id", "parent_id").agg(ordered.alias("c")).select("query_id", "parent_id", F.explode("c.node_id").alias("node_id"))


@query("""WITH RECURSIVE n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM documents),
w(source, doc_id, pos, n, level) AS (SELECT source, doc_id, pos, n, 0 FROM n UNION ALL
  SELECT source, doc_id, pos // 5, (n + 4) // 5, level + 1 FROM w WHERE n > 1 AND pos >= least((pos // 5) * 5 + 5, n) - 2)
SELECT source, 'doc:' || doc_id AS node_id FROM w WHERE n = 1""")
def hier_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree kept in the stores, restored by its id, and descended from its roots by the two last children of each node."""
    nodes, edges = tree.build(_leaves(spark, sf_dir), _summary, stored)
    context = store.StorageContext.open(spark, _folder(spark, "tree"))
    name = tree.save(nodes, edges, context)
    roots, kept = tree.restore(context, name)
    kept = stored(kept, "kept-edges")
    start = nodes.join(roots, "node_id").select(F.col("key").alias("query_id"), "node_id")
    return tree.descend(start, kept, _last_two, 12, stored).select(F.col("query_id").alias("source"), "node_id")
