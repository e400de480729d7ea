"""Named queries over the sample tables, one or more for each operator, and SQL that says what they must give.

A query reads whole tables.  Numbers that both sides compute in floating point
are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import schema as S
from quernstone.functions import filters as FL
from quernstone.functions import text as TX
from quernstone.operators import chunking, evaluation, export, extraction, fusion, ingest, models, rescoring, search, synthesis, tree
from quernstone.sources import readers, store
from quernstone.sources.scratch import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One vector by its id; a known zero vector where there is none."""
    row = embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).select(F.col("embedding").cast("array<double>").alias("e")).first()
    return list(row["e"]) if row else [0.0]


# ---- sources ----


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, sha256(CASE WHEN lang IN ('en', 'fr', 'de') THEN text ELSE CAST(to_json({'lang': lang}) AS VARCHAR) END) AS text_sha, CASE WHEN lang = 'de' THEN 0 ELSE 1 END AS n_extra FROM documents")
def json_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    obj = lambda *names: F.to_json(F.struct(*[c.alias(n) for n, c in names]))
    lang, text = ("lang", F.col("lang")), F.col("text")
    bare = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    value = F.when(F.col("lang") == "en", obj(("text", text), lang)).when(F.col("lang") == "fr", obj(("content", text), lang)).when(F.col("lang") == "de", bare).otherwise(obj(lang))
    rows = readers.json_values(docs(spark, sf_dir).select("doc_id", value.alias("value")))
    return rows.select("doc_id", F.sha2(readers.json_text(F.col("v")).cast("binary"), 256).alias("text_sha"), F.coalesce(F.size(readers.json_extra(F.col("v"))), F.lit(0)).alias("n_extra")).withColumn("n_extra", F.greatest("n_extra", F.lit(0)))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
m AS (SELECT *, CAST(sum(CASE WHEN starts_with(t, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS INTEGER) AS section FROM l),
g AS (SELECT doc_id, section, string_agg(t, chr(10) ORDER BY line) AS body, CAST(count(*) AS INTEGER) AS n_lines FROM m GROUP BY doc_id, section)
SELECT doc_id, section, sha256(body) AS body_sha, n_lines FROM g WHERE NOT regexp_full_match(body, '\s*')""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.sections(docs(spark, sf_dir), "doc_id", "text").select("doc_id", "section", F.sha2(F.col("body").cast("binary"), 256).alias("body_sha"), "n_lines")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.html_to_markdown(table(spark, sf_dir, "pages").select("page_id", "html"), "html")


# ---- keyed tables ----


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'zz' ELSE lang END AS lang FROM documents")
def upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = docs(spark, sf_dir).select("doc_id", "lang")
    new = ingest.lookup(base, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").withColumn("lang", F.lit("zz"))
    return ingest.upsert(base, new, "doc_id")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN lang ELSE 'zz' END AS lang FROM documents")
def insert_only_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = docs(spark, sf_dir).select("doc_id", "lang")
    base = ingest.lookup(every, table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")
    return ingest.upsert(base, every.withColumn("lang", F.lit("zz")), "doc_id", allow_update=False)


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def doc_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.lookup(docs(spark, sf_dir).select("doc_id", "source"), embeddings(spark, sf_dir), "doc_id", "vec_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.delete(docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


_SENTENCES = r"list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]?[\"''」』]?'), lambda s: trim(s, E' \n\t\r')), lambda s: s <> '')".replace('\\"', '"')


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(len({_SENTENCES}) AS INTEGER) AS n_nodes FROM documents WHERE len({_SENTENCES}) > 0")
def ref_doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("ref_doc_id"), F.posexplode(TX.sentences(F.col("text"))).alias("pos", "text"))
    chunks = rows.select("ref_doc_id", F.concat_ws(":", "ref_doc_id", "pos").alias("node_id"))
    return store.ref_docs(chunks).select("doc_id", F.size("node_ids").alias("n_nodes"))


@query("SELECT vec_id, CASE WHEN label = 3 THEN 103 ELSE label END AS label FROM embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = store.with_dimension(embeddings(spark, sf_dir), None).select("vec_id", "label")
    return ingest.upsert(base, base.where("label = 3").withColumn("label", F.lit(103)), "vec_id")


@query("SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def vector_add_dim_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_dimension(embeddings(spark, sf_dir), 64).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE label <> 3")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).select("vec_id", "label")
    return ingest.delete(e, e.where("label = 3"), "vec_id").select("vec_id")


@query(f"""
WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS t2, coalesce(lag(text) OVER w, '') AS t0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, '{export.INSTRUCTION}' AS instruction, 'Context: ' || t0 || chr(10) || chr(10) || 'Question: ' || text AS input, t2 AS output FROM t WHERE role = 'user' AND r2 = 'assistant'""")
def dataset_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.conversation_triplets(table(spark, sf_dir, "conversations"))


@query("WITH h AS (SELECT sha256(text) AS id, doc_id FROM documents), k AS (SELECT sha256(text) AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT id, min(doc_id) AS first_doc_id FROM h WHERE id NOT IN (SELECT id FROM k) GROUP BY id")
def ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not yet ingested by content; those that have a label are."""
    rows = docs(spark, sf_dir).select("doc_id", S.node_id(F.col("text")).alias("id"))
    known = ingest.lookup(rows, table(spark, sf_dir, "labels"), "doc_id")
    fresh = ingest.unseen(ingest.in_batch(rows, ("id",), "doc_id"), known, keys=("id",))
    return fresh.select("id", F.col("doc_id").alias("first_doc_id"))


# ---- predicates and projections ----


def _meta(df: DataFrame) -> Column:
    extra = F.map_filter(F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("quality"), F.col("quality").cast("string")), lambda _, v: v.isNotNull())
    return S.metadata(genre=F.col("lang"), file_path=F.col("source"), extra=extra)


def _filtered(spark: SparkSession, sf_dir: str, *wanted: FL.MetadataFilter, condition: str = FL.AND) -> DataFrame:
    rows = labelled(spark, sf_dir)
    rows = rows.select("doc_id", _meta(rows).alias("metadata"))
    return rows.where(FL.compile_filters(FL.MetadataFilters(list(wanted), condition), FL.resolver(F.col("metadata")))).select("doc_id")


_M = FL.MetadataFilter
_LABELLED = "documents LEFT JOIN labels USING (doc_id)"


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("genre", "en"))


@query("SELECT doc_id FROM documents WHERE lang <> 'en'")
def filter_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("genre", "en", FL.NE))


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src5', 'src7')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("file_path", ["src1", "src5", "src7"], FL.IN))


@query("SELECT doc_id FROM documents WHERE contains(source, 'c1')")
def filter_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("file_path", "c1", FL.TEXT_MATCH))


@query("SELECT doc_id FROM documents WHERE n_chars > 2500")
def filter_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("n_chars", 2500, FL.GT))


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) < 40")
def filter_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.to_json(F.try_variant_get(F.try_parse_json("props"), "$.k", "variant"))
    rows = table(spark, sf_dir, "events")
    return rows.where(FL.compile_filters(FL.MetadataFilters([_M("k", 40, FL.LT)]), FL.columns({"k": k}))).select("event_id")


@query(f"SELECT doc_id FROM {_LABELLED} WHERE lang = 'en' AND quality = 1")
def filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("genre", "en"), _M("quality", 1))


@query(f"SELECT doc_id FROM {_LABELLED} WHERE lang = 'fr' OR coalesce(quality <> 1, false)")
def filter_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("genre", "fr"), _M("quality", 1, FL.NE), condition=FL.OR)


@query(f"SELECT doc_id FROM {_LABELLED} WHERE NOT (lang = 'en' AND coalesce(quality = 1, false))")
def filter_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir, _M("genre", "en"), _M("quality", 1), condition=FL.NOT)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND NOT contains(lower(text), 'étion')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescoring.keyword_filter(docs(spark, sf_dir), ["The"], ["étion"]).select("doc_id")


@query("SELECT doc_id, CASE WHEN lang = 'fr' THEN 'purged' ELSE 'text' END AS kind, CASE WHEN lang <> 'fr' THEN length(text) END AS n FROM documents")
def content_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.purge(docs(spark, sf_dir).select("doc_id", "lang", F.lit(S.TEXT).alias("kind"), "text"), F.col("lang") == "fr")
    return rows.select("doc_id", "kind", F.length(S.content(F.col("kind"), F.col("text"))).cast("long").alias("n"))


@query(f"SELECT doc_id, 'file_path: ' || source || chr(10) || 'genre: ' || lang || coalesce(chr(10) || 'confidence: ' || printf('%.2f', CAST(quality AS DOUBLE)), '') || chr(10) || 'n_chars: ' || n_chars AS meta_text FROM {_LABELLED}")
def metadata_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = S.metadata(genre=F.col("lang"), file_path=F.col("source"), confidence=F.col("quality"), extra=F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")))
    return labelled(spark, sf_dir).select("doc_id", meta.alias("metadata")).select("doc_id", S.render_metadata(F.col("metadata")).alias("meta_text"))


# ---- vectors ----

_COS = "round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"
_TO = lambda n: _COS.format(a="embedding", b=f"(SELECT embedding FROM embeddings WHERE vec_id = {n})")


@query(f"SELECT vec_id, {_TO(7)} AS score FROM embeddings WHERE {_TO(7)} >= 0.3")
def similarity_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.score_one(embeddings(spark, sf_dir), vector(spark, sf_dir, 7), digits=6)
    return rescoring.similarity_cutoff(scored, 0.3).select("vec_id", "score")


@query(f"SELECT vec_id, {_TO(7)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(embeddings(spark, sf_dir), vector(spark, sf_dir, 7), 10, digits=6)


_BATCH = f"SELECT q.vec_id AS query_id, c.vec_id, {_COS.format(a='q.embedding', b='c.embedding')} AS score FROM embeddings q, embeddings c"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query(f"WITH s AS ({_BATCH}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k_batch(embeddings(spark, sf_dir), _queries(spark, sf_dir), 10, digits=6)


@query(f"WITH s AS ({_BATCH} WHERE c.label = 3), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = FL.compile_typed_filters(FL.MetadataFilters([_M("label", 3)]), {"label": F.col("label")})
    return search.top_k_batch(embeddings(spark, sf_dir).where(wanted), _queries(spark, sf_dir), 5, digits=6)


@query(f"WITH s AS ({_BATCH}), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, doc_id, source, score FROM r JOIN documents ON vec_id = doc_id WHERE rank <= 10")
def vector_retrieve_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.retrieve(vector_topk_batch(spark, sf_dir), docs(spark, sf_dir), "vec_id", "doc_id", "source")


@query()
def vector_topk_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k_ann(embeddings(spark, sf_dir), _queries(spark, sf_dir), 10, digits=6)


# ---- fusion and re-scoring ----


def _two_lists(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    e = embeddings(spark, sf_dir)
    return [search.top_k(e, vector(spark, sf_dir, n), 20, digits=6).withColumn("query_id", F.lit(0)) for n in (7, 8)]


_LISTS = f"""WITH a AS (SELECT vec_id, {_TO(7)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20), b AS (SELECT vec_id, {_TO(8)} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20),
u AS (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rk FROM a UNION ALL SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) FROM b)"""


@query(f"{_LISTS} SELECT vec_id, round(sum(score), 6) AS score FROM u GROUP BY vec_id")
def hybrid_weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.weighted_sum(_two_lists(spark, sf_dir), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"{_LISTS} SELECT vec_id, round(sum(1.0::DOUBLE / (60 + rk)), 9) AS score FROM u GROUP BY vec_id")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(_two_lists(spark, sf_dir), "vec_id").select("vec_id", F.round("score", 9).alias("score"))


@query(f"{_LISTS}, f AS (SELECT vec_id, sum(1.0::DOUBLE / (60 + rk)) AS score FROM u GROUP BY vec_id) SELECT vec_id, round(score * CASE WHEN label = 3 THEN 1.75 ELSE 1.0 END, 9) AS score FROM f JOIN embeddings USING (vec_id)")
def hybrid_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.hybrid(_two_lists(spark, sf_dir), "rrf", id_col="vec_id").join(embeddings(spark, sf_dir).select("vec_id", "label"), "vec_id")
    bias = rescoring.Bias.parse("@BIAS:{3:1.5}")
    factor = rescoring.boost(bias, genre=F.col("label").cast("string"))
    return rescoring.rescore(fused, factor).select("vec_id", F.round("score", 9).alias("score"))


DIRECTIVES = "@BIAS:{en:1.5, fr:-0.5} [[the]] @CTX:[GOAL:und]"
_NOW = "2024-06-01 00:00:00"


@query(f"""SELECT doc_id, round((1.0 + CASE WHEN contains(lower(text), 'the') THEN 0.25 ELSE 0 END + CASE WHEN contains(lower(text), 'und') THEN 0.6 ELSE 0 END + CASE lang WHEN 'en' THEN 0.75 WHEN 'fr' THEN -0.25 ELSE 0 END
 + coalesce(0.4 * quality, 0) + coalesce(0.5 * toxic, 0))::DOUBLE * pow(0.98::DOUBLE, least(doc_id % 365, 180)), 6) AS score FROM {_LABELLED}""")
def bias_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(_NOW).cast("timestamp")
    stamp = F.timestamp_seconds(F.unix_timestamp(now) - F.col("doc_id") % 365 * 86400)
    factor = rescoring.boost(rescoring.Bias.parse(DIRECTIVES), text=F.col("text"), genre=F.col("lang"), confidence=F.col("quality"), importance=F.col("toxic"), timestamp=stamp, now=now)
    return rescoring.rescore(labelled(spark, sf_dir).withColumn("score", F.lit(1.0)), factor).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]) AS c FROM embeddings)
SELECT vec_id, round(1 + CASE WHEN c > 0.7 THEN (c - 0.7) * 4 ELSE 0 END, 6) AS score FROM s""")
def bias_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = rescoring.boost(rescoring.Bias(), embedding=F.col("embedding"), concept_vectors=[vector(spark, sf_dir, 7)])
    return rescoring.rescore(embeddings(spark, sf_dir).withColumn("score", F.lit(1.0)), factor).select("vec_id", F.round("score", 6).alias("score"))


# ---- chunking ----

_PHRASES = "regexp_extract_all(text, '[^,.;。？！]+[,.;。？！]?|[,.;。？！]')"
_EXPLODED = "SELECT doc_id, unnest({x}) AS text, generate_subscripts({x}, 1) - 1 AS pos FROM documents"


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM ({_EXPLODED.format(x=_PHRASES)})")
def phrase_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(TX.phrases(F.col("text"))).alias("pos", "text"))


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, text FROM ({_EXPLODED.format(x=_SENTENCES)})")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(TX.sentences(F.col("text"))).alias("pos", "text"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\w+|[^\w\s]')) AS BIGINT) AS n FROM documents")
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", TX.token_count(F.col("text")).alias("n"))


@query(rf"""
WITH RECURSIVE p AS (SELECT doc_id, list_transform({_PHRASES}, lambda x: CAST(len(regexp_extract_all(x, '\w+|[^\w\s]')) AS BIGINT)) AS sizes FROM documents),
f(doc_id, sizes, i, total, chunk, closed) AS (
  SELECT doc_id, sizes, 1, sizes[1], 0, NULL::BIGINT FROM p WHERE len(sizes) > 0
  UNION ALL
  SELECT doc_id, sizes, i + 1, CASE WHEN i = len(sizes) THEN 0 WHEN total > 0 AND total + sizes[i + 1] > 50 THEN sizes[i + 1] ELSE total + sizes[i + 1] END,
    CASE WHEN i = len(sizes) OR (total > 0 AND total + sizes[i + 1] > 50) THEN chunk + 1 ELSE chunk END,
    CASE WHEN i = len(sizes) OR (total > 0 AND total + sizes[i + 1] > 50) THEN total END
  FROM f WHERE i <= len(sizes))
SELECT doc_id, chunk - 1 AS chunk, closed AS n_tokens FROM f WHERE closed IS NOT NULL""")
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = docs(spark, sf_dir).select("doc_id", F.transform(TX.phrases(F.col("text")), TX.token_count).alias("sizes"))
    rows = sized.select("doc_id", F.explode(F.arrays_zip("sizes", chunking.chunk_numbers(F.col("sizes"), 50).alias("chunk"))).alias("z")).select("doc_id", "z.*")
    return rows.groupBy("doc_id", "chunk").agg(F.sum("sizes").alias("n_tokens"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.floor(F.col("vec_id") / 25).cast("long").alias("run"), (F.col("vec_id") % 25).alias("pos"), "embedding")


_DIST = """d AS (SELECT run, pos, 1 - list_cosine_similarity(embedding::DOUBLE[], nxt::DOUBLE[]) AS dist FROM (
  SELECT vec_id // 25 AS run, vec_id % 25 AS pos, embedding, lead(embedding) OVER (PARTITION BY vec_id // 25 ORDER BY vec_id) AS nxt FROM embeddings) WHERE nxt IS NOT NULL)"""
_THR = "t AS (SELECT run, list_sort(list(dist))[least(CAST(floor(count(*) * 95.0 / 100.0) AS INTEGER), count(*) - 1) + 1] AS thr FROM d GROUP BY run)"


@query(f"WITH {_DIST} SELECT run, pos, round(dist, 6) AS dist FROM d")
def semantic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic_distances(_runs(spark, sf_dir), "run", "pos").withColumn("dist", F.round("dist", 6))


@query(f"WITH {_DIST}, {_THR} SELECT run, round(thr, 6) AS thr FROM t")
def semantic_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chunking.semantic_distances(_runs(spark, sf_dir), "run", "pos")
    return d.groupBy("run").agg(F.round(chunking.percentile_by_rank(F.collect_list("dist"), 95.0), 6).alias("thr"))


@query(f"""WITH {_DIST}, {_THR}, c AS (SELECT e.vec_id // 25 AS run, e.vec_id % 25 AS pos, coalesce(sum(CASE WHEN d.dist > t.thr THEN 1 ELSE 0 END) OVER (PARTITION BY e.vec_id // 25 ORDER BY e.vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk
  FROM embeddings e LEFT JOIN d ON d.run = e.vec_id // 25 AND d.pos = e.vec_id % 25 LEFT JOIN t ON t.run = e.vec_id // 25)
SELECT run, CAST(chunk AS INTEGER) AS chunk, count(*) AS n FROM c GROUP BY run, chunk""")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark, sf_dir)
    ids = chunking.semantic_chunk_ids(runs, chunking.semantic_distances(runs, "run", "pos"), "run", "pos")
    return ids.groupBy("run", "chunk").agg(F.count("*").alias("n"))


# ---- packing, extraction, evaluation ----


@query("""
WITH RECURSIVE g AS (SELECT conv_id, list(length(text) ORDER BY turn) AS sizes FROM conversations GROUP BY conv_id),
f(conv_id, sizes, i, total, chunk) AS (SELECT conv_id, sizes, 1, sizes[1], 1 FROM g UNION ALL
  SELECT conv_id, sizes, i + 1, CASE WHEN total + sizes[i + 1] > 400 THEN sizes[i + 1] ELSE total + sizes[i + 1] END, CASE WHEN total + sizes[i + 1] > 400 THEN chunk + 1 ELSE chunk END FROM f WHERE i < len(sizes))
SELECT conv_id, CAST(max(chunk) AS INTEGER) AS n_chunks FROM f GROUP BY conv_id""")
def compact_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    texts = F.transform("r", lambda x: x["text"])
    return rows.select("conv_id", F.size(synthesis.pack(F.transform(texts, F.length), texts, 0, 0, 400)).alias("n_chunks"))


def _replied(spark: SparkSession, sf_dir: str, reply: Column) -> DataFrame:
    meta = S.metadata(genre=F.col("lang"), extra=F.create_map(F.lit("n_chars"), F.col("n_chars").cast("string")))
    return docs(spark, sf_dir).select("doc_id", F.lit(None).cast("string").alias("node_id"), F.lit(S.TEXT).alias("kind"), "text", F.lit(None).cast("binary").alias("bytes"), meta.alias("metadata"), reply.alias("reply"))


@query("SELECT doc_id, sha256(CASE WHEN lang = 'fr' THEN text ELSE trim(upper(lang) || ':' || source) END) AS value, lang <> 'fr' AS refined FROM documents")
def refine_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("lang") != "fr", F.concat(F.lit(" "), F.upper("lang"), F.lit(":"), F.col("source"), F.lit(" ")))
    rows = extraction.apply_refined(_replied(spark, sf_dir, reply))
    return rows.select("doc_id", F.col("node_id").alias("value"), F.coalesce(F.element_at("metadata.extra", "is_refined") == "true", F.lit(False)).alias("refined"))


@query("SELECT doc_id, CASE WHEN lang <> 'fr' THEN '\"' || source || ' in ' || lang || '\"' END AS value FROM documents")
def title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("lang") != "fr", F.concat(F.lit(" "), F.col("source"), F.lit(" in "), F.col("lang")))
    return extraction.apply_title(_replied(spark, sf_dir, reply)).select("doc_id", F.element_at("metadata.extra", "document_title").alias("value"))


@query("SELECT doc_id, '\"' || n_chars || ' characters\"' AS value FROM documents")
def summary_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.col("n_chars").cast("string"), F.lit(" characters"))
    return extraction.apply_summary(_replied(spark, sf_dir, reply)).select("doc_id", F.element_at("metadata.extra", "section_summary").alias("value"))


@query("SELECT doc_id, CASE WHEN lang <> 'fr' THEN 0.25::DOUBLE END AS confidence, CASE WHEN lang IN ('en', 'es') THEN CAST(n_chars AS DOUBLE) END AS importance FROM documents")
def stratify_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit('{"confidence": 0.25, "importance": '), F.col("n_chars").cast("string"), F.lit("}"))
    reply = F.when(F.col("lang") == "fr", F.lit("no JSON {")).when(F.col("lang") == "de", F.lit('{"confidence": 0.25, "importance": "high"}')).otherwise(good)
    return docs(spark, sf_dir).select("doc_id", extraction.strata(reply).alias("s")).select("doc_id", "s.confidence", "s.importance")


def _graded(spark: SparkSession, sf_dir: str, parse: Callable[[Column], Column]) -> DataFrame:
    reply = F.when(F.col("lang") == "en", F.lit('Well: {"score": 0.9, "feedback": "f", "passing": true} done')).when(F.col("lang") == "fr", F.concat(F.lit("Score: 0."), (F.col("n_chars") % 10).cast("string"))).when(F.col("lang") == "de", F.lit("} {")).otherwise(F.lit('{"score": 0.4, "more": {"a": 1}}'))
    return docs(spark, sf_dir).select("doc_id", parse(reply).alias("r")).select("doc_id", "r.score", "r.passing")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 0.9 WHEN 'fr' THEN (n_chars % 10) / 10.0 ELSE 0 END::DOUBLE AS score, lang = 'en' OR (lang = 'fr' AND n_chars % 10 >= 7) AS passing FROM documents")
def eval_faithfulness_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir, evaluation.parse_faithfulness)


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 0.9 WHEN lang IN ('fr', 'de') THEN 0 ELSE 0.4 END::DOUBLE AS score, lang = 'en' AS passing FROM documents")
def eval_relevancy_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir, evaluation.parse_relevancy)


# ---- trees ----


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.concat_ws(":", F.lit("doc"), "doc_id").alias("node_id"), tree.group_key(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("ord"), "text")


_BUCKETS = "SELECT doc_id, text, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS bucket FROM documents"


@query(f"SELECT source, bucket, count(*) AS n, min(doc_id) AS first_doc FROM ({_BUCKETS}) GROUP BY source, bucket")
def hier_level_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = tree.level_groups(docs(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", stored)
    return grouped.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY doc_id) - 1 AS i FROM ({_BUCKETS})) SELECT source, bucket, sha256(string_agg('Node ' || i || ':' || chr(10) || text || chr(10) || chr(10), '' ORDER BY doc_id)) AS prompt_sha FROM b GROUP BY source, bucket")
def hier_level_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = tree.level_groups(docs(spark, sf_dir).select("doc_id", "source", "text"), "source", "doc_id", stored)
    return tree.level_prompts(grouped, "source", "doc_id", "text").select("source", "bucket", F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha"))


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tree.build(_leaves(spark, sf_dir), lambda prompt: F.concat(F.lit("summary of "), F.length(prompt).cast("string")), stored)


@query("WITH RECURSIVE l(source, level, n) AS (SELECT source, 0, count(*) FROM documents GROUP BY source UNION ALL SELECT source, level + 1, (n + 4) // 5 FROM l WHERE level < (SELECT CAST(max(CASE WHEN n <= 1 THEN 0 ELSE ceil(round(ln(n) / ln(5), 9)) END) AS INTEGER) FROM (SELECT count(*) AS n FROM documents GROUP BY source))) SELECT level, CAST(sum(n) AS BIGINT) AS n_nodes FROM l GROUP BY level")
def hier_build_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)[0].groupBy("level").agg(F.count("*").alias("n_nodes"))


@query("SELECT source, 'doc:' || min(doc_id) AS node_id FROM documents GROUP BY source")
def hier_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every root down by the first child: the first document of each source."""
    nodes, edges = _tree(spark, sf_dir)
    edges = stored(edges, "edges")
    start = tree.roots(nodes, edges).select(F.col("key").alias("query_id"), "node_id")
    return tree.descend(start, edges, tree.first_child, 10, stored).select(F.col("query_id").alias("source"), "node_id")


@query("SELECT doc_id, unnest(CASE WHEN lang = 'en' THEN [0, 2, 2] WHEN lang = 'fr' THEN [1] ELSE []::INTEGER[] END) AS idx FROM documents")
def selector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("lang") == "en", F.lit("0, 2,2")).when(F.col("lang") == "fr", F.lit("x,9, 1")).otherwise(F.lit(""))
    return docs(spark, sf_dir).select("doc_id", F.explode(tree.parse_choices(reply, F.lit(3))).alias("idx"))


@query("SELECT CAST(conv_id AS VARCHAR) AS query, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS choice_pos, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS target FROM conversations")
def triplet_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("query")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("r"))
    picked = F.filter(F.transform("r", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    triplets = rows.select("query", F.lit("").alias("parent_context"), F.transform("r", lambda x: x["text"]).alias("choices"), picked.alias("selected_indices"))
    return tree.flatten_triplets(triplets).select("query", "choice_pos", "target")


@query()
def mlp_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a child of the first of its run, chosen by an untrained perceptron."""
    runs = _runs(spark, sf_dir)
    first = runs.groupBy("run").agg(F.min_by("embedding", "pos").alias("p"))
    pairs = runs.join(first, "run").select(F.col("run").alias("query_id"), F.col("run").alias("parent_id"), F.col("pos").alias("node_id"), F.col("pos").alias("ord"), F.col("p").alias("q"), F.col("embedding").alias("c"), "p")
    return tree.select_by_model(pairs, tree.Perceptron(64, seed=1)).select("query_id", "node_id", F.round("score", 6).alias("score"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_retrieve_docs(spark, sf_dir)


