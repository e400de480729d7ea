"""One query for each operator, over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, mixing, mtree, placement, quality, secrets, simhash, surrogates, warc

#: Output shards and slots of the sharding query and of the pipeline.
SHARDS, SLOTS = [f"shard-{i:02d}" for i in range(32)], 4099
#: Output shards of the mixing query.
MIX_SHARDS = 16


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents"), shards=MIX_SHARDS)


def op3_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(_read(spark, sf_dir, "documents"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogate(_read(spark, sf_dir, "documents"), secret="quernstone")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return placement.place(docs, "doc_id", SHARDS, SLOTS).select("doc_id", F.coalesce("n_bytes", F.lit(0)).cast("long").alias("n_bytes"), "slot", "shard", "shard_name")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_OP2 = """
WITH RECURSIVE sized AS (SELECT doc_id, source, substr(md5(coalesce(text, '')), 1, 16) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w, source_size * 2 AS cap FROM by_source),
leveled AS (SELECT *, row_number() OVER o AS k,
    ((SELECT sum(source_size) FROM by_source) * 3 / 2.0::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w::DOUBLE, source NULLS LAST)),
opened AS (SELECT *, (SELECT min(k) FROM leveled WHERE level * w < cap) AS open_k FROM leveled),
goals AS (SELECT source, source_size, CASE WHEN k >= open_k THEN (SELECT level FROM opened WHERE k = open_k) * w ELSE cap::DOUBLE END AS target FROM opened),
blocks AS (SELECT doc_id, source, e.epoch, b.block, least(256, size - b.block * 256) AS words,
    ('0x' || substr(md5('7:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest || ':' || b.block), 1, 15))::BIGINT AS h
  FROM sized, (SELECT unnest([0, 1]) AS epoch) e, LATERAL (SELECT unnest(range(CAST(ceil(size / 256.0) AS BIGINT))) AS block) b WHERE size > 0),
summed AS (SELECT *, sum(words) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, block ROWS UNBOUNDED PRECEDING) AS total FROM blocks),
drawn AS (SELECT s.*, row_number() OVER (PARTITION BY s.source, epoch ORDER BY h, doc_id, block) - 1 AS place FROM summed s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
  WHERE s.total * 2 - s.words <= 2 * least(greatest(g.target - s.epoch * g.source_size, 0), g.source_size)),
quotas AS (SELECT source, epoch, row_number() OVER (ORDER BY source NULLS LAST, epoch) AS i, n FROM (SELECT source, epoch, count(*) AS n FROM drawn GROUP BY source, epoch)),
root AS (SELECT list(n ORDER BY i) AS q FROM quotas HAVING count(*) > 0),
walk AS (  -- a row for each node (its first shard and how many it has) and source that comes next
  SELECT 0 AS lo, SHARDS AS n, q, 0 AS i, []::BIGINT[] AS l, list_sum(q)::BIGINT AS rest, (SHARDS // 2) * (list_sum(q)::BIGINT // SHARDS) + least(SHARDS // 2, list_sum(q)::BIGINT % SHARDS) AS need FROM root
  UNION ALL (
  SELECT lo, n, q, i, l, rest, (n // 2) * (rest // n) + least(n // 2, rest % n) FROM (
    SELECT lo + side * (n // 2) AS lo, CASE side WHEN 0 THEN n // 2 ELSE n - n // 2 END AS n, kept AS q, 0 AS i, []::BIGINT[] AS l, coalesce(list_sum(kept), 0)::BIGINT AS rest
    FROM (SELECT *, CASE side WHEN 0 THEN l ELSE list_transform(range(1, len(q) + 1), lambda k: q[k] - l[k]) END AS kept FROM walk, (SELECT unnest([0, 1]) AS side) WHERE n > 1 AND i = len(q)))
  UNION ALL
  SELECT lo, n, q, i + 1, list_append(l, x), rest - good, need - x FROM (
    SELECT *, CASE WHEN low = high THEN low ELSE list_reduce(list_transform(weighed, lambda y: {'k': y.k, 's': y.w}), lambda a, b: CASE WHEN a.s > u * list_sum(list_transform(weighed, lambda y: y.w)) THEN a ELSE {'k': b.k, 's': a.s + b.s} END).k END AS x FROM (
    SELECT *, list_transform(list_concat(range(mode, high + 1), list_reverse(range(low, mode))), lambda k: {'k': k, 'w': exp(
      lgamma(mode + 1) + lgamma(good - mode + 1) + lgamma(need - mode + 1) + lgamma(bad - need + mode + 1) - lgamma(k + 1) - lgamma(good - k + 1) - lgamma(need - k + 1) - lgamma(bad - need + k + 1))}) AS weighed FROM (
    SELECT *, least(greatest((need + 1) * (good + 1) // (good + bad + 2), low), high) AS mode FROM (
    SELECT *, greatest(0, need - bad) AS low, least(need, good) AS high, ('0x' || substr(md5('7:' || lo || ':' || n || ':' || i), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u FROM (
    SELECT *, q[i + 1] AS good, rest - q[i + 1] AS bad FROM walk WHERE n > 1 AND i < len(q)))))))),
ends AS (SELECT i, list(upto ORDER BY lo) AS ends FROM (SELECT i, lo, sum(part) OVER (PARTITION BY i ORDER BY lo) AS upto FROM (SELECT lo, unnest(range(1, len(q) + 1)) AS i, unnest(q) AS part FROM walk WHERE n = 1)) GROUP BY i),
held AS (SELECT doc_id, shard, sum(words) AS words, count(*) AS n FROM (
  SELECT d.*, len(list_filter(ends, lambda e: e <= place)) AS shard FROM drawn d JOIN quotas k ON d.source IS NOT DISTINCT FROM k.source AND d.epoch = k.epoch JOIN ends e ON e.i = k.i) GROUP BY doc_id, shard),
taken AS (SELECT doc_id, sum(words) AS taken, sum(n) AS blocks, count(*) AS shards, string_agg(shard || ':' || n, ',' ORDER BY shard) AS dealt FROM held GROUP BY doc_id)
"""


def _op8() -> str:
    """Places as sums of the lengths of the pieces between matches and of the matches before."""
    share = "(length(v) - length(replace(v, c, ''))) / length(v)::DOUBLE"
    entropy = f"-list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: {share} * log2({share})))"
    random = f"regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{secrets.MARKER}') AND {entropy} >= {secrets.RANDOM_BITS}"
    parts, quote = [], lambda x: "'" + x.replace("'", "''") + "'"
    for rank, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        p = quote(pattern)
        parts.append(f"""SELECT row, owner, repo, {rank} AS rank, '{kind}' AS kind, start, start + length(m) AS stop, sha256(v) AS secret, {random} AS random FROM (
  SELECT row, owner, repo, m[i] AS m, v[i] AS v, CAST(list_sum(list_transform(list_slice(pieces, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT row, owner, repo, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS pieces FROM d WHERE regexp_matches(t, {p})), LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i))
WHERE length(v) >= {least}""")
    listed = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE {where}), '')"
    n = ", ".join(f"count(*) FILTER (WHERE kind = '{k[0]}') AS n_{k[0]}" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
f AS ({" UNION ALL ".join(parts)}),
k AS (SELECT *, owners >= 3 OR repos >= 4 AS example FROM (SELECT secret, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM f GROUP BY secret)),
g AS (SELECT row, {n}, {listed(f"rank < {len(secrets.BASE)}")} AS base, {listed("true")} AS spans,
  count(*) FILTER (WHERE NOT example AND random) AS n_live, count(*) FILTER (WHERE example) AS n_example, count(*) FILTER (WHERE NOT example AND NOT random) AS n_weak, max(owners) AS most_owners, max(repos) AS most_repos FROM f JOIN k USING (secret) GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0) AS n_{k[0]}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_weak, 0) AS n_weak, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos FROM d LEFT JOIN g USING (row)"""


_OP9 = r"""
WITH w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
p AS (SELECT item, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(list_slice(words, i, i + m - 1), ' '))) AS gram FROM (SELECT *, least(10, len(words)) AS m FROM b WHERE len(words) > 0)),
x AS (SELECT row, m, unnest(range(1, len(words) - m + 2)) AS i, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(list_slice(words, i, i + m - 1), ' '))) AS gram FROM w, (SELECT DISTINCT m FROM p) WHERE len(words) >= m),
h AS (SELECT row, x.m, i, item FROM x JOIN p ON x.m = p.m AND x.gram = p.gram),
n AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS pos FROM (SELECT DISTINCT row, m, i FROM h)) GROUP BY row),
o AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (row) LEFT JOIN o USING (row)"""


def _op10() -> str:
    """The owners of the slots stand in the statement; a test fills the table by hand."""
    owner = ", ".join(map(str, placement.fill(SHARDS, SLOTS)))
    return f"""
WITH s AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot FROM documents),
o AS (SELECT [{owner}] AS owner), p AS (SELECT s.*, CAST(owner[slot + 1] AS INTEGER) AS shard FROM s, o)
SELECT doc_id, n_bytes, slot, shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 2, '0') AS shard_name FROM p"""


def sql() -> dict[str, str]:
    return {
        "op2_mixing": _OP2.replace("SHARDS", str(MIX_SHARDS)) + "SELECT doc_id, size, s.source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks, coalesce(shards, 0) AS shards, coalesce(dealt, '') AS dealt FROM sized z JOIN goals s ON z.source IS NOT DISTINCT FROM s.source LEFT JOIN taken USING (doc_id)",
        "op8_secrets": _op8(),
        "op9_decontamination": _OP9,
        "op10_sharding": _op10(),
        "op3_mtree_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
        "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha FROM p),
f AS (SELECT sha, min(page_id) AS first_id FROM d GROUP BY sha)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(sha, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d JOIN f USING (sha)""",
    }
