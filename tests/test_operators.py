"""Operators on small inputs with known results."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone import schema as S
from quernstone.config import SplitterConfig, SynthesizerConfig
from quernstone.functions import filters as FL
from quernstone.functions import text as TX
from quernstone.functions import vectors as V
from quernstone.operators import chunking, evaluation, export, extraction, fusion, ingest, models, rescoring, search, synthesis, tree
from quernstone.sources.scratch import stored


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# ---- identity ----


def test_hash_ignores_the_order_of_extra(spark):
    df = spark.sql("SELECT 't' AS text, map('a', '1', 'b', '2') AS x UNION ALL SELECT 't', map('b', '2', 'a', '1')")
    nodes = S.text_nodes(df, F.col("text"), S.metadata(extra=F.col("x")))
    assert nodes.select("node_id", "node_hash").distinct().count() == 1
    assert len(nodes.first()["node_id"]) == 64


def test_hash_follows_metadata_and_id_does_not(spark):
    df = spark.createDataFrame([("t", "en"), ("t", "fr"), ("t", None)], "text string, g string")
    nodes = S.text_nodes(df, F.col("text"), S.metadata(genre=F.col("g")))
    assert nodes.select("node_id").distinct().count() == 1 and nodes.select("node_hash").distinct().count() == 3


def test_purged_nodes_keep_their_id_and_lose_their_text(spark):
    nodes = S.text_nodes(spark.createDataFrame([("t",)], "text string"), F.col("text"), S.metadata())
    before = nodes.first()["node_id"]
    gone = S.with_identity(S.purge(nodes, F.lit(True))).first()
    assert (gone["node_id"], gone["kind"], gone["text"]) == (before, "purged", None)


def test_content_of_other_kinds(spark):
    df = spark.sql("SELECT 'binary' AS kind, CAST(NULL AS STRING) AS text, X'0102' AS b UNION ALL SELECT 'image', NULL, X'01' UNION ALL SELECT 'purged', NULL, NULL")
    assert [r[0] for r in df.select(S.content(F.col("kind"), F.col("text"), F.col("b"))).collect()] == ["<Binary data: 2 bytes>", "<Image data>", None]


def test_metadata_text_skips_what_is_excluded(spark):
    meta = S.metadata(url=F.lit("u"), genre=F.lit("g"), confidence=F.lit(0.5), extra=F.create_map(F.lit("b"), F.lit('"x"'), F.lit("a"), F.lit("[1, 2]")))
    text = spark.range(1).select(meta.alias("m")).select(S.render_metadata(F.col("m"), F.array(F.lit("url")))).first()[0]
    assert text == "genre: g\nconfidence: 0.50\na: [1,2]\nb: x"


# ---- predicates ----

VALUES = {"int": "1", "float": "1.0", "string": '"1"', "text": '"abc"', "missing": None, "list": "[1]"}


@pytest.mark.parametrize(
    ("op", "value", "wanted"),
    [
        (FL.EQ, 1, {"int"}), (FL.EQ, "1", {"string"}), (FL.EQ, 1.0, {"float"}), (FL.NE, 1, {"float", "string", "text", "list"}), (FL.GT, 0, {"int", "float"}), (FL.LT, 1, set()),
        (FL.GT, "0", set()), (FL.IN, [1, "abc"], {"int", "text"}), (FL.IN, [], set()), (FL.IN, 1, set()), (FL.TEXT_MATCH, "b", {"text"}), (FL.TEXT_MATCH, "B", set()), (FL.TEXT_MATCH, 1, set()),
    ],
)
def test_comparisons_are_strict_and_a_missing_key_fails_all(spark, op, value, wanted):
    df = spark.createDataFrame(list(VALUES.items()), "name string, v string")
    keep = FL.compile_filters(FL.MetadataFilters([FL.MetadataFilter("k", value, op)]), FL.columns({"k": F.col("v")}))
    assert {r["name"] for r in df.where(keep).collect()} == wanted


@pytest.mark.parametrize(("condition", "wanted"), [(FL.AND, {"both"}), (FL.OR, {"both", "one"}), (FL.NOT, {"one", "none", "missing"})])
def test_conditions_and_that_not_is_not_all(spark, condition, wanted):
    df = spark.createDataFrame([("both", "1", "2"), ("one", "1", "3"), ("none", "0", "3"), ("missing", None, None)], "name string, a string, b string")
    filters = FL.MetadataFilters([FL.MetadataFilter("a", 1), FL.MetadataFilter("b", 2)], condition)
    assert {r["name"] for r in df.where(FL.compile_filters(filters, FL.columns({"a": F.col("a"), "b": F.col("b")}))).collect()} == wanted


@pytest.mark.parametrize("condition", [FL.AND, FL.OR, FL.NOT])
def test_no_filter_passes_all(spark, condition):
    assert spark.range(2).where(FL.compile_filters(FL.MetadataFilters([], condition), FL.columns({}))).count() == 2


def test_unknown_operators_and_conditions_are_refused():
    with pytest.raises(ValueError):
        FL.compile_typed(FL.MetadataFilter("k", 1, "like"), F.lit(1))
    with pytest.raises(ValueError):
        FL.combine([F.lit(True)], "xor")


def test_keywords_in_any_case_and_gone_texts_fail(spark):
    df = spark.createDataFrame([(1, "Rust and Go"), (2, "rust only"), (3, None)], "id int, text string")
    assert rows(rescoring.keyword_filter(df, ["RUST"], ["go"]).select("id")) == [(2,)]
    assert rows(rescoring.keyword_filter(df).select("id"), "id") == [(1,), (2,)]


def test_cutoff_drops_rows_without_a_score(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.4), (3, None)], "id int, score double")
    assert rows(rescoring.similarity_cutoff(df, 0.5).select("id")) == [(1,)]


# ---- fusion and re-scoring ----


def ranked(spark, *pairs):
    return spark.createDataFrame([(0, i, s) for i, s in pairs], "query_id int, id string, score double")


def test_weighted_sum_adds_scores(spark):
    lists = [ranked(spark, ("N1", 0.8), ("N2", 0.2)), ranked(spark, ("N1", 0.1), ("N2", 0.9))]
    got = {r["id"]: round(r["score"], 9) for r in fusion.weighted_sum(lists).collect()}
    assert got == {"N2": 1.1, "N1": 0.9}
    assert rows(fusion.best_first(fusion.weighted_sum(lists)).select("id")) == [("N2",), ("N1",)]


def test_weighted_sum_counts_a_null_score_as_nothing(spark):
    assert rows(fusion.weighted_sum([ranked(spark, ("N1", None)), ranked(spark, ("N1", 0.5))]).select("id", "score")) == [("N1", 0.5)]


def test_reciprocal_ranks_of_mirrored_lists_are_equal(spark):
    lists = [ranked(spark, ("N1", 2.0), ("N2", 1.0)), ranked(spark, ("N2", 2.0), ("N1", 1.0))]
    scores = {round(r["score"], 12) for r in fusion.reciprocal_rank(lists).collect()}
    assert scores == {round(1 / 61 + 1 / 62, 12)}


def test_an_id_twice_in_a_list_counts_twice(spark):
    got = fusion.reciprocal_rank([ranked(spark, ("N1", 2.0), ("N1", 1.0))]).first()["score"]
    assert got == pytest.approx(1 / 61 + 1 / 62)


def test_directives_are_parsed():
    b = rescoring.Bias.parse("@BIAS:{SciFi:1.5, Fantasy:-0.5, bad, a:b:c, x:y} [[AI]] [[Rust]] @CTX:[DOM:PROJECT|SUB:DEV|GOAL:STABLE|A:B:C]")
    assert b.weights == {"SciFi": 1.5, "Fantasy": -0.5} and b.concepts == ["AI", "Rust"] and b.intents == ["PROJECT", "DEV", "STABLE"]
    assert rescoring.Bias.strip("@BIAS:{a:1} what is [[AI]] ?") == "what is AI ?"


def test_decay_lets_new_rows_pass_old_ones(spark):
    now = dt.datetime(2024, 6, 1)
    df = spark.createDataFrame([("old", now - dt.timedelta(days=30), 1.0, 1.0), ("new", now, 0.1, 1.0), ("ancient", now - dt.timedelta(days=999), None, 1.0)], "id string, ts timestamp, importance double, score double")
    factor = rescoring.boost(rescoring.Bias(), importance=F.col("importance"), timestamp=F.col("ts"), now=F.lit(now))
    got = {r["id"]: r["score"] for r in rescoring.rescore(df, factor).collect()}
    assert got["new"] == pytest.approx(1.05) and got["old"] == pytest.approx(1.5 * 0.98**30) and got["ancient"] == pytest.approx(0.98**180)


def test_purged_rows_match_concepts_by_tags(spark):
    df = spark.createDataFrame([(None, ["Rust"], 1.0)], "text string, tags array<string>, score double")
    factor = rescoring.boost(rescoring.Bias.parse("[[rust]]"), text=F.col("text"), tags=F.col("tags"))
    assert rescoring.rescore(df, factor).first()["score"] == pytest.approx(1.25)


def test_unmatched_bias_and_null_scores(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "x", None)], "id int, genre string, score double")
    out = {r["id"]: r["score"] for r in rescoring.rescore(df, rescoring.boost(rescoring.Bias.parse("@BIAS:{Negative:100.0}"), genre=F.col("genre"))).collect()}
    assert out == {1: 1.0, 2: None}


# ---- vectors ----


def test_cosine_of_odd_vectors_is_zero(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [])], "id int, v array<double>")
    got = {r["id"]: r["c"] for r in df.select("id", V.cosine_to(F.col("v"), [3.0, 4.0]).alias("c")).collect()}
    assert got == {1: pytest.approx(1.0), 2: 0.0, 3: 0.0, 4: 0.0}


def test_batch_search_equals_single_searches_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)] + [(60, [0.0] * 4)]
    corpus = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    asked = corpus.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    batch = search.top_k_batch(corpus, asked, 7, digits=6, block=2)
    for q in range(5):
        one = rows(search.top_k(corpus, vecs[q][1], 7, digits=6))
        assert rows(batch.where(F.col("query_id") == q).orderBy("rank").select("vec_id", "score")) == one


@pytest.mark.parametrize("page", [16, 4096])
def test_approximate_search_scores_exactly_in_any_blocks(spark, page):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(8, 10))[rng.integers(0, 8, 300)] + 0.1 * rng.normal(size=(300, 10)), 3)
    corpus = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None)], "vec_id long, embedding array<double>")
    asked = corpus.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = search.top_k_ann(corpus, asked, 5, tables=12, bits=4, digits=6, page=page).collect()
    exact = {(r["query_id"], r["vec_id"]) for r in search.top_k_batch(corpus, asked, 5, digits=6).collect()}
    assert all(r["score"] == pytest.approx(unit[r["query_id"]] @ unit[r["vec_id"]], abs=1e-6) for r in got)
    assert len(got) == 100 and len({(r["query_id"], r["vec_id"]) for r in got} & exact) >= 90


def odd_vectors(spark):
    """Copies, zeros, nulls, a vector of another length and one that isn't finite among others, and the unit vectors that they stand for."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 6)), 2)
    x[40:120], x[120:126], x[7] = x[3], 0.0, np.nan
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(240, None), (241, [1.0])]
    unit = V.unit(np.vstack([x, np.zeros((2, 6))]))
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return corpus, corpus.where("size(embedding) = 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), unit


def jobs_of(spark, run):
    group = f"group-{np.random.default_rng().integers(1 << 40)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("sizes", [{}, {"block": 7}, {"block": 7, "page": 50}, {"block": 150, "page": 1}])
def test_batch_search_by_queries_or_pages_equals_all_pairs(spark, sizes):
    corpus, asked, unit = odd_vectors(spark)
    score = np.round(unit[:240] @ unit.T, 6) + 0.0
    wanted = {(q, n + 1, int(i), score[q, i]) for q in range(240) for n, i in enumerate(np.lexsort((np.arange(242), -score[q]))[:5])}
    got, jobs = jobs_of(spark, lambda: search.top_k_batch(corpus, asked, 5, digits=6, **sizes).collect())
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == wanted
    assert jobs < 50  # 240 queries in blocks of 7 would be twice as many passes over the rows at least


@pytest.mark.parametrize("sizes", [{}, {"block": 7}, {"block": 7, "page": 50}])
@pytest.mark.parametrize("tables", [3, 20])
def test_approximate_search_equals_all_pairs_of_the_cells_and_shuffles_none(spark, sizes, tables):
    corpus, asked, unit = odd_vectors(spark)
    rows = corpus.where("vec_id not in (7, 241)")
    df = search.top_k_ann(rows, asked.where("query_id <> 7"), 5, tables=tables, bits=4, digits=6, **sizes)
    planes = np.random.default_rng(3).normal(size=(tables, 4, 6))
    side = np.einsum("nd,tbd->ntb", unit, planes) >= 0
    near = (side[:, None] == side[None]).all(axis=3).any(axis=2)
    near[:, [7, 240, 241]] = False
    score = np.round(unit @ unit.T, 6) + 0.0
    wanted = set()
    for q in set(range(240)) - {7}:
        own = np.flatnonzero(near[q])
        wanted |= {(q, n + 1, int(i), score[q, i]) for n, i in enumerate(own[np.lexsort((own, -score[q, own]))][:5])}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()} == wanted
    assert "CoGroup" not in df._jdf.queryExecution().executedPlan().toString()


def test_other_modes_are_refused(spark):
    with pytest.raises(NotImplementedError):
        search.top_k(spark.range(1), [1.0], 1, mode="mmr")


def test_half_precision_round_trip():
    assert V.half(np.array([0.1], np.float32))[0] == np.float32(np.float16(0.1))


# ---- chunking ----


def test_a_long_unbroken_run_ends():
    tok = TX.RegexTokenizer()
    assert chunking.split_recursive("日" * 50, 1, tok) and chunking.split_recursive("-" * 50, 5, tok) == [("-" * 50, 50)]


def test_overlap_carries_the_last_pieces():
    pieces = [("a ", 1), ("b ", 1), ("c ", 1), ("d ", 1)]
    assert chunking.merge_pieces(pieces, 2, 1) == [("a b ", 2), ("b c ", 2), ("c d ", 2)]
    assert chunking.merge_pieces(pieces, 10, 1) == [("a b c d ", 4)] and chunking.merge_pieces([], 2, 1) == []


def test_chunks_keep_order_links_and_metadata(spark):
    nodes = S.text_nodes(spark.createDataFrame([("One two three. Four five six. Seven eight nine.", "p")], "t string, f string"), F.col("t"), S.metadata(file_path=F.col("f")))
    chunks = chunking.sentence_chunks(nodes, SplitterConfig(chunk_size=8, chunk_overlap=0))
    got = chunks.orderBy("ord").collect()
    assert "".join(r["text"] for r in got) == "One two three. Four five six. Seven eight nine."
    assert len(got) > 1 and {r["metadata"]["file_path"] for r in got} == {"p"} and {r["ref_doc_id"] for r in got} == {nodes.first()["node_id"]}
    kinds = chunking.links(chunks, nodes).groupBy("rel").count().collect()
    assert {r["rel"]: r["count"] for r in kinds} == {"SOURCE": len(got), "PREVIOUS": len(got) - 1, "NEXT": len(got) - 1}


def test_metadata_without_room_passes_the_node(spark):
    nodes = S.text_nodes(spark.createDataFrame([("Small text.", "word " * 50)], "t string, f string"), F.col("t"), S.metadata(file_path=F.col("f")))
    assert rows(chunking.sentence_chunks(nodes, SplitterConfig(chunk_size=5, chunk_overlap=1)).select("text", "ref_doc_id", "ord")) == [("Small text.", None, None)]


def test_semantic_shift_is_the_largest_distance(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])], "doc_id int, pos int, embedding array<double>")
    got = [r["dist"] for r in chunking.semantic_distances(df).orderBy("pos").collect()]
    assert got == pytest.approx([0.0, 1.0, 0.0])
    ids = chunking.semantic_chunk_ids(df, chunking.semantic_distances(df), percent=50.0)
    assert [r["chunk"] for r in ids.orderBy("pos").collect()] == [0, 0, 1, 1]
    ids = chunking.semantic_chunk_ids(df, chunking.semantic_distances(df))
    assert [r["chunk"] for r in ids.orderBy("pos").collect()] == [0, 0, 0, 0]  # of few distances the threshold is the largest, and none exceeds it
    capped = chunking.semantic_chunk_ids(df, chunking.semantic_distances(df), most=2)
    assert [r["chunk"] for r in capped.orderBy("pos").collect()] == [0, 0, 1, 1]
    with pytest.raises(ValueError):
        chunking.semantic_distances(df, buffer=0)


def test_wider_buffers_average(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])], "doc_id int, pos int, embedding array<double>")
    got = [r["dist"] for r in chunking.semantic_distances(df, buffer=2).orderBy("pos").collect()]
    mean = lambda *v: np.mean(np.array(v), axis=0)
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    assert got == pytest.approx([1 - cos(np.array([1.0, 0.0]), mean([0, 1], [1, 1])), 1 - cos(mean([1, 0], [0, 1]), np.array([1.0, 1.0]))])


def test_percentile_takes_a_rank_and_never_interpolates(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(chunking.percentile_by_rank(F.col("v"), 95.0)).collect()] == [3.0, 0.5]


# ---- packing, models, evaluation ----


def test_packing_allows_one_oversize_text(spark):
    df = spark.createDataFrame([([40, 60, 5], ["a", "b", "c"])], "n array<int>, t array<string>")
    assert df.select(synthesis.pack(F.col("n"), F.col("t"), 0, 0, 50)).first()[0] == ["a", "b", "c"]
    assert df.select(synthesis.pack(F.col("n"), F.col("t"), 0, 0, 65)).first()[0] == ["a", "b\n\nc"]


def test_answers_see_all_texts_and_queries_without_context_get_a_fixed_reply(spark):
    queries = spark.createDataFrame([(1, "q"), (2, "none")], "query_id int, query string")
    found = spark.createDataFrame([(1, 1, "a " * 40, 1.0), (1, 2, "b " * 60, 0.5)], "query_id int, rank int, text string, score double")
    out = {r["query_id"]: r for r in synthesis.query_engine(queries, lambda q: found, [], models.Echo(), SynthesizerConfig(100, 10)).collect()}
    assert "a a" in out[1]["answer"] and "b b" in out[1]["answer"] and out[1]["n_calls"] == 2
    assert out[2]["answer"] == synthesis.NOTHING


def test_a_prompt_is_sent_once(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "p string")
    out, new = models.complete_once(df, "p", models.Fixed("r"))
    assert out.where("reply = 'r'").count() == 3 and new.count() == 2
    out, again = models.complete_once(df, "p", models.Fixed("s"), memo=new)
    assert again.count() == 0 and {r["reply"] for r in out.collect()} == {"r", None}


def test_failing_models_give_nulls_or_fail(spark):
    class Broken:
        def complete(self, prompt):
            raise OSError("no model")

    df = spark.createDataFrame([("x",)], "p string")
    assert models.complete(df, "p", Broken(), errors="null").first()["reply"] is None
    with pytest.raises(Exception, match="no model"):
        models.complete(df, "p", Broken()).collect()


def test_embedder_is_deterministic_and_batched(spark):
    df = spark.createDataFrame([("a b",), (None,), ("a b",)], "t string")
    got = [r["embedding"] for r in models.embed(df, "t", models.HashedBag(16), batch=2).collect()]
    assert got[0] == got[2] and sum(x * x for x in got[0]) == pytest.approx(1.0) and not any(got[1])


def test_grades(spark):
    replies = ['{"score": 0.9, "feedback": "f", "passing": true}', "Score = 0.8", "} {", '{"score": "x"}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").orderBy("i")
    faithful = [tuple(r["x"]) for r in df.select(evaluation.parse_faithfulness(F.col("r")).alias("x")).collect()]
    assert faithful == [(0.9, "f", True), (0.8, "Score = 0.8", True), (0.0, "} {", False), (0.0, "", False), (0.0, "", False)]
    relevant = [r["x"]["passing"] for r in df.select(evaluation.parse_relevancy(F.col("r")).alias("x")).collect()]
    assert relevant == [True, False, False, False, False]


def test_strata_take_numbers_alone(spark):
    df = spark.createDataFrame([('{"confidence": 0.5, "importance": "high"}',), ("no",), (None,)], "r string")
    assert [tuple(r["s"]) for r in df.select(extraction.strata(F.col("r")).alias("s")).collect()] == [(0.5, None), (None, None), (None, None)]


def test_synthetic_triplets_need_a_query_and_choices(spark):
    good = '```json\n[{"query": "q", "parent_context": "p", "choices": ["a"], "selected_indices": [0]}, {"query": "", "choices": ["a"]}, {"query": "q", "choices": []}]\n```'
    got = export.synthetic_triplets(spark.createDataFrame([(good,), ("nonsense",)], "reply string")).collect()
    assert len(got) == 1 and got[0]["choices"] == ["a"]


# ---- trees ----


def leaves(spark, n, keys=("a", "b")):
    return spark.createDataFrame([(f"{k}{i}", k, i, f"text {k}{i}") for k in keys for i in range(n)], "node_id string, key string, ord int, text string")


def summary(prompt):
    return F.concat(F.lit("summary "), F.length(prompt).cast("string"))


def test_positions_of_a_large_key_and_of_null_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 7 == 0, F.col("id").cast("string").substr(1, 1)).when(F.col("id") % 11 > 0, "hot").alias("key"), (F.col("id") * 37 % 5000).alias("ord"))
    got: dict = {}
    for r in tree.positions(df, "key", "ord", stored).collect():
        got.setdefault(r["key"], []).append((r["ord"], r["position"]))
    assert sum(map(len, got.values())) == 5000 and None in got
    for rows in got.values():
        assert [p for _, p in sorted(rows)] == list(range(len(rows)))


def test_a_tree_of_two_sources_ends_with_two_roots(spark):
    nodes, edges = tree.build(leaves(spark, 7), summary, stored)
    assert sorted(r["count"] for r in nodes.groupBy("level").count().collect()) == [2, 4, 14]
    assert tree.roots(nodes, edges).count() == 2
    assert edges.count() == 14 + 4


def test_descending_selects_carries_and_stops(spark):
    nodes, edges = tree.build(leaves(spark, 7, ("a",)), summary, stored)
    start = tree.roots(nodes, edges).select(F.lit(0).alias("query_id"), "node_id")
    assert tree.descend(start, edges, tree.every_child, 5, stored).count() == 7
    assert rows(tree.descend(start, edges, tree.first_child, 5, stored).select("node_id")) == [("a0",)]
    assert tree.descend(start, edges, tree.every_child, 1, stored).count() == 2  # summaries, where the depth ends
    assert tree.descend(start, edges, lambda c: c.limit(0), 5, stored).count() == 0


def test_a_single_leaf_is_its_own_root(spark):
    nodes, edges = tree.build(leaves(spark, 1, ("a",)), summary, stored)
    assert nodes.count() == 1 and edges.count() == 0 and tree.roots(nodes, edges).count() == 1


def test_choices(spark):
    df = spark.createDataFrame([("0, 2, 2",), ("x,9, 1",), ("",)], "r string")
    assert [r[0] for r in df.select(tree.parse_choices(F.col("r"), F.lit(3))).collect()] == [[0, 2, 2], [1], []]


def test_the_perceptron_learns():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 6))
    y = (x[:, 0] > 0).astype(float)
    model = tree.Perceptron(2, seed=2, hidden=(32, 16))
    losses = model.fit(x, y, steps=150, rate=5e-3)
    assert losses[-1] < 0.5 * losses[0] and ((model.forward(x) > 0.5) == y).mean() > 0.9


# ---- ingestion ----


def test_known_rows_are_skipped_and_changed_ones_come_again(spark):
    nodes = S.text_nodes(spark.createDataFrame([("a", "en"), ("a", "en"), ("b", "fr")], "t string, g string"), F.col("t"), S.metadata(genre=F.col("g")))
    fresh, hashes = ingest.run(nodes, [])
    assert fresh.count() == 2
    assert ingest.run(nodes, [], cache=hashes)[0].count() == 0
    changed = S.text_nodes(spark.createDataFrame([("a", "de")], "t string, g string"), F.col("t"), S.metadata(genre=F.col("g")))
    assert ingest.run(changed, [], cache=hashes)[0].count() == 1


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k int, v string, at int")
    assert rows(ingest.upsert(old, new, "k", order="at"), "k") == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(ingest.upsert(old, new.where("at = 1").select("k", "v"), "k", allow_update=False), "k") == [(1, "a"), (2, "b"), (3, "z")]


def test_sql_functions(spark):
    from quernstone.functions import sql

    assert "cosine" in sql.register(spark)
    got = spark.sql("SELECT cosine(array(3D, 4D), array(6D, 8D)), cosine(array(0D), array(1D)), cosine(array(1D), array(1D, 2D)), decay(999), rank_share(1), dot_product(array(1D, 2D), array(3D, 4D)), content_id('a')").first()
    assert tuple(got)[:6] == pytest.approx((1.0, 0.0, 0.0, 0.98**180, 1 / 61, 11.0))
    assert got[6] == "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
