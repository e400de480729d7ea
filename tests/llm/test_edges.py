"""All operators over odd rows and empty tables: nothing crashes, no row is lost, and columns pass as they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quernstone.llm import ctw, decontaminate, mixing, mtree, placement, quality, secrets, simhash, surrogates, warc


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven", 1), (2, None, 1), (3, "", 1), (None, "seven eight", 1), (4, "seven eight", 1)], "item_id long, text string, doc_id int")


#: Operators that give a row for each row.
REPORTS = {
    "ctw": lambda d, s: ctw.score(d),
    "mixing": lambda d, s: mixing.report(d),
    "quality": lambda d, s: quality.report(d, s["labels"]),
    "simhash": lambda d, s: simhash.group(d),
    "surrogates": lambda d, s: surrogates.surrogate(d),
    "secrets": lambda d, s: secrets.scan(d),
    "decontaminate": lambda d, s: decontaminate.report(d, s["items"]),
    "placement": lambda d, s: placement.place(d, "doc_id", ["a", "b"], 7),
}
#: Operators that keep some rows with all their columns.
FILTERS = {
    "quality": lambda d, s: quality.accept(d, s["labels"]),
    "simhash": lambda d, s: simhash.keep_one(d),
    "decontaminate": lambda d, s: decontaminate.clean(d, s["items"]),
    "mixing": lambda d, s: mixing.repeated(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_have_a_row_for_each_row(odd, labels, items, name):
    got = REPORTS[name](odd, {"labels": labels, "items": items})
    ids = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())
    assert ids(got) == ids(odd)


@pytest.mark.parametrize("name", REPORTS)
def test_reports_of_an_empty_table_are_empty(none, labels, items, name):
    assert REPORTS[name](none, {"labels": labels, "items": items}).count() == 0


@pytest.mark.parametrize("name", FILTERS)
def test_filters_keep_columns_as_they_are(odd, labels, items, name):
    got = FILTERS[name](odd, {"labels": labels, "items": items})
    assert got.columns == odd.columns and got.dtypes == odd.dtypes
    assert got.exceptAll(odd.unionByName(odd)).count() == 0  # a mix repeats rows, twice at most


@pytest.mark.parametrize("name", FILTERS)
def test_filters_of_an_empty_table_are_empty(none, labels, items, name):
    got = FILTERS[name](none, {"labels": labels, "items": items})
    assert got.columns == none.columns and got.count() == 0


def test_no_items_and_no_labels(odd, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(odd, nothing).count() == odd.count()
    assert decontaminate.report(odd, nothing).where("contaminated").count() == 0
    unlabelled = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.report(odd, unlabelled).collect()} == {0.5}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (100, [5.0, 5.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, []), (6, [0.0, 0.0]), (7, [3.0]), (200, None)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score int")
    got = mtree.top_k(df, lambda i: i % 100 == 0, k=3).collect()
    assert {r["query_id"] for r in got} == {0, 100}
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(1, 100), (2, 100), (3, 7)]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 100] == [0, 7, 5]
    assert mtree.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_odd_pages(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "same"), (3, None, None), (4, "a\r\nb", ""), (5, "u", "x" * 3_000_000), (6, "é", "漢字\r\n\r\nbody"), (None, "u", "same"), (None, "u", "own")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, page string, payload int").repartition(2)
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()}
    assert {(1, 4, "response", None), (2, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 3_000_000, "response", None), (6, len("漢字\r\n\r\nbody".encode()), "response", None)} <= got
    assert warc.round_trip(df).count() == len(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_pages_that_repeat_an_id(spark):
    rows = [(1, "AAA"), (2, "BBB"), (7, "AAA"), (7, "CCC"), (8, "AAA"), (8, "BBB")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")).repartition(3)
    got = sorted((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    first = {"AAA": 1, "BBB": 2, "CCC": 7}
    assert got == sorted((i, warc.payload_digest(t.encode()), "response" if i == first[t] else "revisit", None if i == first[t] else first[t]) for i, t in rows)
    text_ids = spark.createDataFrame([("", "x", "u"), (None, "y", "u"), (" ", "x", "u")], "page_id string, html string, url string")
    assert {(r["page_id"], r["record_type"]) for r in warc.round_trip(text_ids).collect()} == {("", "response"), (None, "response"), (" ", "revisit")}


def test_null_texts_are_defined(odd, items):
    got = {r["doc_id"]: r for r in surrogates.surrogate(odd.where("doc_id < 4")).collect()}
    assert got[1]["text"] is None and got[2]["text"] == "" and not any(r["n_entities"] for r in got.values())
    group = {r["doc_id"]: r for r in simhash.group(odd).collect()}
    assert {group[i]["fingerprint"] for i in (1, 2, 3)} == {"0" * 16} and {group[i]["component_id"] for i in (1, 2, 3)} == {1}
    assert group[5]["component_id"] == group[6]["component_id"] == 5
    lm = {r["doc_id"]: r for r in ctw.score(odd).collect()}
    assert (lm[1]["n_tokens"], lm[1]["n_bytes"]) == (1, 0) and lm[1]["score"] == pytest.approx(lm[2]["score"])
    hit = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.report(odd, items).collect()}
    assert hit[1] == (0, 0, 0) and hit[5] == (11, 10, 3) and hit[6] == (11, 10, 3)


def test_a_null_source_is_a_source(odd):
    got = mixing.report(odd).where("doc_id = 1 or doc_id = 5").select("doc_id", "source_size").collect()
    assert len({r["source_size"] for r in got}) == 1
    assert mixing.report(odd).agg(F.max(F.col("taken") - 2 * F.col("size")).alias("x")).where("x > 0").count() == 0
