"""Every registered query against its SQL, and the driver's contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from quernstone.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, sf_dir, agrees, name):
    agrees(catalog.QUERIES[name](spark, sf_dir), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_registries_fit_together():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry_gives_the_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "source", "score"]


def test_approximate_search_recall(spark, sf_dir):
    exact = {(r["query_id"], r["vec_id"]) for r in catalog.vector_topk_batch(spark, sf_dir).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in catalog.vector_topk_ann(spark, sf_dir).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_scan_is_pruned_and_pushed_down(spark, sf_dir):
    df = catalog.docs(spark, sf_dir).where("lang = 'en'").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan and "EqualTo(lang,en)" in plan


def test_single_query_top_k_keeps_k_rows_by_task(spark, sf_dir):
    assert "TakeOrderedAndProject" in catalog.vector_topk(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
