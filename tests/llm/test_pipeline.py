"""The corpus pipeline: each stage against what its operator must do to that stage's own input."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from quernstone.llm import common, mixing


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), name)
        out.append((name, docs))
    return dict(out)


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns_pass(stages):
    for name in ("quality", "near_dedup", "decontamination", "mixing"):
        assert stages[name].columns == stages["documents"].columns
    assert stages["sharding"].columns == [*stages["documents"].columns, "slot", "shard", "shard_name"]


def test_filters_keep_part_of_what_they_get(stages):
    order = ["documents", "quality", "near_dedup", "decontamination"]
    for a, b in zip(order, order[1:], strict=False):
        assert set(ids(stages[b])) <= set(ids(stages[a])) and stages[b].count() > 0
        assert len(ids(stages[b])) == len(set(ids(stages[b])))


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_no_near_copies_stay_and_what_goes_has_one(stages):
    before = {r["doc_id"]: shingles(r["text"] or "") for r in stages["quality"].collect()}
    kept = set(ids(stages["near_dedup"]))
    alike = lambda a, b: len(a & b) / len(a | b)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(before[a], before[b]) >= 0.9]
    for gone in set(before) - kept:
        assert max(alike(before[gone], before[i]) for i in before if i != gone) >= 0.6


def test_no_benchmark_window_stays(spark, sf_dir, stages):
    from test_text_operators import brute_hits

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for r in stages["near_dedup"].collect():
        assert (r["doc_id"] in set(ids(stages["decontamination"]))) == (brute_hits(r["text"], items)[1] == 0)


def test_the_mix_and_its_shards(stages):
    goal = {r["_source"]: r["target"] for r in mixing.mix(stages["decontamination"], block_words=1 << 30)[1].collect()}
    largest = max(len((r["text"] or "").split()) for r in stages["decontamination"].collect())
    got: dict = {}
    for r in stages["mixing"].collect():
        got[r["source"]] = got.get(r["source"], 0) + len(r["text"].split())
    for source, target in goal.items():
        assert abs(got.get(source, 0) - target) <= largest
    by_id: dict = {}
    for r in stages["sharding"].collect():
        by_id.setdefault(r["doc_id"], set()).add(r["shard"])
    assert stages["sharding"].count() == stages["mixing"].count() and all(len(s) == 1 for s in by_id.values())


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda df: sorted((r["doc_id"], r["shard"]) for r in df.select("doc_id", "shard").collect())
    assert key(pipeline.run(spark, sf_dir)) == key(stages["sharding"])
