"""The dealt shards and the order within them, by hand from the splitting tree's quotas."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from quernstone.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 40, 700]))), "hot" if i % 3 else rng.choice(["a", "b", None])) for i in range(150)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def by_hand(docs, block_words, shards=16):
    """(id, epoch, block) to (shard, order): quotas as the drawn blocks count them, ranks by the permutation's hash."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    texts = {r["doc_id"]: md5(r["text"])[:16] for r in docs.collect()}
    number = lambda seed, e, i, b: int(md5(f"{seed}:{e}:{i}:{texts[i]}:{b}")[:15], 16)
    goal = {r["_source"]: (r["source_size"], r["target"]) for r in mixing.mix(docs, block_words=block_words)[1].collect()}
    blocks = defaultdict(list)
    for r in docs.collect():
        n = len(r["text"].split())
        for e in (0, 1):
            blocks[r["source"], e] += [(number(7, e, r["doc_id"], b), r["doc_id"], e, b, min(block_words, n - b * block_words)) for b in range(-(-n // block_words))]
    drawn = {}
    for (source, e), found in blocks.items():
        size, target = goal[source]
        total, drawn[source, e] = 0, []
        for x in sorted(found):
            total += x[-1]
            if 2 * total - x[-1] <= 2 * min(max(target - e * size, 0), size):
                drawn[source, e].append(x)
    keys = sorted((k for k in drawn if drawn[k]), key=lambda k: (k[0] is None, k[0] or "", k[1]))
    parts, out, at = mixing.split([len(drawn[k]) for k in keys], shards, 7), {}, [0] * len(keys)
    for shard, part in enumerate(parts):
        for i, (k, n) in enumerate(zip(keys, part, strict=True)):
            for _, doc, e, b, _ in drawn[k][at[i] : at[i] + n]:
                out[doc, e, b] = (shard, number(8, e, doc, b))
            at[i] += n
    return out


def test_each_shard_holds_what_the_split_gives_it(docs):
    wanted = by_hand(docs, 256)
    assert {(r["_id"], r["epoch"], r["block"]): (r["shard"], r["order"]) for r in mixing.mix(docs)[2].collect()} == wanted
    shards = defaultdict(lambda: defaultdict(int))
    for (doc, _, _), (shard, _) in wanted.items():
        shards[doc][shard] += 1
    got = {r["doc_id"]: (r["shards"], r["dealt"]) for r in mixing.report(docs).collect() if r["shards"]}
    assert got == {d: (len(s), ",".join(f"{k}:{n}" for k, n in sorted(s.items()))) for d, s in shards.items()}


def test_the_mix_stands_by_shard_and_in_the_shard_s_order(docs, tmp_path):
    wanted = by_hand(docs, 1 << 30)
    order = [doc for (doc, _, _), _ in sorted(wanted.items(), key=lambda x: x[1])]
    assert [r["doc_id"] for r in mixing.repeated(docs).collect()] == order


def test_without_the_splitting_tree_the_result_is_another(docs, monkeypatch):
    report = lambda: sorted((r["doc_id"], r["dealt"]) for r in mixing.report(docs).collect())
    with_tree = report()
    monkeypatch.setattr(mixing, "split", lambda quotas, n, seed: [quotas] + [[0] * len(quotas)] * (n - 1))
    assert report() != with_tree


def test_the_query_s_plan_holds_the_shards(docs):
    assert "shard" in mixing.report(docs)._jdf.queryExecution().optimizedPlan().toString()
