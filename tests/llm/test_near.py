"""Near copies by the exact similarity of shingle sets."""

from __future__ import annotations

import random

import numpy as np

from quernstone.llm import simhash


def pair(rng, shared, a, b):
    """Two texts that share ``shared`` shingles and have ``a`` and ``b`` of their own: a common start and other ends."""
    word = lambda: f"w{rng.randrange(10**9)}"
    start = [word() for _ in range(shared + 4)]
    return [" ".join(start + [word() for _ in range(n)]) for n in (a, b)]


def kept(spark, pairs):
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in simhash.keep_one(df).collect()}


def test_both_sides_of_the_threshold(spark):
    rng = random.Random(3)
    alike = [pair(rng, 80 * m, 10 * m, 10 * m) for m in range(1, 8) for _ in range(30)] + [pair(rng, 4 * m, m, 0) for m in range(1, 101) for _ in range(2)]
    apart = [pair(rng, 80 * m - 1, 10 * m, 11 * m) for m in range(1, 8) for _ in range(30)] + [pair(rng, 4 * m, m + 1, 0) for m in range(1, 101)]
    got = kept(spark, alike + apart)
    ones = {i for i in range(len(alike)) if 2 * i + 1 in got}
    assert all(2 * i in got for i in range(len(alike) + len(apart))) and not ones
    assert all(2 * i + 1 in got for i in range(len(alike), len(alike) + len(apart)))


def test_how_often_a_shingle_stands_in_a_text_does_not_matter(spark):
    a, b = pair(random.Random(5), 60, 3, 3)
    assert kept(spark, [(a, b + (" " + b.rsplit(" ", 6)[-1]) * 400)]) == {0}


def test_chunks_of_a_component_lose_no_pair(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(204)]
    rows = [(i, " ".join(words[:-1] + [f"end{i}"])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in simhash.keep_one(df, chunk_texts=8).collect()] == [0]


def test_forests_join_what_brute_force_joins():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 14, 9)).astype(np.uint64) for _ in range(60)] + [np.empty(0, np.uint64)]
    near = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    pairs = [(i, j) for i in range(61) for j in range(i) if near(sets[i], sets[j])]
    edges = simhash.alike(sets, (4, 5))
    assert all(near(sets[a], sets[b]) for a, b in edges)
    up = list(range(61))
    for a, b in edges:
        assert up[a] != up[b]  # a forest
        up = [up[b] if x == up[a] else x for x in up]
    assert all(up[a] == up[b] for a, b in pairs)


def test_exact_candidates_and_the_grid_give_what_all_pairs_give(spark):
    rng = random.Random(12)
    shared = [f"s{i}" for i in range(60)]  # a passage that many texts have
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))] + (shared if rng.random() < 0.4 else [])
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += ["", None, "  "]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = sets[i] | sets[j]
            if 5 * len(sets[i] & sets[j]) >= 4 * len(union):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for more in ({"exact": True}, {}):
        got = simhash.near(df, "doc_id", "text", **{**simhash.NEAR, **more}).collect()
        assert {r["id"]: r["first_id"] for r in got} == dict(enumerate(label))
