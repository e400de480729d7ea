"""The metric tree and the fingerprint join against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from quernstone.llm import common, mtree, simhash


def brute_top(vecs, k):
    q = {i: np.floor(1024 * v).astype(np.int64) for i, v in vecs.items()}
    out = {}
    for i in (i for i in q if i % 100 == 0):
        best = sorted((-int(q[i] @ x), j) for j, x in q.items() if j != i)[:k]
        out[i] = [(j, -s) for s, j in best]
    return out


@pytest.mark.parametrize("kind", ["spread", "clustered", "ties", "equal"])
def test_the_tree_finds_the_exact_best(spark, kind):
    rng = np.random.default_rng(3)
    n, dim = 700, 12
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(9, dim))[rng.integers(0, 9, n)] + 0.02 * x
    if kind == "ties":
        x = np.round(x) / 4
    if kind == "equal":
        x[:] = x[0]
    vecs = dict(enumerate(x))
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in vecs.items()], "vec_id long, embedding array<double>").repartition(3)
    got: dict = {}
    for r in mtree.top_k(df, lambda i: i % 100 == 0, fan=4, page_rows=40, query_rows=3, sample_rows=100, held_pages=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(vecs, 10)


def test_bounds_avoid_most_computations_on_the_built_pages(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 5
    x = np.round((centres[rng.integers(0, 40, 6000)] + 0.05 * rng.normal(size=(6000, 8))) * 1024).astype(np.int64)
    square = float((x * x).sum(axis=1).max())
    data = common.stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<bigint>"), "vectors")
    pages = [mtree.opened(r.asDict(recursive=True), 8) for r in mtree.build(data, 8, square, fan=6, page_rows=100, sample_rows=300, part_rows=1000).collect()]
    # the tree: whole, of pages no larger than asked, deeper than its top, with radii and distances that hold
    assert sorted(i for p in pages for i in p["ids"].tolist()) == list(range(6000))
    assert max(p["n"] for p in pages) <= 100 and max(len(p["chain"]) for p in pages) >= 3
    for p in pages:
        points, above = mtree.lift(p["vecs"], square), None
        for link in p["chain"]:
            assert mtree.distances(points, link["routing"][None]).max() <= link["radius"] + 1e-3
            if above is not None:
                assert abs(mtree.distances(above[None], link["routing"][None])[0, 0] - link["parent"]) < 1e-3
            above = link["routing"]
    stats: dict = {}
    x = x.astype(np.float64)
    best = mtree.Best(np.arange(20), np.full(20, -np.inf), 10)
    mtree.Search(x[:20], square, best, stats).visit(pages)
    for q in range(20):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert sorted(best.score[best.q == q])[::-1] == sorted(scores)[::-1][:10]
    assert stats["computed"] < 0.3 * 20 * 6000


def test_equal_vectors_fill_several_pages(spark):
    data = common.stored(spark.createDataFrame([(i, [3, 4]) for i in range(500)], "vec_id long, vec array<bigint>"), "vectors")
    pages = mtree.build(data, 2, 25.0, fan=4, page_rows=100, sample_rows=100).collect()
    assert sum(p["n"] for p in pages) == 500 and len(pages) > 3


def brute_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = np.zeros(64, int)
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        ones += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps, distance):
    label = {i: i for i in fps}
    find = lambda i: i if label[i] == i else find(label[i])
    for a in fps:
        for b in fps:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in fps}


def test_groups_of_sample_documents_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.group(docs).collect()}
    labels = brute_components(fps, 3)
    assert got == {i: (fps[i], labels[i]) for i in fps}


@pytest.mark.parametrize("cell_points", [4, 2048])
def test_links_of_crowded_cells_lose_no_component(spark, cell_points):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (5, 8)).astype(np.uint8)
    fps = set()
    for _ in range(400):
        x = np.unpackbits(base[rng.integers(5)])
        x[rng.choice(64, rng.integers(0, 5), replace=False)] ^= 1
        fps.add(np.packbits(x).tobytes())
    fps = sorted(fps)
    df = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary").repartition(3)
    edges = [(bytes(r["a"]), bytes(r["b"])) for r in simhash.links(df, 64, 3, simhash.pigeonhole(64, 3, 3), cell_points=cell_points).collect()]
    number = {f: i for i, f in enumerate(fps)}
    assert all(bin(int.from_bytes(a) ^ int.from_bytes(b)).count("1") <= 3 for a, b in edges)
    label = list(range(len(fps)))

    def find(i):
        return i if label[i] == i else find(label[i])

    for a, b in edges:
        x, y = sorted((find(number[a]), find(number[b])))
        label[y] = x
    assert {i: find(i) for i in range(len(fps))} == brute_components({i: int.from_bytes(f) for i, f in enumerate(fps)}, 3)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(80)]
    rng = np.random.default_rng(1)
    names = rng.permutation(400)
    edges = spark.createDataFrame([(int(names[a]), int(names[b])) for a, b in chain], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    first, second = {int(names[i]) for i in range(61)}, {int(names[i]) for i in range(100, 181)}
    assert got == {**dict.fromkeys(first, min(first)), **dict.fromkeys(second, min(second))}


def test_popcounts_bound_the_distance():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 256, (500, 8)).astype(np.uint8) for _ in range(2))
    manhattan = np.abs(simhash.segment_counts(a) - simhash.segment_counts(b)).sum(axis=1)
    assert (manhattan <= np.unpackbits(a ^ b, axis=1).sum(axis=1)).all()


def test_near_copies_leave_one(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(60):
        text = [words[i] for i in rng.integers(0, 4000, 300)]
        rows.append((len(rows), " ".join(text)))
        for _ in range(3):
            copy = list(text)
            for at in rng.choice(300, 3, replace=False):
                copy[at] = words[rng.integers(4000)]
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == list(range(0, 240, 4))
