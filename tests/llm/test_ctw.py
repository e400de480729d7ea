"""Context-tree scores against a tree of dictionaries, byte by byte and bit by bit."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import ctw

TEXTS = ["Abracadabra abra", "the cat sat on the mat", "the CAT sat", "", None, "été à la plage", "aaaaaaaaaaaa", "the cat sat on the mat", "zyx"]
DEPTH = 3


def lower(t):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())


def is_held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


class Slow:
    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, Counter(), {}
        for t in texts:
            self.walk(t, self.see)

    def walk(self, text, f):
        data = bytes([ctw.END]) * self.depth + text + bytes([ctw.END])
        return [f(data[i - self.depth : i][::-1], data[i]) for i in range(self.depth, len(data))]

    def see(self, context, byte):
        for d in range(self.depth + 1):
            for b in range(8):
                self.counts[context[:d], b, byte >> (8 - b), (byte >> (7 - b)) & 1] += 1
                if d:
                    self.children.setdefault((context[: d - 1], b, byte >> (8 - b)), set()).add((context[:d], b, byte >> (8 - b)))

    def pair(self, node):
        return self.counts[*node, 0], self.counts[*node, 1]

    def kt(self, node):
        z, o = self.pair(node)
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(z + o + 1)

    def below(self, node):
        return sum(self.weighted(c) for c in self.children.get(node, ()))

    def weighted(self, node):
        return self.kt(node) if len(node[0]) == self.depth else np.logaddexp(self.kt(node), self.below(node)) - math.log(2)

    def predict(self, context, d, b, prefix, bit):
        node = (context[:d], b, prefix)
        z, o = self.pair(node)
        p = ((z, o)[bit] + 0.5) / (z + o + 1)
        if d == self.depth or sum(self.pair((context[: d + 1], b, prefix))) == 0:
            return p
        w = 1 / (1 + math.exp(-min(max(self.kt(node) - self.below(node), -40), 40)))
        return w * p + (1 - w) * self.predict(context, d + 1, b, prefix, bit)

    def score(self, text):
        one = lambda context, byte: sum(math.log10(self.predict(context, 0, b, byte >> (8 - b), (byte >> (7 - b)) & 1)) for b in range(8))
        return sum(self.walk(text, one))


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in ctw.score(df, depth=DEPTH, chunk_bytes=100).collect()}


def test_scores_are_those_of_the_whole_tree(scored):
    texts = [lower(t) for t in TEXTS * 3]
    slow = Slow([t for i, t in enumerate(texts) if not is_held(i)], DEPTH)
    for i, t in enumerate(texts):
        assert scored[i]["held_out"] == is_held(i)
        assert scored[i]["score"] == pytest.approx(slow.score(t), rel=1e-5)
        assert scored[i]["bits_per_byte"] == pytest.approx(-slow.score(t) / math.log10(2) / (len(t) + 1), rel=1e-5)


def test_unigram_base_scores(scored):
    tokens = [[*lower(t).split(), None] for t in TEXTS * 3]
    c = Counter(w for i, ts in enumerate(tokens) if not is_held(i) for w in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in enumerate(tokens):
        assert scored[i]["train_tokens"] == n and scored[i]["n_tokens"] == len(ts) and scored[i]["n_known"] == sum(c[w] > 0 for w in ts)
        assert scored[i]["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts))


def test_predictions_of_all_bytes_sum_to_one():
    slow = Slow([b"abcabc"], 2)
    total = sum(10 ** sum(math.log10(slow.predict(b"ba", 0, b, byte >> (8 - b), (byte >> (7 - b)) & 1)) for b in range(8)) for byte in range(256))
    assert total == pytest.approx(1.0)


@pytest.mark.parametrize("rows", [1, 50, 1 << 20])
def test_slices_give_the_nodes_of_the_whole(monkeypatch, rows):
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 101, 400).astype(np.uint8)) for _ in range(3)]
    keys, counts = ctw.gram_counts(texts, np.ones(3, bool), 4)
    whole = ctw.Second.of(keys, counts, 4)
    monkeypatch.setattr(ctw.slices, "__defaults__", (rows,))
    cut = ctw.slices(keys, 4)
    assert cut[0][0] == 0 and cut[-1][1] == len(keys) and all(a[1] == b[0] for a, b in zip(cut, cut[1:], strict=False)) and (rows > 1) == (len(cut) < 40)
    part = ctw.Second.frombytes(ctw.Second.of(keys, counts, 4).tobytes())
    for name in ("names", "zeros", "ones", "children", "kt"):
        assert getattr(part, name) == pytest.approx(getattr(whole, name))


def test_merging_in_steps_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 4)), "doc_id long, text string")
    key = lambda d: {r["doc_id"]: (r["score"], r["base_score"]) for r in d.collect()}
    one = key(ctw.score(df, depth=3, chunk_bytes=60))
    monkeypatch.setattr(ctw, "FAN_IN", 2)
    assert key(ctw.score(df, depth=3, chunk_bytes=60)) == {i: pytest.approx(v) for i, v in one.items()}


def test_shards_that_answer_in_several_tasks_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 12)), "doc_id long, text string")
    key = lambda d: {r["doc_id"]: (r["score"], r["base_score"]) for r in d.collect()}
    one = key(ctw.score(df, depth=3, chunk_bytes=60))
    monkeypatch.setattr(ctw, "SHARD_PARTS", 0)  # all slices are worked out apart
    monkeypatch.setattr(ctw, "TASK_BYTES", 1)
    stored, seen = ctw.common.stored, {}
    monkeypatch.setattr(ctw.common, "stored", lambda frame, name: seen.setdefault(name, stored(frame, name)))
    assert key(ctw.score(df, depth=3, chunk_bytes=60)) == {i: pytest.approx(v) for i, v in one.items()}
    assert seen["ctw-tasks"].where("tasks > 1").count() > 0


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    keys, counts = np.unique(rng.integers(0, 1 << 56, 1000).astype(np.uint64)), rng.integers(0, 1 << 40, 1000)
    for n in (0, 1, len(keys)):
        got = ctw.unpack(ctw.pack(keys[:n], counts[:n]))
        assert (got[0] == keys[:n]).all() and (got[1] == counts[:n]).all()
        assert (ctw.unpack_numbers(ctw.pack_numbers(counts[:n])) == counts[:n]).all()
        logs = -rng.exponential(1, n)
        assert ctw.unpack_logs(ctw.pack_logs(logs)) == pytest.approx(logs, rel=2**-16)
    for texts in ([], [b""], [b"a", b"", b"bcd"]):
        assert ctw.unpack_texts(ctw.pack_texts(texts)) == texts


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_grams_of_all_positions_in_any_blocks(block):
    texts = [b"abcd", b"", b"xy"]
    got = np.concatenate(list(ctw.grams(texts, 3, block))).tolist()
    wanted = []
    for t in texts:
        data = bytes([ctw.END]) * 3 + t + bytes([ctw.END])
        wanted += [int.from_bytes(data[i - 3 : i][::-1] + data[i : i + 1]) for i in range(3, len(data))]
    assert got == wanted


def test_kt_of_large_counts():
    z, o = np.array([0, 3, 20_000, 5_000_000]), np.array([0, 2, 7, 5_000_001])
    wanted = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1) for a, b in zip(z.tolist(), o.tolist(), strict=True)]
    assert ctw.log_kt(z, o) == pytest.approx(wanted, rel=1e-9)


@pytest.mark.parametrize("depth", [2, 7])
def test_depth_is_bounded(spark, depth):
    with pytest.raises(ValueError):
        ctw.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), depth=depth)
