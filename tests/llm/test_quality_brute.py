"""The classifier's features, risk, gradient, prior and scores, each worked out another way: one number at a time."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from quernstone.llm import quality

TEXTS = ["The cat sat.\nThe cat sat.\n\nOn the mat, 12 times!", "AAA aaa  a\t!", "été 漢字 *** 9", "x", "word " * 50, "averyveryverylongwordindeed ok ok"]


def class_of(c: int) -> str:
    ch = chr(c)
    if c >= 128:
        return "high"
    for name, test in (("vowel", ch in "aeiou"), ("lower", "a" <= ch <= "z"), ("upper", "A" <= ch <= "Z"), ("digit", "0" <= ch <= "9"), ("space", ch == " "), ("line", ch in "\r\n"), (ch, ch in ".,!?|&*$%#-_'\""), ("control", c < 32 or c == 127)):
        if test:
            return name
    return "mark"


def slow_features(text: bytes) -> list[float]:
    names = list(dict.fromkeys(class_of(c) for c in range(256)))
    n = len(names)
    out = [0.0] * (n * n + 8)
    for a, b in zip(text, text[1:], strict=False):
        out[names.index(class_of(a)) * n + names.index(class_of(b))] += 1
    out[: n * n] = [math.sqrt(x / max(1, len(text) - 1)) for x in out[: n * n]]
    words, lines = text.split(), text.split(b"\n")
    mean = sum(map(len, words)) / len(words)
    deviation = math.sqrt(sum((len(w) - mean) ** 2 for w in words) / len(words))
    repeats = sum(words[i] == words[i + 1] for i in range(len(words) - 1))
    out[-8:] = [
        math.log(1 + len(text)) / 10, mean / 10, deviation / 10, sum(len(w) > 20 for w in words) / len(words), math.log(1 + len(set(words))) / math.log(1 + len(words)),
        len(set(lines)) / len(lines), math.log(1 + len(text) / len(lines)) / 10, repeats / len(words),
    ]
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_features_equal_those_counted_one_by_one(text):
    assert quality.features(text.encode()) == pytest.approx(slow_features(text.encode()), abs=1e-6)


def slow_risk(w, p, u, prior):
    loss = lambda z: math.log1p(math.exp(-z)) if z > 0 else -z + math.log1p(math.exp(z))
    dot = lambda x: sum(a * b for a, b in zip(w, x, strict=True))
    positive = prior * sum(loss(dot(x)) for x in p) / len(p)
    negative = sum(loss(-dot(x)) for x in u) / len(u) - prior * sum(loss(-dot(x)) for x in p) / len(p)
    return positive, negative


@pytest.mark.parametrize("prior", [0.2, 0.9])
def test_risk_and_gradient_equal_sums_and_differences(prior):
    rng = np.random.default_rng(3)
    p, u = (quality._with_one(rng.normal(m, 1, (n, 4))) for m, n in ((0.8, 30), (0.1, 50)))
    kinds = set()
    for _ in range(30):
        w = rng.normal(0, 1.5, 5)
        value, gradient, below = quality.risk(w, p, u, prior)
        positive, negative = slow_risk(w, p, u, prior)
        assert value == pytest.approx(positive + max(0, negative)) and below == (negative < 0)
        for i in range(5):
            step = np.zeros(5)
            step[i] = 1e-5
            (p1, n1), (p0, n0) = slow_risk(w + step, p, u, prior), slow_risk(w - step, p, u, prior)
            wanted = -(n1 - n0) / 2e-5 if negative < 0 else (p1 + n1 - p0 - n0) / 2e-5
            assert gradient[i] == pytest.approx(wanted, abs=1e-6)
        kinds.add(below)
    assert (True if prior > 0.5 else False) in kinds


def test_fitting_lowers_the_risk_and_finds_the_prior():
    rng = np.random.default_rng(4)
    p, q = rng.normal(2, 1, (1500, 3)), rng.normal(-2, 1, (1500, 3))
    u = np.concatenate([rng.normal(2, 1, (600, 3)), q[:1400]])[rng.permutation(2000)]
    assert abs(quality.estimate_prior(p, u) - 0.3) < 0.08
    scale = lambda x: np.clip((x - u.mean(axis=0)) / (u.std(axis=0) + 0.02), -8, 8)
    model = quality.fit(p, u, steps=300)
    fitted, zero = (sum(slow_risk(w, quality._with_one(scale(p)), quality._with_one(scale(u)), model.prior)) for w in (np.append(model.weight, model.bias), np.zeros(4)))
    assert fitted < 0.5 * zero
    for x in (p[:20], q[:20]):
        by_hand = [1 / (1 + math.exp(-(sum(a * b for a, b in zip(r, model.weight, strict=True)) + model.bias))) for r in scale(x)]
        assert model.score(x) == pytest.approx(by_hand)
    assert (model.score(p) > 0.5).mean() > 0.95 and (model.score(q) < 0.5).mean() > 0.95


def test_the_report_equals_scores_by_hand(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "under", "old", "stone"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "CLICK", "!!!", "w1n", "|||"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 1) if i % 3], "doc_id long, quality int")
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    own = sorted((r for r in rows if fold(r[0]) != 1), key=lambda r: r[0])
    order = lambda x: sorted(x, key=lambda f: __import__("hashlib").sha256(f.tobytes()).digest())
    x = lambda some: np.array(order([quality.features((t or "").encode()) for _, t in some]), np.float32)
    model = quality.fit(x([r for r in own if r[0] < 400 and r[0] % 2 and r[0] % 3]), x(own))
    got = {r["doc_id"]: r for r in quality.report(docs, labels).collect()}
    for i, t in rows:
        score = float(model.score(quality.features((t or "").encode())[None])[0])
        assert got[i]["score"] == pytest.approx(score, abs=1e-9) and got[i]["predicted"] == int(score >= 0.5) and got[i]["held_out"] == (fold(i) == 1)
    assert sum(got[i]["predicted"] == i % 2 for i in range(400) if got[i]["held_out"]) >= 0.95 * sum(got[i]["held_out"] for i in range(400))
