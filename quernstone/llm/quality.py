"""Quality classifier by positive-unlabelled learning with a non-negative risk.

Trusted texts are positives; all other text is a mixture of positives and
negatives in an unknown proportion.  The class prior is estimated from a
classifier of positives against unlabelled: over the best-scored share of held
positives, the ratio of unlabelled to positive tails, with a confidence margin,
bounds the prior from above, and its least value is taken (best-bin estimation).
A linear model is then fitted to the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with gradients that turn back the negative part where it falls below zero.

Features come from the bytes of the whole text: how often each class of
character follows each other class, and a few figures on words and lines.
Fitting reads at most ``sample`` rows of either kind, chosen by a hash of the
id; scoring is one narrow pass with a small broadcast model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CLASSES: dict[str, int] = {}


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for c in range(256):
        ch = chr(c)
        kind = "high" if c >= 128 else "vowel" if ch in "aeiou" else "lower" if ch.islower() else "upper" if ch.isupper() else "digit" if ch.isdigit() else "space" if ch == " " else "line" if ch in "\r\n" else ch if ch in ".,!?|&*$%#-_'\"" else "control" if c < 32 or c == 127 else "mark"
        out[c] = _CLASSES.setdefault(kind, len(_CLASSES))
    return out


_CLASS = _classes()
N_CLASSES = len(_CLASSES)
N_FEATURES = N_CLASSES * N_CLASSES + 8


def features(text: bytes | None) -> np.ndarray:
    """Float features of one text; of an empty one all zero."""
    out = np.zeros(N_FEATURES, np.float32)
    if not text:
        return out
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    if len(kinds) > 1:
        pairs = np.bincount(kinds[:-1] * N_CLASSES + kinds[1:], minlength=N_CLASSES * N_CLASSES)
        out[: N_CLASSES * N_CLASSES] = np.sqrt(pairs / (len(kinds) - 1))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = len(set(words))
    out[-8:] = (
        np.log1p(len(text)) / 10, lengths.mean() / 10, lengths.std() / 10, (lengths > 20).mean(), np.log1p(distinct) / np.log1p(n),
        len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)) / 10, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, n: int, steps: int, rate: float = 0.02) -> tuple[np.ndarray, float]:
    """Adam from zero; the last coordinate is the bias."""
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1)


def estimate_prior(p: np.ndarray, u: np.ndarray, margin: float = 0.1) -> float:
    """Share of positives in ``u`` by best-bin estimation on the odd rows, with a classifier fitted to the even ones."""
    if len(p) < 20 or len(u) < 20:
        return 0.5
    pf, uf, ph, uh = _with_one(p[::2]), _with_one(u[::2]), _with_one(p[1::2]), _with_one(u[1::2])

    def gradient(w: np.ndarray) -> np.ndarray:
        return -(pf.T @ _sigmoid(-(pf @ w))) / len(pf) + (uf.T @ _sigmoid(uf @ w)) / len(uf) + 1e-3 * w

    w, b = _descend(gradient, p.shape[1], 150)
    w = np.append(w, b)
    ps, us = np.sort(ph @ w), np.sort(uh @ w)
    tail_p = 1.0 - np.arange(len(ps)) / len(ps)
    tail_u = 1.0 - np.searchsorted(us, ps, "left") / len(us)
    slack = (np.sqrt(np.log(4 / margin) / 2 / len(us)) + np.sqrt(np.log(4 / margin) / 2 / len(ps))) * (1 + 0.01) / 1.01
    keep = tail_p > 0.05
    best = np.argmin((tail_u[keep] + slack) / tail_p[keep])
    return float(np.clip(tail_u[keep][best] / tail_p[keep][best], 0.02, 0.98))


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray, bool]:
    """The non-negative risk of weights ``w``, the gradient to descend along, and whether the negative part is below zero.

    Rows end with a 1 for the bias.  Where the part is below zero the gradient
    turns it back alone.
    """
    zp, zu = p @ w, u @ w
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    g_negative = (u.T @ _sigmoid(zu)) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
    value = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    if negative < 0:
        return value, -g_negative, True
    return value, -prior * (p.T @ _sigmoid(-zp)) / len(p) + g_negative, False


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 500, prior: float | None = None) -> Model:
    """Minimises the non-negative risk with the logistic loss; without positives or unlabelled rows every score is 1/2."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0, dtype=np.float64), unlabelled.std(axis=0, dtype=np.float64) + 0.02
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    prior = estimate_prior(p, u) if prior is None else prior
    p, u = _with_one(p), _with_one(u)

    def gradient(w: np.ndarray) -> np.ndarray:
        return risk(w, p, u, prior)[1] + 2e-4 * np.append(w[:-1], 0)

    w, b = _descend(gradient, p.shape[1] - 1, steps)
    return Model(mean, scale, w, b, prior)


def _sample(frame: DataFrame, id_col: str, text_col: str, n: int) -> np.ndarray:
    """Features of about ``n`` rows of ``frame``, chosen by a hash of id and text, and never more than 2 n: those of the smallest hashes."""
    total = frame.count()
    if not total:
        return np.zeros((0, N_FEATURES), np.float32)
    top = 1 << 30
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(top))
    chosen = frame if total <= n else frame.where(place < int(top * n / total))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([pa.array([features(t).tobytes() for t in b.column(0).cast(pa.binary()).to_pylist()], pa.binary()), b.column(1)], names=["x", "place"])

    rows = chosen.select(F.col(text_col).cast("string").alias("text"), place.alias("place")).mapInArrow(run, "x binary, place long").orderBy("place", "x").limit(2 * n).collect()
    # in an order of their own, so the same rows give the same model however they were dealt
    ordered = sorted((bytes(r["x"]) for r in rows), key=lambda x: hashlib.sha256(x).digest())
    return np.frombuffer(b"".join(ordered), np.float32).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 6000, folds: int = 3, held_fold: int = 1) -> Model:
    """A model from the rows whose crc32(id as text) mod ``folds`` isn't ``held_fold``: positives are those labelled 1, unlabelled all of them.

    ``sample`` bounds the positives and the unlabelled rows that are read to fit.
    An id that has several labels is a positive if one of them is 1.
    """
    own = docs.where(common.crc_bucket(id_col, folds) != held_fold).select(id_col, text_col)
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_label_id")).distinct()
    # the labelled ids are cut down by the same hash before they meet the texts
    positive = own.join(trusted, own[id_col] == trusted["_label_id"], "left_semi")
    n_trusted = trusted.where(common.crc_bucket("_label_id", folds) != held_fold).count()
    if n_trusted > sample:
        top = 1 << 30
        cut = F.pmod(F.xxhash64(F.col(id_col)), F.lit(top)) < int(top * sample / n_trusted)
        positive = own.where(cut).join(trusted.where(F.pmod(F.xxhash64(F.col("_label_id")), F.lit(top)) < int(top * sample / n_trusted)), own[id_col] == F.col("_label_id"), "left_semi")
    return fit(_sample(positive, id_col, text_col, 2 * sample), _sample(own, id_col, text_col, sample))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for each row, null and empty texts too; a column of that name is replaced.

    Columns pass unchanged; the text goes to the model and back in one narrow pass.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out_col.lower()])
    at, sent = kept.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                x = np.array([features(t) for t in s.column(at).cast(pa.binary()).to_pylist()], np.float32).reshape(-1, N_FEATURES)
                yield pa.record_batch([*s.columns, pa.array(sent.value.score(x), pa.float64())], names=[*s.schema.names, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{schema}, `{out_col}` double")


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    model = train(docs, labels, id_col, text_col, **more)
    slim = score(docs.select(id_col, text_col), model, text_col).drop(text_col)
    return slim.select(id_col, (common.crc_bucket(id_col, more.get("folds", 3)) == more.get("held_fold", 1)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns as they are, whatever their names.

    Null and empty texts are scored like any other; repeated rows are judged
    alike; an empty table stays empty.
    """
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **more))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for k in range(0, b.num_rows, 500):
                s = b.slice(k, 500)
                x = np.array([features(t) for t in s.column(at).cast(pa.binary()).to_pylist()], np.float32).reshape(-1, N_FEATURES)
                yield s.filter(pa.array(sent.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
