"""Vector arithmetic as Column expressions and as blocks of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; 0 where lengths differ, one is empty or one has no length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def cosine_to(v: Column, constant: list[float]) -> Column:
    """Cosine to one known vector, whose norm is computed once, when the plan is made."""
    length = float(np.sqrt(np.dot(constant, constant)))
    if not length:
        return F.lit(0.0)
    literal = F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in constant) + "]"), "array<double>")
    n = norm(v) * F.lit(length)
    return F.when((F.size(v) == len(constant)) & (n > 0), dot(v, literal) / n).otherwise(F.lit(0.0))


def mean(vectors: Column) -> Column:
    """Componentwise mean of an array of vectors of one length."""
    total = F.aggregate(
        F.slice(vectors, F.lit(2), F.greatest(F.size(vectors) - 1, F.lit(0))), doubles(F.element_at(vectors, 1)), lambda acc, v: F.zip_with(acc, doubles(v), lambda x, y: x + y)
    )
    return F.transform(total, lambda x: x / F.size(vectors))


def half(values: np.ndarray) -> np.ndarray:
    """Round trip through half precision, for stores that keep it."""
    return np.asarray(values, np.float16).astype(np.float32)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of doubles; a null list or one of another length becomes zeros, whose cosine is 0, and a null component 0."""
    lengths = np.diff(column.offsets.to_numpy())
    fits = (lengths == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    first, last = column.offsets[0].as_py(), column.offsets[-1].as_py()
    flat = column.values.slice(first, last - first).fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    if fits.all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    out[fits] = flat[np.repeat(fits, lengths)].reshape(-1, dim)
    return out


def unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=(n > 0) & np.isfinite(n))
