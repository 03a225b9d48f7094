"""Tables of vectors: what counts as one, and rows of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeframe.llm.store import written


def clean(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, embedding as array<double>) without repeated rows, and the largest number of dimensions.

    Null vectors, empty ones and those with a null, NaN or infinite element are left out. Where lengths
    differ, a shorter vector counts as having zeros at its end. -0.0 counts as 0.0. The table is written
    once, as what follows reads it several times.
    """
    # + 0.0 makes -0.0 the same as 0.0
    v = df.select(F.col(key).alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = written(v.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).distinct(), "vectors")
    return v, v.agg(F.max(F.size("embedding"))).first()[0] or 0


def some(v: DataFrame, queries: Column | None) -> DataFrame:
    """The vectors that are queries: all, or those that meet a condition on vec_id."""
    return v if queries is None else v.where(queries)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A column of lists as rows of `dim` numbers."""
    n = len(column)
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    size = np.diff(offsets)
    if (size == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    for i, (a, b) in enumerate(zip(offsets - offsets[0], offsets[1:] - offsets[0])):
        out[i, : b - a] = flat[a:b]
    return out


def binary(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, np.float64).tobytes()


def unbinary(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest scores and all that tie with the last; -inf never."""
    n, m = scores.shape
    if m > k:
        last = np.partition(scores, m - k, axis=1)[:, m - k]
        # sums in another order differ in the last bits
        floor = last - 1e-9 * np.maximum(1, np.abs(last))
    else:
        floor = np.full(n, -np.inf)
    return np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed in one order wherever the rows stand."""
    return (a * b).sum(axis=1)
