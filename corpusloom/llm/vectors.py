"""Integer vectors: rows that take part, their bytes, exact products.

Components are turned into floor(scale * x). A vector takes no part if it is null, holds a null
or non-finite component, or if the squares of its integers sum to more than MOST_SQUARE. By
Cauchy and Schwarz no inner product of two others, nor a part of one, leaves 60 bits, and no
squared distance 62, so 64-bit integers hold every score exactly.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_SQUARE = 2.0**60
MOST = 1 << 62
LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(embeddings: DataFrame, scale: int, most_square: float | None = MOST_SQUARE, **more: Column) -> DataFrame:
    """(vec_id, v, columns ``more``) of the rows whose vector takes part, v as array<bigint>.

    Without ``most_square`` the sum of squares has no bound and integers beyond MOST are given as MOST.
    """
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    extra = [c.alias(name) for name, c in more.items()]
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), *extra)
    rows = rows.filter(F.col("e").isNotNull() & F.forall("e", sound))
    rows = rows.withColumn("v", F.transform("e", lambda x: F.floor(x * float(scale))).cast("array<bigint>"))
    if most_square is None:
        rows = rows.withColumn("v", F.transform("v", lambda x: F.greatest(F.lit(-MOST), F.least(x, F.lit(MOST)))))
    else:
        rows = rows.filter(square <= most_square)
    return rows.select("vec_id", "v", *more)


def stacked(v: pd.Series, dim: int) -> np.ndarray:
    """Arrays of ``dim`` numbers each as one matrix."""
    return np.concatenate(v.to_list() or [np.zeros(0)]).astype(np.int64).reshape(len(v), dim)


def to_bytes(x: np.ndarray) -> list[bytes]:
    """Each row as 32-bit integers, which MOST_SQUARE fits into."""
    return [r.tobytes() for r in x.astype("<i4")]


def from_bytes(raw: Iterable[bytes], dim: int) -> np.ndarray:
    raw = list(raw)
    return np.frombuffer(b"".join(raw), "<i4").astype(np.int64).reshape(len(raw), dim)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q with those of x as exact floats or integers; beyond 64 bits the nearest long."""
    most = int(np.abs(q).max(initial=1)) * int(np.abs(x).max(initial=1)) * max(q.shape[1], 1)
    if most < 1 << 53:
        return q.astype(np.float64) @ x.astype(np.float64).T
    if most < 1 << 63:
        return q @ x.T
    # numbers of any size one by one, but for components that are far too large nobody gets here
    whole = q.astype(object) @ x.astype(object).T
    return np.maximum(np.minimum(whole, LONG[1]), LONG[0]).astype(np.int64).reshape(len(q), len(x))
