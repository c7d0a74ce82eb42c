"""Vector expressions over arrays of numbers, which stay in the JVM, and vectors of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def _places(words: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, sign) of each word, by its digest."""
    digests = [hashlib.md5(w.encode()).digest() for w in words]
    first, second = (np.array([d[k] for d in digests], dtype=np.int64) for k in (0, 1))
    return first % dim, np.where(second >> 4 < 8, 1.0, -1.0)


def hashed_vectors(texts: DataFrame, key: str, terms: Column, dim: int = 64) -> DataFrame:
    """(key, v): a term adds its count to the place that its digest names, or takes it away, as the digest says.

    Texts without terms have no row; rows of a key count together. ``dim`` is 256 at most. A row's
    vector is made where the row is read, so that only vectors are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(sizes)
            coded = lists.flatten().dictionary_encode()
            place, sign = _places(coded.dictionary.to_pylist(), dim)
            word, row = coded.indices.to_numpy(), np.repeat(np.arange(len(some)), sizes[some])
            v = np.bincount(row * dim + place[word], weights=sign[word], minlength=len(some) * dim)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(v))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), values], [key, "v"])

    told = texts.select(key, F.filter(terms, lambda t: t.isNotNull()).alias("terms"))
    one = told.mapInArrow(run, f"{key} {told.schema[key].dataType.simpleString()}, v array<double>")
    whole = one.groupBy(key).agg(*[F.sum(F.element_at("v", p + 1)).alias(f"v{p}") for p in range(dim)])
    return whole.select(key, F.array(*[f"v{p}" for p in range(dim)]).alias("v"))
