"""Lloyd's clustering in integers, with annulus search for the nearest centroid.

The distance of a vector to the centroid that it had in the last round bounds its distance to
the nearest one from above (in the first round: to the centroid whose norm is next to its own).
By the triangle inequality a centroid that near has a norm within that bound of the vector's
norm. Centroids are sorted by norm, so those in the annulus are found by binary search; each of
them is compared exactly, ties at the edge included.

Vectors lie in a table as bytes, each with its centroid. A round is one pass over it that writes
the next table; the pass also writes one row of sums for each centroid and task, so the new
centroids cost no second pass over vectors. What reaches the driver is k rows of ``dim`` sums.

Defined cases: vectors.integer_vectors tells which vectors take part, those of other lengths
than ``dim`` don't; a vector without an id takes part and comes last among the first centroids;
equal ids tie by the bytes of
their integers; with fewer than k vectors there are as many centroids; equal
vectors are clustered alike; a centroid without vectors stays, one whose vector occurs twice
among the first goes by the smaller number; an empty table gives no rows; sums of distances
beyond 64 bits are given as the largest long; columns other than vec_id and embedding are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch
from corpusloom.llm.vectors import from_bytes, integer_vectors, products, stacked, to_bytes

MOST_LONG = (1 << 63) - 1
#: Rows of which sums of 31-bit components surely fit into a long.
SUMMED = 1 << 30

_STATE = "vec_id long, v binary, cluster int, distance long, sums array<long>"


class Centroids:
    """Centroids in order of their norms."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.square = (x * x).sum(axis=1)
        self.order = np.lexsort((np.arange(len(x)), self.square))
        self.norms = np.sqrt(self.square[self.order].astype(np.float64))

    def annulus(self, length: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end, among sorted norms, of what lies within ``bound`` of ``length``."""
        wide = bound + 1e-9 * (length + bound) + 1e-6  # roots are rounded
        return np.searchsorted(self.norms, length - wide, "left"), np.searchsorted(self.norms, length + wide, "right")

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row, and the pairs compared.

        before: each row's centroid of the last round, or -1.
        """
        square = (x * x).sum(axis=1)
        length = np.sqrt(square.astype(np.float64))
        at = np.clip(np.searchsorted(self.norms, length), 0, len(self.x) - 1)
        best = np.where(before < 0, self.order[at], before)
        least = square - 2 * np.einsum("ij,ij->i", x, self.x[best]) + self.square[best]
        low, high = self.annulus(length, np.sqrt(least.astype(np.float64)))
        for at, c in enumerate(self.order.tolist()):
            rows = np.flatnonzero((low <= at) & (at < high))
            if not len(rows):
                continue
            far = square[rows] - 2 * products(x[rows], self.x[c : c + 1])[:, 0].astype(np.int64) + self.square[c]
            better = (far < least[rows]) | ((far == least[rows]) & (c < best[rows]))
            best[rows[better]], least[rows[better]] = c, far[better]
        return best, least, int((high - low).sum())


def _packer(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": to_bytes(stacked(batch["v"], dim)), "cluster": -1})

    return run


def _assigner(x: np.ndarray, last: bool):
    """Rows with their nearest centroid; but for the last pass also rows (cluster, [count, sums...])."""
    k, dim = x.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, seen = Centroids(x), 0
        sums = np.zeros((k, dim + 1), np.int64)

        def told() -> pd.DataFrame:
            at = np.flatnonzero(sums[:, 0])
            return pd.DataFrame({"vec_id": pd.array([None] * len(at), "Int64"), "v": None, "cluster": at, "distance": pd.array([None] * len(at), "Int64"), "sums": list(sums[at])})

        for batch in batches:
            if not len(batch):
                continue
            rows = from_bytes(batch["v"], dim)
            best, least, _ = centroids.nearest(rows, batch["cluster"].to_numpy(np.int64))
            yield pd.DataFrame({"vec_id": batch["vec_id"], "v": None if last else batch["v"], "cluster": best, "distance": least, "sums": None})
            if last:
                continue
            if seen + len(batch) > SUMMED:
                yield told()
                sums[:], seen = 0, 0
            seen += len(batch)
            order = np.argsort(best, kind="stable")
            here, first = np.unique(best[order], return_index=True)
            sums[here, 0] += np.diff(np.append(first, len(best)))
            sums[here, 1:] += np.add.reduceat(rows[order], first, axis=0)
        if seen:
            yield told()

    return run


def _first(packed: DataFrame, k: int, dim: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest digests of salt and id."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = packed.select("vec_id", "v", digest.alias("digest"))
    rows = rows.orderBy(F.col("digest").asc_nulls_last(), F.col("v")).limit(k).collect()  # k vectors
    return np.array([np.frombuffer(r["v"], "<i4") for r in rows], np.int64).reshape(len(rows), dim)


def _moved(x: np.ndarray, state: DataFrame) -> np.ndarray:
    """Every non-empty centroid as the floor of its vectors' mean."""
    parts = state.filter("sums is not null").select("cluster", F.posexplode("sums").alias("at", "part"))
    whole = parts.groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("total"))
    sums = {}
    for r in whole.collect():  # k * (dim + 1) rows
        sums.setdefault(r["cluster"], {})[r["at"]] = int(r["total"])
    x = x.copy()
    for c, s in sums.items():
        x[c] = [s[j + 1] // s[0] for j in range(x.shape[1])]
    return x


def cluster(embeddings: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dim: int = 64, salt: str = "2:", scratch: Scratch | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    spark = embeddings.sparkSession
    scratch = scratch or Scratch(spark, "annulus")
    rows = integer_vectors(embeddings, scale).filter(F.size("v") == dim)
    state = scratch.table(rows.mapInPandas(_packer(dim), "vec_id long, v binary, cluster int"))
    x = _first(state, k, dim, salt)
    if not len(x):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        moved = scratch.table(state.select("vec_id", "v", "cluster").mapInPandas(_assigner(x, False), _STATE))
        scratch.drop(state)
        x, state = _moved(x, moved), moved
        state = moved.filter("sums is null")
        state._scratch_path = moved._scratch_path
    done = scratch.table(state.select("vec_id", "v", "cluster").mapInPandas(_assigner(x, True), _STATE).select("vec_id", "cluster", "distance"))
    scratch.drop(state)
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows
    least = lambda n: min(n, MOST_LONG)
    about = [(c, least(n), least(sum(inertia.values())), hashlib.sha256(",".join(map(str, x[c].tolist())).encode()).hexdigest()) for c, n in inertia.items()]
    table = spark.createDataFrame(about, "of int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(table), F.col("cluster") == F.col("of")).drop("of")  # k rows are broadcast
