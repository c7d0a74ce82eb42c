"""Exact top-k search by inner product with a pivot table.

Distances of every vector to PIVOTS pivots are computed once. By the triangle inequality the
distance of query and candidate is at least the largest difference of their distances to a
pivot, and with it |q|^2 + |x|^2 - d^2 = 2 q.x bounds the score from above. Candidates lie in
blocks of vectors with the same nearest pivot and like distances to it; a block keeps the least
and largest distance to every pivot, so one table of queries and blocks holds the maximum lower
bounds. GROUP adjacent queries, which lie near each other, take the blocks in the order of their
own bounds, and stop at the first that none of them can use.

Of an opened block each candidate is bounded on its own by its distances to the TRIED pivots
that tell the group and the block apart best. A query and a candidate whose bound lies below the
query's k-th score so far don't meet; the queries and candidates that are left are evaluated as
one matrix product, and what ties with the k-th score is kept. A query starts with the k-th
score among SAMPLE vectors. A task computes the distances of a block's vectors when it opens
the block, which costs one part in CHUNK / PIVOTS of the products and saves moving them.

A task searches CHUNK queries in one stripe of STRIPE blocks; both are fixed numbers of rows,
so its memory does not depend on the table. Only the k best of each query and stripe leave it.

The driver holds at most SAMPLE vectors of each of the LENGTHS commonest vector lengths, from
which pivots far apart are chosen; vectors of other lengths are compared without bounds.

Components are turned into floor(scale * x). Defined cases: a vector that is null or holds a
null or non-finite component takes no part, nor does one without an id; components beyond 2^62
count as 2^62 and scores beyond 64 bits as the nearest long, in results, ranks and ties alike;
vectors of different length are not compared; rows with equal ids are different candidates;
scores that tie go to the smaller id; empty tables give no rows; columns other than vec_id and
embedding are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch
from corpusloom.llm.vectors import LONG, integer_vectors, products, stacked

PIVOTS = 64
SAMPLE = 1024
LENGTHS = 16
BLOCK = 512
STRIPE = 16
CHUNK = 4096
GROUP = 256
TRIED = 8

Sample = tuple[np.ndarray, np.ndarray]  # uids and vectors
Far = tuple[np.ndarray, np.ndarray]  # least and largest distances to the pivots


def far_apart(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to ``count`` different vectors, each the farthest from those before it."""
    if not len(vectors):
        return vectors
    v = vectors.astype(np.float64)
    apart, chosen = ((v - v.mean(axis=0)) ** 2).sum(axis=1), []
    while len(chosen) < count and (not chosen or apart.max() > 0):
        chosen.append(int(apart.argmax()))
        now = ((v - v[chosen[-1]]) ** 2).sum(axis=1)
        apart = np.minimum(apart, now) if len(chosen) > 1 else now
    return vectors[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, pivots): what the Euclidean distances are at least and at most, as floats round."""
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    both = (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None]
    far = np.sqrt(np.maximum(both - 2 * (x @ p.T), 0))
    error = 1e-14 * x.shape[1] * both + 1e-300
    error = error / np.maximum(far, np.sqrt(error))
    return far - error, far + error


def _narrow(v: np.ndarray) -> np.ndarray:
    """The same integers in the fewest bytes each."""
    low, high = int(v.min(initial=0)), int(v.max(initial=0))
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _wide(raw: bytes, rows: int, dim: int) -> np.ndarray:
    size = len(raw) // (rows * dim) if rows * dim else 8
    return np.frombuffer(raw, f"<i{size}").astype(np.int64).reshape(rows, dim)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _placer(samples: dict[int, Sample], pivots: dict[int, np.ndarray], k: int):
    """Vectors with their nearest pivot, the distance to it, and for queries the score to beat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch[dims == dim]
                x = stacked(rows["v"], dim)
                near, away, floor = np.zeros(len(rows), np.int32), np.zeros(len(rows)), np.full(len(rows), None, object)
                if dim in pivots:
                    far, _ = distances(x, pivots[dim])
                    near, away = far.argmin(axis=1).astype(np.int32), far.min(axis=1)
                asks = np.flatnonzero(rows["asks"].to_numpy())
                if len(asks) and dim in samples and len(samples[dim][0]) > k:
                    uids, s = samples[dim]
                    scores = products(x[asks], s).astype(np.float64)
                    scores[rows["uid"].to_numpy()[asks][:, None] == uids[None]] = -np.inf
                    floor[asks] = np.nextafter(_kth(scores, k), -np.inf)
                yield pd.DataFrame({
                    "uid": rows["uid"], "vec_id": rows["vec_id"], "dim": rows["dim"], "asks": rows["asks"], "near": near, "away": away,
                    "floor": pd.array(floor, "Float64"), "v": [r.tobytes() for r in _narrow(x)] if dim else [b""] * len(rows),
                })

    return run


_BLOCK_COLUMNS = "dim int, part long, rows int, uids binary, ids binary, vectors binary, floors binary, nearest binary, farthest binary, square double"


def _packer(pivots: dict[int, np.ndarray]):
    """Adjacent sorted vectors as blocks."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        dim = int(rows["dim"].iloc[0])
        x = np.concatenate([_wide(v, 1, dim) for v in rows["v"]])
        least, most = distances(x, pivots.get(dim, x[:0]))
        return pd.DataFrame([{
            "dim": dim, "part": int(rows["part"].iloc[0]), "rows": len(rows), "uids": rows["uid"].to_numpy(np.int64).tobytes(),
            "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "vectors": _narrow(x).tobytes(),
            "floors": rows["floor"].to_numpy(np.float64, na_value=-np.inf).tobytes(),
            "nearest": least.min(axis=0).tobytes(), "farthest": most.max(axis=0).tobytes(), "square": float((x.astype(np.float64) ** 2).sum(axis=1).max()),
        }])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if held is None else pd.concat((held, batch), ignore_index=True)
            edges = np.flatnonzero(np.diff(rows["dim"].to_numpy())) + 1
            held = None
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
                last = b == len(rows)
                for at in range(a, b, BLOCK):
                    if last and at + BLOCK > b:
                        held = rows.iloc[at:b]
                    else:
                        yield packed(rows.iloc[at : min(at + BLOCK, b)])
        if held is not None and len(held):
            yield packed(held)

    return run


def _least_score(apart: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The highest score that vectors at least ``apart`` from each other can have; ``both``: their squares."""
    high = (both - apart * apart) / 2 + 1e-9 * both + 1e-6  # the last two for rounding
    return np.maximum(high, float(LONG[0]))


def block_bounds(far: Far, square: np.ndarray, nearest: np.ndarray, farthest: np.ndarray, most: np.ndarray) -> np.ndarray:
    """(queries, blocks): no score of the block's vectors is higher, by the farthest of all pivots."""
    low, high = far
    apart = np.zeros((len(low), len(most)))
    for p in range(low.shape[1]):
        np.maximum(apart, nearest[None, :, p] - high[:, p, None], out=apart)
        np.maximum(apart, low[:, p, None] - farthest[None, :, p], out=apart)
    return _least_score(apart, square[:, None] + most[None])


def candidate_bounds(far: Far, square: np.ndarray, x_far: Far, x_square: np.ndarray) -> np.ndarray:
    """(queries, candidates): no score of the two is higher, by the pivots that tell both sets apart best."""
    (low, high), (x_low, x_high) = far, x_far
    apart = np.zeros((len(low), len(x_low)))
    gap = np.abs(low.mean(axis=0) - x_low.mean(axis=0)) + low.std(axis=0) + x_low.std(axis=0)
    for p in np.argsort(-gap)[:TRIED]:
        np.maximum(apart, low[:, p, None] - x_high[None, :, p], out=apart)
        np.maximum(apart, x_low[None, :, p] - high[:, p, None], out=apart)
    return _least_score(apart, square[:, None] + x_square[None])


class Block:
    """Candidates; their distances to the pivots are computed when they are first met."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray | None):
        self.uids, self.ids, self.x = uids, ids, x
        self.square = (x.astype(np.float64) ** 2).sum(axis=1)
        self._pivots, self._far = pivots, None

    def far(self) -> Far:
        if self._far is None:
            self._far = distances(self.x, self.x[:0] if self._pivots is None else self._pivots)
        return self._far


def _search_group(q_uids, q, far, square, floors, bounds, blocks: list[Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    place, ids, scores, evaluated = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for b in np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable"):
        block = blocks[b]
        open_ = np.flatnonzero(bounds[:, b] >= floors)
        if not len(open_):
            if bounds[:, b].max() < floors.min():
                break
            continue
        can = candidate_bounds((far[0][open_], far[1][open_]), square[open_], block.far(), block.square) >= floors[open_, None]
        left, cols = np.flatnonzero(can.any(axis=1)), np.flatnonzero(can.any(axis=0))
        if not len(left):
            continue
        open_, can = open_[left], can[np.ix_(left, cols)]
        got = products(q[open_], block.x[cols]).astype(np.int64)
        evaluated += got.size
        can &= q_uids[open_][:, None] != block.uids[cols][None]
        least, new = floors[open_], np.isneginf(floors[open_])
        if new.any() and len(cols) > k:
            some = got[new].astype(np.float64)
            some[~can[new]] = -np.inf
            least[new] = np.nextafter(_kth(some, k), -np.inf)
        row, col = np.nonzero((got >= least[:, None]) & can)
        if not len(row):
            continue
        place, ids = np.concatenate((place, open_[row])), np.concatenate((ids, block.ids[cols][col]))
        scores = np.concatenate((scores, got[row, col]))
        order = np.lexsort((ids, ~scores, place))  # ~s falls as s rises and has no overflow
        place, ids, scores = place[order], ids[order], scores[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        full = rank == k - 1
        floors[place[full]] = np.maximum(floors[place[full]], np.nextafter(scores[full].astype(np.float64), -np.inf))
        place, ids, scores = place[rank < k], ids[rank < k], scores[rank < k]
    return place, ids, scores, evaluated


def search(q_uids, q, far, floors, bounds, blocks: list[Block], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query places, ids, scores) of the k best of each query, best first, and the pairs evaluated.

    far: the queries' distances to the pivots; the columns of ``bounds`` are in the order of blocks.
    """
    square = (q.astype(np.float64) ** 2).sum(axis=1)
    found = []
    for at in range(0, len(q), GROUP):
        own = slice(at, at + GROUP)
        place, *rest = _search_group(q_uids[own], q[own], (far[0][own], far[1][own]), square[own], floors[own].copy(), bounds[own], blocks, k)
        found.append((place + at, *rest))
    place, ids, scores, evaluated = zip(*found, strict=True) if found else ([np.zeros(0, np.int64)],) * 3 + ([],)
    return np.concatenate(place), np.concatenate(ids), np.concatenate(scores), sum(evaluated)


def _opened(frame: pd.DataFrame) -> list:
    return [
        (np.frombuffer(u, np.int64), np.frombuffer(i, np.int64), _wide(v, n, d))
        for u, i, v, n, d in zip(frame["uids"], frame["ids"], frame["vectors"], frame["rows"], frame["dim"], strict=True)
    ]


def _searcher(pivots: dict[int, np.ndarray], k: int):
    def run(asked: pd.DataFrame, stripe: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(stripe):
            return pd.DataFrame({"query_uid": [], "query_id": [], "vec_id": [], "score": []})
        dim = int(stripe["dim"].iloc[0])
        asks = _opened(asked)
        q_uids, q_ids, q = (np.concatenate([a[j] for a in asks]) for j in range(3))
        floors = np.concatenate([np.frombuffer(f, np.float64) for f in asked["floors"]])
        table = lambda c: np.array([np.frombuffer(r, np.float64) for r in stripe[c]]).reshape(len(stripe), -1)
        far = distances(q, pivots.get(dim, q[:0]))
        bounds = block_bounds(far, (q.astype(np.float64) ** 2).sum(axis=1), table("nearest"), table("farthest"), stripe["square"].to_numpy())
        blocks = [Block(*b, pivots.get(dim)) for b in _opened(stripe)]
        place, ids, scores, _ = search(q_uids, q, far, floors, bounds, blocks, k)
        return pd.DataFrame({"query_uid": q_uids[place], "query_id": q_ids[place], "vec_id": ids, "score": scores})

    return run


def _sampled(rows: DataFrame) -> dict[int, Sample]:
    """For each of the commonest lengths up to SAMPLE vectors, those with the least digests."""
    common = rows.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(LENGTHS)
    of = common.select(F.col("dim").alias("of"))
    nth = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("v"), "uid"))
    some = rows.join(F.broadcast(of), F.col("dim") == F.col("of")).withColumn("nth", nth).filter(F.col("nth") <= SAMPLE)
    found: dict[int, list] = {}
    for r in some.select("dim", "uid", "v").collect():  # at most LENGTHS * SAMPLE rows
        found.setdefault(r["dim"], []).append((r["uid"], r["v"]))
    return {d: (np.array([u for u, _ in f], np.int64), np.array([v for _, v in f], np.int64).reshape(len(f), d)) for d, f in found.items()}


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query row, against all other rows."""
    scratch = scratch or Scratch(embeddings.sparkSession, "topk")
    rows = integer_vectors(embeddings, scale, None, asks=F.coalesce(is_query, F.lit(False))).filter("vec_id is not null").withColumns({"uid": F.monotonically_increasing_id(), "dim": F.size("v")})
    rows = scratch.table(rows)
    samples = _sampled(rows)
    pivots = {d: far_apart(v) for d, (_, v) in samples.items() if d}
    placed = scratch.table(
        rows.mapInPandas(_placer(samples, pivots, k), "uid long, vec_id long, dim int, asks boolean, near int, away double, floor double, v binary")
    )
    order = ["dim", "near", "away", "uid"]

    def packed(df: DataFrame, name: str, blocks: int) -> DataFrame:
        """Blocks in the order of their vectors, ``blocks`` of them with one number ``name``."""
        df = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
        made = df.select("uid", "vec_id", "dim", "floor", "v", "part").mapInPandas(_packer(pivots), _BLOCK_COLUMNS)
        made = scratch.table(made.withColumn("block", F.monotonically_increasing_id()))
        # numbers run within a part, so no window holds more than a part's blocks
        nth = F.row_number().over(W.partitionBy("dim", "part").orderBy("block")) - 1
        numbered = made.select("block", F.concat_ws("/", "dim", "part", F.floor(nth / blocks)).alias(name))
        return made.join(numbered, "block")

    stripes = packed(placed, "stripe", STRIPE)
    asked = packed(placed.filter("asks"), "chunk", CHUNK // BLOCK)
    # every chunk meets every stripe of its length; both tables have one small row each
    chunks = asked.select("dim", "chunk").distinct().withColumnRenamed("dim", "q_dim")
    ways = scratch.table(stripes.select("dim", "stripe").distinct().join(chunks, F.col("dim") == F.col("q_dim")).select("stripe", "chunk"))
    left = asked.select("chunk", "dim", "rows", "uids", "ids", "vectors", "floors").join(ways, "chunk")
    right = stripes.select("stripe", "dim", "rows", "uids", "ids", "vectors", "nearest", "farthest", "square").join(ways, "stripe")
    found = left.groupBy("chunk", "stripe").cogroup(right.groupBy("chunk", "stripe"))
    found = found.applyInPandas(_searcher(pivots, k), "query_uid long, query_id long, vec_id long, score long")
    best = W.partitionBy("query_uid").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
