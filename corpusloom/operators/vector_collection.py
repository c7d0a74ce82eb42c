"""A collection of vectors in Parquet, partitioned by the lists of a coarse quantiser.

k-means over unit vectors gives the lists' centres: each round is one pass that sends a row of
sums for each list and task. A batch of vectors is written with one folder a list. A row in
``log`` makes a batch live and is written last. Deletes write tombstones: ids that are dead in
every batch before them, so nothing is rewritten; vectors that come again are added later.

A search takes the lists whose centres are nearest to a query and reads only their folders.
Rows of a list are dealt over pieces of about PIECE, so a large list isn't one task; queries
come in chunks of CHUNK, and a task keeps the k best of each query of a chunk in a piece. With
all lists probed the search is exact. ``probes_for`` finds the fewest probes that reach a
wanted recall on a sample of queries.

Defined cases: null vectors, those with null or non-finite components, of norm 0 or of another
length than the centres are left out; similarities are rounded to six digits and ties go to the
smaller id; a query doesn't find the row of its own id.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

PIECE = 1 << 14
CHUNK = 512

_ROWS = "chunk_id long, v array<double>, batch string, list int"
_LOG = "seq int, batch string, kind string, rows long"


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        x = lists.flatten().to_numpy(zero_copy_only=False)  # null components are NaN
        row = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt(np.bincount(row, weights=x * x, minlength=len(sizes)))  # squares add up in order
            good = (np.bincount(row, weights=~np.isfinite(x), minlength=len(sizes)) == 0) & (norm > 0)
            kept = good[row]
            v = x[kept] / norm[row[kept]]
        ends = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(ends), pa.array(v))], [batch.schema.names[0], "v"])


def units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v) with vectors of length 1."""
    told = rows.select(key, F.col(vector).cast("array<double>").alias("w"))
    return told.mapInArrow(_unit_rows, f"{key} {told.schema[key].dataType.simpleString()}, v array<double>")


def _matrix(v: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(v.to_list() or [np.zeros(0)]).reshape(len(v), dim)


def _nearest(x: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` centres of the highest inner product for each row, best first, ties to the smaller number."""
    return np.argsort(-np.round(x @ centres.T, 12), axis=1, kind="stable")[:, :count]


def _summer(centres: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(centres), centres.shape[1] + 1))
        for batch in batches:
            x = _matrix(batch["v"], centres.shape[1])
            at = _nearest(x, centres, 1)[:, 0]
            np.add.at(sums, at, np.column_stack((np.ones(len(x)), x)))
        at = np.flatnonzero(sums[:, 0])
        if len(at):
            yield pd.DataFrame({"list": at, "sums": list(sums[at])})

    return run


def centres_of(rows: DataFrame, lists: int, rounds: int = 5) -> np.ndarray:
    """Centres of unit vectors (chunk_id, v); empty lists keep theirs. The driver holds lists * dim numbers."""
    first = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(lists).collect()
    if not first:
        return np.zeros((0, 0))
    dim = len(first[0]["v"])
    centres = np.array([r["v"] for r in first if len(r["v"]) == dim])
    rows = rows.filter(F.size("v") == dim)
    for _ in range(rounds):
        parts = rows.select("v").mapInPandas(_summer(centres), "list int, sums array<double>")
        whole = parts.select("list", F.posexplode("sums").alias("at", "s")).groupBy("list", "at").agg(F.sum("s").alias("s"))
        sums = np.zeros((len(centres), dim + 1))
        for r in whole.collect():  # a row a list and dimension
            sums[r["list"], r["at"]] = r["s"]
        norm = np.sqrt((sums[:, 1:] ** 2).sum(axis=1))
        moved = norm > 0
        centres[moved] = sums[moved, 1:] / norm[moved, None]
    return centres


def best_of_lists(queries: DataFrame, rows: DataFrame, k: int, keep_list: bool = False) -> DataFrame:
    """(query_id, chunk_id, rank, score, and list if wanted) of the k highest inner products of queries and rows of the same list.

    queries: (query_id, v, list); rows: (chunk_id, v, list); vectors of a list have one length. Lists
    are few, and their sizes are collected.
    """
    n = queries.select("query_id").distinct().count()
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // CHUNK)))).cast("int")
    sizes = {r["list"]: max(1, -(-r["count"] // PIECE)) for r in rows.groupBy("list").count().collect()}
    if not sizes:
        return rows.sparkSession.createDataFrame([], f"query_id long, chunk_id long, rank int, score double{', list int' if keep_list else ''}")
    pieces = F.coalesce(F.create_map(*[F.lit(x) for s in sizes.items() for x in s])[F.col("list")], F.lit(1))
    stripes = rows.withColumn("piece", F.pmod(F.xxhash64("chunk_id"), pieces).cast("int"))
    chunks = queries.withColumn("chunk", chunk)
    named = chunks.select(F.col("list").alias("in_list"), F.col("chunk").alias("in_chunk")).distinct()
    # a list's rows go to each chunk of queries that asks it
    right = stripes.join(named, F.col("list") == F.col("in_list")).groupBy("list", "piece", "in_chunk")
    left = chunks.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).groupBy("list", "piece", "chunk")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": [], "list": []})
        dim, ids = len(b["v"].iloc[0]), b["chunk_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], _matrix(b["v"], dim)[order]
        scores = np.round(_matrix(a["v"], dim) @ x.T, 6)
        scores[a["query_id"].to_numpy()[:, None] == ids[None]] = -np.inf
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(a)), top.shape[1])
        out = pd.DataFrame({"query_id": a["query_id"].to_numpy()[row], "chunk_id": ids[top.ravel()], "score": scores[row, top.ravel()], "list": b["list"].iloc[0]})
        return out[out["score"] > -np.inf]

    found = left.cogroup(right).applyInPandas(best, "query_id long, chunk_id long, score double, list int")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", *(["list"] if keep_list else []))


class VectorCollection:
    """A collection below ``path``; vectors come as (chunk_id long, v array<double>) of any norm."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> list:
        return self.spark.read.schema(_LOG).parquet(f"{self.path}/log").orderBy("seq").collect()  # a row a batch

    def centres(self) -> np.ndarray:
        rows = self.spark.read.schema("list int, v array<double>").parquet(f"{self.path}/centres").orderBy("list").collect()
        return np.array([r["v"] for r in rows])

    def _commit(self, batch: str, kind: str, rows: int) -> None:
        seq = len(self.log()) if kind != "create" else 0
        row = self.spark.createDataFrame([(seq, batch, kind, rows)], _LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _write(self, batch: str, rows: DataFrame, centres: np.ndarray) -> None:
        dim = centres.shape[1]

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(list=_nearest(_matrix(b["v"], dim), centres, 1)[:, 0])

        placed = rows.filter(F.size("v") == dim).mapInPandas(place, "chunk_id long, v array<double>, list int")
        # a list's rows go to a few files, by a digest, so that none is written by one task alone
        dealt = placed.withColumn("piece", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).repartition("list", "piece").drop("piece")
        dealt.write.partitionBy("list").mode("overwrite").parquet(f"{self.path}/vectors/batch={batch}")

    def create(self, vectors: DataFrame, lists: int, rounds: int = 5) -> None:
        """A new collection; what was at the path is overwritten by the first write of each table."""
        rows = units(vectors, "chunk_id", "v")
        centres = centres_of(rows, lists, rounds)
        named = self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "list int, v array<double>")
        named.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        self.spark.createDataFrame([], _LOG).write.mode("overwrite").parquet(f"{self.path}/log")
        if len(centres):
            self._add(rows, "create", centres)

    def _add(self, rows: DataFrame, kind: str, centres: np.ndarray) -> None:
        batch = uuid.uuid4().hex
        self._write(batch, rows, centres)
        self._commit(batch, kind, self._read([batch]).count())

    def add(self, vectors: DataFrame, replace: bool = False) -> None:
        """Appends a batch; with ``replace`` older rows of the same ids are deleted first."""
        if replace:
            self.delete(vectors.select("chunk_id"))
        self._add(units(vectors, "chunk_id", "v"), "add", self.centres())

    def delete(self, ids: DataFrame) -> None:
        """Tombstones for the ids in (chunk_id); they don't touch batches that come later."""
        batch = uuid.uuid4().hex
        ids.select(F.col("chunk_id").cast("long").alias("chunk_id")).distinct().write.mode("overwrite").parquet(f"{self.path}/dead/batch={batch}")
        self._commit(batch, "delete", 0)

    def _read(self, batches: list[str], lists: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(_ROWS).parquet(f"{self.path}/vectors").filter(F.col("batch").isin(batches))
        return rows if lists is None else rows.filter(F.col("list").isin(lists))

    def rows(self, lists: list[int] | None = None) -> DataFrame:
        """(chunk_id, v, list) of live vectors, from the folders of ``lists`` only."""
        log = self.log()
        seq = {r["batch"]: r["seq"] for r in log}
        full = [r["batch"] for r in log if r["kind"] != "delete"]
        gone = [r["batch"] for r in log if r["kind"] == "delete"]
        if not full:
            return self.spark.createDataFrame([], "chunk_id long, v array<double>, list int")
        rows = self._read(full, lists)
        if gone:
            order = F.create_map(*[F.lit(x) for b, s in seq.items() for x in (b, s)])  # an entry a batch
            dead = self.spark.read.schema("chunk_id long, batch string").parquet(f"{self.path}/dead").filter(F.col("batch").isin(gone))
            dead = dead.groupBy(F.col("chunk_id").alias("gone")).agg(F.max(order[F.col("batch")]).alias("until"))
            rows = rows.withColumn("seq", order[F.col("batch")]).join(dead, (F.col("chunk_id") == F.col("gone")) & (F.col("seq") < F.col("until")), "left_anti")
        return rows.select("chunk_id", "v", "list")

    def info(self) -> DataFrame:
        """(list, n) of live vectors."""
        return self.rows().groupBy("list").agg(F.count("*").alias("n"))

    def drop(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, chunk_id, rank, score) of the k most similar vectors in the ``probes`` nearest lists, or in all.

        queries: (query_id, q).
        """
        centres = self.centres()
        if not len(centres):
            return self.spark.createDataFrame([], "query_id long, chunk_id long, rank int, score double")
        dim, probes = centres.shape[1], len(centres) if probes is None else min(probes, len(centres))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(list=list(_nearest(_matrix(b["v"], dim), centres, probes)))

        asked = units(queries, "query_id", "q").filter(F.size("v") == dim)
        routed = asked.mapInPandas(route, "query_id long, v array<double>, list array<int>").select("query_id", "v", F.explode("list").alias("list"))
        met = sorted(r["list"] for r in routed.select("list").distinct().collect())  # lists at most
        return best_of_lists(routed, self.rows(met), k)

    def _found_by(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, probe): the exact k best, and the number of lists to probe until theirs is read.

        A row among the k best of all lists is among the k best of any lists with its own, so one
        exact search tells what every number of probes finds.
        """
        centres = self.centres()
        if not len(centres):
            return self.spark.createDataFrame([], "query_id long, chunk_id long, probe int")
        dim = centres.shape[1]

        def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[["query_id"]].assign(lists=list(_nearest(_matrix(b["v"], dim), centres, len(centres))))

        asked = units(queries, "query_id", "q").filter(F.size("v") == dim).distinct()
        near = asked.mapInPandas(order, "query_id long, lists array<int>")
        found = best_of_lists(asked.withColumn("list", F.explode(F.array(*[F.lit(n) for n in range(len(centres))]))), self.rows(), k, keep_list=True)
        return found.join(near, "query_id").select("query_id", "chunk_id", F.array_position("lists", F.col("list")).cast("int").alias("probe"))

    def recall(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, recall): the share of the exact k best that ``probes`` lists give."""
        return _recall(self._found_by(queries, k), probes)

    def probes_for(self, queries: DataFrame, k: int, wanted: float, sample: int = 256) -> int:
        """The fewest probes, by halving, whose mean recall on ``sample`` queries reaches ``wanted``."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
        return self._fewest(self._found_by(some, k), wanted)

    def recall_at(self, queries: DataFrame, k: int, wanted: float, sample: int = 256) -> DataFrame:
        """(query_id, recall, probes): what ``probes_for`` and then ``recall`` give, from one exact search of all queries.

        The hits, k a query, are kept below ``path``.
        """
        at = f"{self.path}/measured/{uuid.uuid4().hex}"
        self._found_by(queries, k).write.parquet(at)
        found = self.spark.read.schema("query_id long, chunk_id long, probe int").parquet(at)
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id").distinct()
        probes = self._fewest(found.join(some, "query_id", "left_semi"), wanted)
        return _recall(found, probes).withColumn("probes", F.lit(probes))

    def _fewest(self, found: DataFrame, wanted: float) -> int:
        # a row a query and number of probes
        counts = found.groupBy("query_id", "probe").agg(F.count("*").alias("n")).collect()
        low, high = 1, max(1, len(self.centres()))
        while low < high:
            middle = (low + high) // 2
            every, hit = Counter(), Counter()
            for r in counts:
                every[r["query_id"]] += r["n"]
                hit[r["query_id"]] += r["n"] * (r["probe"] <= middle)
            reached = sum(round(hit[q] / n, 6) for q, n in every.items()) / len(every) if every else 0.0
            low, high = (low, middle) if reached >= wanted else (middle + 1, high)
        return low


def _recall(found: DataFrame, probes: int) -> DataFrame:
    return found.groupBy("query_id").agg(F.round(F.avg((F.col("probe") <= probes).cast("int")), 6).alias("recall"))
