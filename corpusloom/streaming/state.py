"""Circuit breakers and adaptive thresholds as typed stateful operators.

A breaker is closed until ``most`` failures in a row, then open: calls are turned away, and
their outcome doesn't count. ``recovery`` after the last failure it is half-open: a success
closes it, a failure opens it again. Calls are taken in order of event time: they wait in state
until the watermark passes them, so the result doesn't depend on batch borders. A closed breaker
without failures holds no state.

A threshold is set from the values seen under its name: first at FIRST values, then every EVERY,
from all values since it kept the newest KEPT at the setting before. That is what is held.

``replayed`` and ``settings`` are the batch forms; both sides share ``Breaker`` and ``at_share``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusloom.sources import shared

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"
FIRST, EVERY, KEPT = 100, 1000, 5000

_STEP = "service string, event_id long, before string, allowed boolean, after string"
_SETTING = "name string, n long, threshold double"


class Breaker:
    """One service; times in milliseconds."""

    def __init__(self, most: int, recovery: int, state: str = CLOSED, failures: int = 0, failed_at: int = 0):
        self.most, self.recovery = most, recovery
        self.state, self.failures, self.failed_at = state, failures, failed_at

    def call(self, at: int, ok: bool) -> tuple[str, bool, str]:
        """(state before, whether the call was allowed, state after)."""
        if self.state == OPEN and at - self.failed_at >= self.recovery:
            self.state = HALF_OPEN
        before = self.state
        if before == OPEN:
            return before, False, OPEN
        if ok:
            self.state, self.failures = CLOSED, 0
        else:
            self.failures, self.failed_at = self.failures + 1, at
            if before == HALF_OPEN or self.failures >= self.most:
                self.state = OPEN
        return before, True, self.state


class _BreakerProcessor(StatefulProcessor):
    def __init__(self, most: int, recovery: int):
        self.most, self.recovery = most, recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("breaker", "state string, failures int, failed_at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        for batch in rows:
            at = (batch["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            self.waiting.appendList(list(zip(at, batch["event_id"].tolist(), batch["ok"].tolist(), strict=True)))
            self.handle.registerTimer(min(at))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        calls = sorted(self.waiting.get())
        due, later = [c for c in calls if c[0] <= passed], [c for c in calls if c[0] > passed]
        breaker = Breaker(self.most, self.recovery, *(self.held.get() if self.held.exists() else ()))
        out = [(key[0], event, *breaker.call(at, ok)) for at, event, ok in due]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0])
        else:
            self.waiting.clear()
        if breaker.state == CLOSED and not breaker.failures:
            self.held.clear()
        else:
            self.held.update((breaker.state, breaker.failures, breaker.failed_at))
        yield pd.DataFrame(out, columns=["service", "event_id", "before", "allowed", "after"])

    def close(self) -> None:
        pass


def breakers(calls: DataFrame, most: int = 3, recovery: int = 30_000, late: str = "1 hour") -> DataFrame:
    """Stream of (service, event_id, before, allowed, after) for calls (service string, ts, event_id, ok)."""
    return calls.withWatermark("ts", late).groupBy("service").transformWithStateInPandas(
        statefulProcessor=_BreakerProcessor(most, recovery), outputStructType=_STEP, outputMode="Append", timeMode="EventTime"
    )


def replayed(calls: DataFrame, most: int = 3, recovery: int = 30_000) -> DataFrame:
    """The batch form of ``breakers``.

    A success that comes ``recovery`` after the call before it is allowed and closes the breaker,
    whatever came before. A service's calls are cut there, and the pieces are replayed apart.
    """
    by = W.partitionBy("service").orderBy("at", "event_id")
    timed = calls.select("service", "event_id", "ok", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    fresh = F.col("ok") & (F.col("at") - F.lag("at").over(by) >= recovery)
    pieces = timed.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
    pieces = pieces.withColumn("piece", F.sum("fresh").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("fresh"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker, held = Breaker(most, recovery), None
        for rows in batches:
            steps = []
            keys = zip(rows["service"].tolist(), rows["piece"].tolist(), strict=True)
            for key, at, ok in zip(keys, rows["at"].tolist(), rows["ok"].tolist(), strict=True):
                if key != held:
                    breaker, held = Breaker(most, recovery), key
                steps.append(breaker.call(at, ok))
            out = pd.DataFrame(steps, columns=["before", "allowed", "after"])
            yield pd.DataFrame({"service": rows["service"].to_numpy(), "event_id": rows["event_id"].to_numpy(), **out})

    # a task goes through all its pieces row by row and holds one breaker
    dealt = pieces.repartition(calls.sparkSession.sparkContext.defaultParallelism * 4, "service", "piece")
    return dealt.sortWithinPartitions("service", "piece", "at", "event_id").mapInPandas(run, _STEP)


def at_share(values: list[float], share: float, low: float, high: float) -> float:
    """The value at 0-based int(n * share) of the sorted values, held to [low, high]."""
    return max(low, min(high, sorted(values)[min(len(values) - 1, int(len(values) * share))]))


class _ThresholdProcessor(StatefulProcessor):
    def __init__(self, share: float, low: float, high: float):
        self.args = (share, low, high)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "n long, last long")
        self.values = handle.getListState("values", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, last = self.counts.get() if self.counts.exists() else (0, 0)
        held, out = [v for (v,) in self.values.get()], []
        whole = pd.concat(list(rows)).sort_values("event_id")
        for value, forced in zip(whole["value"].tolist(), whole["forced"].tolist(), strict=True):
            if not forced:
                held.append(value)
                n += 1
            due = n >= FIRST and (last == 0 or n - last >= EVERY)
            if held and (forced or due):
                out.append((key[0], n, at_share(held, *self.args)))
                last, held = n, held[-KEPT:]
        self.counts.update((n, last))
        if held:
            self.values.put([(v,) for v in held])
        yield pd.DataFrame(out, columns=["name", "n", "threshold"])

    def close(self) -> None:
        pass


def thresholds(values: DataFrame, share: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Stream of settings (name, n, threshold) for values (name, event_id, value, forced).

    A forced row carries no value and sets the threshold at once. Rows of a batch are taken in
    order of event_id, batches as they come.
    """
    return values.groupBy("name").transformWithStateInPandas(
        statefulProcessor=_ThresholdProcessor(share, low, high), outputStructType=_SETTING, outputMode="Append", timeMode="None"
    )


def _numbered(values: DataFrame) -> DataFrame:
    """(name, value, k, count): places from 1 in order of event_id and values of the name.

    Rows are numbered within ranges of name and event_id, and what lies before a range is added,
    so no task holds a name. The ranges are written, since their bounds come from a sample.
    """
    spark = values.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = shared.fresh_dir(spark, "ranges")
    ranged = values.select("name", "event_id", "value").repartitionByRange(ranges, "name", "event_id").withColumn("range", F.spark_partition_id())
    ranged.write.parquet(kept)
    rows = spark.read.schema(ranged.schema).parquet(kept)
    sizes = rows.groupBy("name", "range").agg(F.count("*").alias("size"))  # a row a range and border
    of = W.partitionBy("name")
    before = F.sum("size").over(of.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    places = sizes.select(F.col("name").alias("of_name"), F.col("range").alias("of_range"), before.alias("before"), F.sum("size").over(of).alias("count"))
    nth = rows.withColumn("nth", F.row_number().over(W.partitionBy("name", "range").orderBy("event_id")))
    met = nth.join(places, F.col("name").eqNullSafe(F.col("of_name")) & (F.col("range") == F.col("of_range")))
    return met.select("name", "value", (F.col("nth") + F.col("before")).alias("k"), "count")


def settings(values: DataFrame, share: float, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The batch form of ``thresholds`` without forced rows: a row for each time a name's threshold is set.

    Each value goes to the at most six settings that use it; a setting uses at most KEPT + EVERY.
    """
    numbered = _numbered(values)
    # settings come at FIRST, FIRST + EVERY, ...; the j-th (from 0) uses what came after the KEPT newest of the one before
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - FIRST) / EVERY))
    whole = F.floor((F.lit(KEPT) - FIRST) / EVERY)  # up to this one nothing is left out
    last = F.greatest(whole, F.floor((F.col("k") - 1 - FIRST + KEPT) / EVERY) + 1)
    last = F.least(last, F.floor((F.col("count") - FIRST) / EVERY))
    used = numbered.filter((F.col("count") >= FIRST) & (first <= last))
    used = used.select("name", "value", F.explode(F.sequence(first, last)).alias("j"))
    by = W.partitionBy("name", "j")
    ranked = used.withColumns({"at": F.row_number().over(by.orderBy("value")) - 1, "size": F.count("*").over(by)})
    chosen = ranked.filter(F.col("at") == F.least(F.col("size") - 1, F.floor(F.col("size") * share)))
    return chosen.select("name", (F.col("j") * EVERY + FIRST).alias("n"), F.greatest(F.lit(low), F.least(F.lit(high), "value")).alias("threshold"))


def current(names: DataFrame, set_: DataFrame) -> DataFrame:
    """(name, threshold) of each registered name (name, default): the last setting, or the default before the first."""
    newest = set_.groupBy("name").agg(F.max_by("threshold", "n").alias("threshold"))
    return names.join(newest, "name", "left").select("name", F.coalesce("threshold", "default").alias("threshold"))
