"""Streaming forms of the log operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)


def windowed_stats(events: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Counts and sums by type and window of time; what comes later than ``late`` is left out."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
    )


def sessions(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
    )


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, however often it is replayed within ``late``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def limited(events: DataFrame, most: int = 20, seconds: int = 60) -> DataFrame:
    """(event_id, accepted): at most ``most`` accepted events of a user in any ``seconds``; rejected ones don't count.

    A user's state holds the times of the events accepted in the last ``seconds``, at most ``most``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ok = []
        for at in rows["ts"]:
            now = at.timestamp()
            times = [t for t in times if t > now - seconds]
            ok.append(len(times) < most)
            if ok[-1]:
                times.append(now)
        state.update((times,))
        yield pd.DataFrame({"event_id": rows["event_id"], "accepted": ok})

    return events.groupBy("user_id").applyInPandasWithState(
        run, "event_id long, accepted boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout
    )


def snapshots(events: DataFrame, every: int = 8) -> DataFrame:
    """(user_id, n, newest): a row each time a user has gathered more than ``every`` events since the last."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        out = []
        for rows in batches:
            for event in sorted(rows["event_id"]):
                held += 1
                if held > every:
                    out.append((key[0], held, event))
                    held = 0
        state.update((held,))
        yield pd.DataFrame(out, columns=["user_id", "n", "newest"])

    return events.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, n int, newest long", "held int", "append", GroupStateTimeout.NoTimeout
    )


def limited_batch(events: DataFrame, most: int = 20, seconds: int = 60) -> DataFrame:
    """The batch form of ``limited``; a user's events are handled in order of time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, times, ok = rows.sort_values(["ts", "event_id"]), [], []
        for at in rows["ts"]:
            now = at.timestamp()
            times = [t for t in times if t > now - seconds]
            ok.append(len(times) < most)
            if ok[-1]:
                times.append(now)
        return pd.DataFrame({"event_id": rows["event_id"], "accepted": ok})

    return events.select("user_id", "ts", "event_id").groupBy("user_id").applyInPandas(run, "event_id long, accepted boolean")


def deliver(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends each event once to a table; restarts replay nothing."""
    return once(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
