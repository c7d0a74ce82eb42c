"""Breakers and thresholds: streams against batch forms and plain replays, with a restart in between."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import state

HOUR = 3_600_000


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, parts, schema, transform):
    """All output of a stream over one file at a time, stopped after half of the files and started again."""
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()
    half = len(parts) // 2
    for some in (parts[:half], parts[half:]):
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = transform(read).writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).collect()


def plain_breaker(calls, most, recovery):
    """The log of one service, written out once more: (event, before, allowed, after)."""
    state_, failures, last, out = "closed", 0, None, []
    for at, event, ok in sorted(calls):
        if state_ == "open" and at - last >= recovery:
            state_ = "half_open"
        before = state_
        if before != "open":
            if ok:
                state_, failures = "closed", 0
            else:
                failures, last = failures + 1, at
                state_ = "open" if before == "half_open" or failures >= most else before
        out.append((event, before, before != "open", state_))
    return out


def calls_of(seed, n=160):
    rng = random.Random(seed)
    at, rows = 1_700_000_000_000, []
    for k in range(n):
        at += rng.choice([1, 5, 20, 29, 30, 31, 90]) * 1000
        rows.append((f"s{rng.randrange(3)}", at, k, rng.random() < 0.45))
    return rows


CALLS = "service string, ts timestamp, event_id long, ok boolean"


def timed(rows):
    import datetime

    return [(s, datetime.datetime.fromtimestamp(at / 1000, datetime.timezone.utc), k, ok) for s, at, k, ok in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_replayed_breakers(spark, seed):
    rows = calls_of(seed, 300)
    got = {r["event_id"]: (r["before"], r["allowed"], r["after"]) for r in state.replayed(spark.createDataFrame(timed(rows), CALLS)).collect()}
    want = {e: x for s in ("s0", "s1", "s2") for e, *x in plain_breaker([(at, k, ok) for of, at, k, ok in rows if of == s], 3, 30_000)}
    assert {e: list(x) for e, x in got.items()} == want and {x[0] for x in got.values()} == {"closed", "open", "half_open"}
    assert state.replayed(spark.createDataFrame([], CALLS)).collect() == []


def test_streamed_breakers(rocks, tmp_path):
    rows = calls_of(3)
    end = rows[-1][1] + 10 * HOUR
    mixed = list(rows)
    for k in range(0, len(mixed) - 4, 4):  # late within the watermark
        mixed[k], mixed[k + 3] = mixed[k + 3], mixed[k]
    parts = [timed(mixed[a : a + 20]) for a in range(0, len(mixed), 20)] + [timed([(s, end, 10_000 + int(s[1]), True)]) for s in ("s0", "s1", "s2")]
    got = streamed(rocks, tmp_path, parts, CALLS, lambda df: state.breakers(df, 3, 30_000, "10 minutes"))
    want = sorted((e, *x) for s in ("s0", "s1", "s2") for e, *x in plain_breaker([(at, k, ok) for of, at, k, ok in rows if of == s], 3, 30_000))
    assert sorted((r["event_id"], r["before"], r["allowed"], r["after"]) for r in got if r["event_id"] < 10_000) == want


VALUES = "name string, event_id long, value double, forced boolean"


def plain_settings(values, share, low, high):
    held, out, last = [], [], 0
    for n, v in enumerate(values, 1):
        held.append(v)
        if n >= 100 and (last == 0 or n - last >= 1000):
            threshold = sorted(held)[min(len(held) - 1, int(len(held) * share))]
            out.append((n, max(low, min(high, threshold))))
            last, held = n, held[-5000:]
    return out


def test_settings(spark):
    rng = random.Random(4)
    values = {"a": [rng.random() + k / 9000 for k in range(9300)], "b": [rng.random() for _ in range(1099)], "c": [0.5] * 99, "d": [rng.choice([0.1, 0.2]) for _ in range(1100)]}
    rows = [(n, k, v, False) for n, vs in values.items() for k, v in enumerate(vs)]
    for share in (0.05, 0.5, 1.0):
        got = sorted(tuple(r) for r in state.settings(spark.createDataFrame(rows, VALUES), share, 0.05, 1.5).collect())
        assert got == sorted((n, *x) for n, vs in values.items() for x in plain_settings(vs, share, 0.05, 1.5))
    names = spark.createDataFrame([("a", 9.0), ("c", 0.25), ("z", 0.75)], "name string, default double")
    held = {r["name"]: r["threshold"] for r in state.current(names, state.settings(spark.createDataFrame(rows, VALUES), 0.5, 0.0, 2.0)).collect()}
    assert held["c"] == 0.25 and held["z"] == 0.75 and held["a"] == plain_settings(values["a"], 0.5, 0.0, 2.0)[-1][1]


def test_streamed_thresholds(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), k, rng.random(), False) for k in range(3600)]
    parts = [rows[a : a + 450] for a in range(0, 3600, 450)]
    got = streamed(rocks, tmp_path, parts, VALUES, lambda df: state.thresholds(df, 0.1))
    want = sorted((n, *x) for n in "ab" for x in plain_settings([v for m, _, v, _ in rows if m == n], 0.1, 0.0, 1.0))
    assert sorted(tuple(r) for r in got) == want and len(want) > 4


def test_forced_settings(rocks, tmp_path):
    parts = [[("a", 1, None, True), ("a", 2, 0.5, False)], [("a", 3, 0.75, False), ("a", 4, None, True), ("a", 5, 0.9, False)]]
    got = streamed(rocks, tmp_path, parts, VALUES, lambda df: state.thresholds(df, 0.5))
    assert [tuple(r) for r in got] == [("a", 2, 0.75)]


def test_replay_makes_no_frame_a_piece(spark):
    rows = [("s", 1_700_000_000_000 + k * HOUR, k, True) for k in range(3000)]  # each call begins a piece
    frame = state.replayed(spark.createDataFrame(timed(rows), CALLS))
    assert "FlatMapGroupsInPandas" not in frame._jdf.queryExecution().toString()
    assert {tuple(r)[2:] for r in frame.collect()} == {("closed", True, "closed")}


def test_no_window_holds_a_name(spark):
    values = spark.range(2500).selectExpr("'a' AS name", "id AS event_id", "cast(id % 97 AS double) AS value")
    got = sorted(tuple(r) for r in state._numbered(values).select("k", "count", "value").collect())
    assert got == [(k + 1, 2500, float(k % 97)) for k in range(2500)]
    plan = state.settings(values, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "row_number()" in x]
    assert windows and all("range#" in x or "j#" in x for x in windows)
