"""Breakers and thresholds over ``events``, in their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.tables import read
from corpusloom.sources import shared
from corpusloom.streaming import state
from corpusloom.streaming.writers import EventTable, start

#: The events of a user lie hours apart.
RECOVERY = 20 * 3_600_000
DEFAULTS = {"click": 0.25, "view": 0.5, "error": 0.75, "never seen": 1.5}


def _calls(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("service"), "ts", "event_id", (F.get_json_object("props", "$.k").cast("long") >= 40).alias("ok"))


def _values(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "event_id", "value")


def breaker_states(spark, sf_dir):
    return state.replayed(_calls(spark, sf_dir), 3, RECOVERY)


def breaker_rejections(spark, sf_dir):
    """Calls of each service, and those that an open breaker turned away."""
    steps = state.replayed(_calls(spark, sf_dir), 3, RECOVERY)
    return steps.groupBy("service").agg(F.count("*").alias("calls"), F.count_if(~F.col("allowed")).alias("rejected"), F.count_if(F.col("before") == "half_open").alias("probes"))


def threshold_settings(spark, sf_dir):
    return state.settings(_values(spark, sf_dir), 0.1, 2.0, 60.0)


def threshold_current(spark, sf_dir):
    names = spark.createDataFrame(list(DEFAULTS.items()), "name string, default double")
    return state.current(names, state.settings(_values(spark, sf_dir), 0.5, 2.0, 60.0))


def _written(spark, sf_dir):
    """Two queries stream ``events`` into one table, odd and even ones, and one batch is delivered again."""
    root = shared.fresh_dir(spark, "event-table")
    table = EventTable(spark, root, "event_id long, user_id long, kind string, at timestamp_ntz, value double")
    shape = lambda odd: lambda df: df.filter(F.col("event_id") % 2 == odd).select("event_id", "user_id", F.col("event_type").alias("kind"), F.col("ts").alias("at"), "value")
    schema = read(spark, sf_dir, "events").schema
    for odd in (0, 1):
        # a glob, since a stream reads folders and names
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
        start(stream, table, f"q{odd}", f"{root}/checkpoint-{odd}", shape(odd)).awaitTermination()
    table.write(shape(1)(read(spark, sf_dir, "events")), "q1", 0)
    return table


def events_written(spark, sf_dir):
    return _written(spark, sf_dir).rows().groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_ids"))


def events_upserted(spark, sf_dir):
    """The newest event of each user and kind, before and after compaction alike."""
    table, order = _written(spark, sf_dir), [F.col("at"), F.col("event_id")]
    table.compact(["user_id", "kind"], order)
    return table.latest(["user_id", "kind"], order).select("user_id", "kind", "event_id")


QUERIES = {f.__name__: f for f in (events_written, events_upserted, breaker_states, breaker_rejections, threshold_settings, threshold_current)}

_STEPS = f"""WITH RECURSIVE e AS (
  SELECT 'u' || user_id AS service, event_id, epoch_ms(ts) AS due, CAST(json_extract_string(props, '$.k') AS BIGINT) >= 40 AS ok,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS n FROM events
), r AS (
  SELECT service, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::VARCHAR AS before, 'closed' AS after, 0 AS failures, NULL::BIGINT AS failed_at
  FROM e GROUP BY service
  UNION ALL
  SELECT service, n, event_id, before, CASE WHEN before = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN before = 'half_open' OR failures + 1 >= 3 THEN 'open' ELSE before END,
         CASE WHEN before = 'open' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN before = 'open' OR ok THEN failed_at ELSE due END
  FROM (SELECT e.*, r.failures, r.failed_at, CASE WHEN r.after = 'open' AND e.due - r.failed_at >= {RECOVERY} THEN 'half_open' ELSE r.after END AS before
        FROM r JOIN e ON e.service = r.service AND e.n = r.n + 1)
), steps AS (SELECT service, event_id, before, before <> 'open' AS allowed, after FROM r WHERE n > 0)"""
_SETTINGS = """WITH v AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS c FROM events),
p AS (SELECT DISTINCT name, k AS n, CASE WHEN k - 1000 > 5000 THEN k - 6000 ELSE 0 END AS low FROM v WHERE k >= 100 AND (k - 100) % 1000 = 0),
u AS (SELECT p.name, p.n, v.value, row_number() OVER (PARTITION BY p.name, p.n ORDER BY v.value) - 1 AS place, count(*) OVER (PARTITION BY p.name, p.n) AS size
      FROM p JOIN v ON v.name = p.name AND v.k <= p.n AND v.k > p.low),
s AS (SELECT name, n, greatest(2, least(60, value))::DOUBLE AS threshold FROM u WHERE place = least(size - 1, floor(size * {0}::DOUBLE)))"""

ORACLES = {
    "events_written": "SELECT event_type AS kind, count(*) AS n, count(*) AS n_ids FROM events GROUP BY event_type",
    "events_upserted": "SELECT user_id, event_type AS kind, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "breaker_states": f"{_STEPS} SELECT * FROM steps",
    "breaker_rejections": f"""{_STEPS} SELECT service, count(*) AS calls, count(*) FILTER (NOT allowed) AS rejected, count(*) FILTER (before = 'half_open') AS probes FROM steps GROUP BY service""",
    "threshold_settings": f"{_SETTINGS.format('0.1')} SELECT * FROM s",
    "threshold_current": f"""{_SETTINGS.format('0.5')}, d AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}::DOUBLE)" for n, x in DEFAULTS.items())}) t(name, first)),
m AS (SELECT name, arg_max(threshold, n) AS threshold FROM s GROUP BY name) SELECT d.name, coalesce(m.threshold, d.first) AS threshold FROM d LEFT JOIN m USING (name)""",
}
