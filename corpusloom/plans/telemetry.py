"""Telemetry queries: ``events`` stands for the log, its type for the node and user for the request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import telemetry as t
from corpusloom.plans.tables import read

NOW = "2024-01-20 00:00:00"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def _now():
    return F.lit(NOW).cast("timestamp")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").withColumn("k", k)


def node_stats(spark, sf_dir):
    log = _events(spark, sf_dir).select(F.col("event_type").alias("node"), F.col("value").alias("duration"), (F.col("k") >= 50).alias("cache_hit"))
    return t.node_stats(log)


def request_stats_topn(spark, sf_dir):
    log = _events(spark, sf_dir).select(F.col("user_id").alias("request_id"), F.col("event_type").alias("node"), F.col("value").alias("duration"), "ts", F.col("event_id").alias("step_id"))
    out = t.request_stats(log)
    return out.select("request_id", F.round("total_duration", 4).alias("total_duration"), "steps", "started", F.md5("path").alias("path_md5"))


def route_layer_stats(spark, sf_dir):
    layer = F.element_at(F.array(F.lit("rule"), F.lit("context"), F.lit("llm"), F.lit("vision")), (F.col("k") % 4 + 1).cast("int"))
    log = _events(spark, sf_dir).select(F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("route"), layer.alias("layer"))
    return t.route_stats(log, ["rule", "context", "llm"])


def _usage(spark, sf_dir):
    price_in = F.when(F.col("event_type") == "view", 0.5).otherwise(2.0)
    price_out = F.when(F.col("event_type") == "view", 1.0).otherwise(6.0)
    prompt, completion = F.col("k") * 10, F.col("user_id") % 7 * 5
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("model"), F.concat(F.lit("n"), F.col("user_id") % 3).alias("node"), F.to_date("ts").alias("day"),
        prompt.alias("prompt"), completion.alias("completion"), t.token_cost(prompt, completion, price_in, price_out).alias("cost"),
    )


def token_grouping_sets(spark, sf_dir):
    return t.token_stats(_usage(spark, sf_dir))


def token_cost_by_model(spark, sf_dir):
    return t.token_stats(_usage(spark, sf_dir)).filter("model <> 'all'").select("model", "prompt", "completion", "cost")


def _feedback(spark, sf_dir):
    e = _events(spark, sf_dir)
    rating = F.when(F.col("event_type") == "purchase", "up").when(F.col("event_type") == "error", "down").otherwise("none")
    return e.select(F.to_date("ts").alias("day"), "ts", F.col("event_id").alias("id"), rating.alias("rating"), F.when(F.col("k") % 5 == 0, "").otherwise(F.col("props")).alias("question"), (F.col("k") % 2 == 0).alias("converted"))


def feedback_stats_daily(spark, sf_dir):
    return t.feedback_stats(_feedback(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def feedback_candidates(spark, sf_dir):
    return t.newest_negatives(_feedback(spark, sf_dir), 50).select("id", "ts", "question")


def _refusals(spark, sf_dir):
    e = _events(spark, sf_dir).filter("event_type in ('error', 'signup')")
    return e.select(F.to_date("ts").alias("day"), F.col("event_type").alias("refusal_type"), F.concat(F.lit("t"), F.col("k") % 3).alias("question_type"), (F.col("k") / 100).alias("confidence"), F.col("props").alias("question"))


def refusal_daily_view(spark, sf_dir):
    return t.refusal_daily(_refusals(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def refusal_top_questions(spark, sf_dir):
    return t.refusal_top_questions(_refusals(spark, sf_dir))


def retention_cleanup(spark, sf_dir):
    days = F.when(F.col("event_type") == "error", 10).otherwise(5)
    return t.expired(_events(spark, sf_dir), _now(), days).groupBy("event_type").agg(F.count("*").alias("n_deleted"), F.max("ts").alias("newest_deleted"))


def recent_events(spark, sf_dir):
    return t.since(_events(spark, sf_dir), _now(), 24 * 7).filter(F.col("ts") <= _now()).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    node_stats, request_stats_topn, route_layer_stats, token_grouping_sets, token_cost_by_model, feedback_stats_daily,
    feedback_candidates, refusal_daily_view, refusal_top_questions, retention_cleanup, recent_events,
)}

_USAGE = f"""SELECT event_type AS model, 'n' || (user_id % 3) AS node, CAST(ts AS DATE) AS day, {_K} * 10 AS prompt, user_id % 7 * 5 AS completion,
       round(({_K} * 10) / 1000.0::DOUBLE * (CASE WHEN event_type = 'view' THEN 0.5 ELSE 2.0 END)::DOUBLE
             + (user_id % 7 * 5) / 1000.0::DOUBLE * (CASE WHEN event_type = 'view' THEN 1.0 ELSE 6.0 END)::DOUBLE, 6) AS cost FROM events"""
_REFUSALS = f"""SELECT CAST(ts AS DATE) AS day, event_type AS refusal_type, 't' || ({_K} % 3) AS question_type, {_K} / 100.0::DOUBLE AS confidence, props AS question
       FROM events WHERE event_type IN ('error', 'signup')"""

ORACLES = {
    "node_stats": f"""
WITH log AS (SELECT event_type AS node, value AS duration, {_K} >= 50 AS hit FROM events)
SELECT node, count(*) AS runs, avg(duration) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration,
       avg(hit::INT) AS hit_rate, list_sort(list(duration))[floor(count(*) * 0.5::DOUBLE)::BIGINT + 1] AS p50,
       list_sort(list(duration))[floor(count(*) * 0.95::DOUBLE)::BIGINT + 1] AS p95, list_sort(list(duration))[floor(count(*) * 0.99::DOUBLE)::BIGINT + 1] AS p99
FROM log GROUP BY node""",
    "request_stats_topn": """
SELECT user_id AS request_id, round(sum(value), 4) AS total_duration, count(*) AS steps, min(ts) AS started,
       md5(string_agg(event_type || ':' || value::VARCHAR, '|' ORDER BY ts, event_id)) AS path_md5
FROM events GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 20""",
    "route_layer_stats": f"""
WITH log AS (SELECT event_type AS route, CASE {_K} % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'context' WHEN 2 THEN 'llm' ELSE 'other' END AS layer
             FROM events WHERE event_type <> 'error')
SELECT route, layer, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS rate FROM log GROUP BY route, layer""",
    "token_grouping_sets": f"""
SELECT coalesce(model, 'all') AS model, coalesce(node, 'all') AS node, coalesce(day::VARCHAR, 'all') AS day,
       sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, count(*) AS calls, round(sum(cost), 6) AS cost
FROM ({_USAGE}) GROUP BY GROUPING SETS ((), (model), (node), (day))""",
    "token_cost_by_model": f"""
SELECT model, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round(sum(cost), 6) AS cost FROM ({_USAGE}) GROUP BY model""",
    "feedback_stats_daily": """
SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) FILTER (event_type = 'purchase') AS up, count(*) FILTER (event_type = 'error') AS down,
       count(*) FILTER (event_type = 'purchase') / greatest(count(*) FILTER (event_type IN ('purchase', 'error')), 1)::DOUBLE AS satisfaction
FROM events GROUP BY 1""",
    "feedback_candidates": f"""
SELECT event_id AS id, ts, props AS question FROM events
WHERE event_type = 'error' AND {_K} % 5 <> 0 AND {_K} % 2 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "refusal_daily_view": f"SELECT day::VARCHAR AS day, refusal_type, question_type, count(*) AS n, avg(confidence) AS avg_confidence FROM ({_REFUSALS}) GROUP BY ALL",
    "refusal_top_questions": f"SELECT question, count(*) AS n FROM ({_REFUSALS}) GROUP BY question ORDER BY n DESC, question LIMIT 20",
    "retention_cleanup": f"""
SELECT event_type, count(*) AS n_deleted, max(ts) AS newest_deleted FROM events
WHERE ts < TIMESTAMP '{NOW}' - to_days(CASE WHEN event_type = 'error' THEN 10 ELSE 5 END) GROUP BY event_type""",
    "recent_events": f"""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 168 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY event_type""",
}
