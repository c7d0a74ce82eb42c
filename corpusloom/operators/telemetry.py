"""Analytics over logs of timed steps, token usage, ratings and refusals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def since(log: DataFrame, now: Column, hours: int) -> DataFrame:
    return log.filter(F.col("ts") > now - F.make_dt_interval(hours=F.lit(hours)))


def nth_values(log: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the value at 0-based place int(n * share) of its sorted values.

    Equal values are counted before they are sorted, so a key's window holds a row for each
    distinct value.
    """
    counted = log.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    by_key = W.partitionBy(key)
    upto = F.sum("c").over(by_key.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counted.select(key, value, upto.alias("upto"), F.sum("c").over(by_key).alias("n"))
    at = {name: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col(value))).alias(name) for name, share in shares.items()}
    return ranked.groupBy(key).agg(*at.values())


def node_stats(log: DataFrame) -> DataFrame:
    """Per node: runs, mean, least and most duration, cache hit rate, p50, p95 and p99; slowest first.

    log: (node, duration, cache_hit).
    """
    whole = log.groupBy("node").agg(
        F.count("*").alias("runs"),
        F.avg("duration").alias("avg_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        F.avg(F.col("cache_hit").cast("int")).alias("hit_rate"),
    )
    parts = nth_values(log, "node", "duration", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return whole.join(parts, "node", "left").orderBy(F.col("avg_duration").desc(), "node")


def request_stats(log: DataFrame, most: int = 20) -> DataFrame:
    """The slowest requests with the path of their steps in order of time.

    log: (request_id, node, duration, ts, step_id).
    """
    step = F.struct("ts", "step_id", F.concat_ws(":", "node", F.col("duration").cast("string")).alias("label"))
    whole = log.groupBy("request_id").agg(
        F.sum("duration").alias("total_duration"), F.count("*").alias("steps"), F.min("ts").alias("started"),
        F.array_sort(F.collect_list(step)).alias("path"),
    )
    path = F.array_join(F.transform("path", lambda s: s["label"]), "|")
    return whole.withColumn("path", path).orderBy(F.col("total_duration").desc(), "request_id").limit(most)


def route_stats(log: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Counts and rates by route and layer; layers that aren't named count as other. log: (route, layer)."""
    named = log.filter("route <> ''").withColumn("layer", F.when(F.col("layer").isin(list(layers)), F.col("layer")).otherwise("other"))
    counted = named.groupBy("route", "layer").agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # a row for each route and layer
    return counted.withColumn("rate", F.col("n") / total)


def token_cost(prompt: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    return F.round(prompt / 1000 * price_in + completion / 1000 * price_out, 6)


def token_stats(usage: DataFrame) -> DataFrame:
    """Tokens and cost in one pass: in total, by model, by node and by day. usage: (model, node, day, prompt, completion, cost)."""
    return usage.groupingSets(
        [[], ["model"], ["node"], ["day"]], "model", "node", "day"
    ).agg(
        F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.count("*").alias("calls"),
        F.round(F.sum("cost"), 6).alias("cost"),
    ).select(F.coalesce("model", F.lit("all")).alias("model"), F.coalesce("node", F.lit("all")).alias("node"), F.coalesce(F.col("day").cast("string"), F.lit("all")).alias("day"), "prompt", "completion", "calls", "cost")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per day: ups, downs and satisfaction up / max(up + down, 1). feedback: (day, rating)."""
    up, down = F.count_if(F.col("rating") == "up"), F.count_if(F.col("rating") == "down")
    return feedback.groupBy("day").agg(up.alias("up"), down.alias("down"), (up / F.greatest(up + down, F.lit(1))).alias("satisfaction"))


def newest_negatives(feedback: DataFrame, most: int) -> DataFrame:
    """The newest ratings down with a question that aren't converted yet."""
    return feedback.filter("rating = 'down' and question <> '' and not converted").orderBy(F.col("ts").desc(), F.col("id").desc()).limit(most)


def refusal_daily(refusals: DataFrame) -> DataFrame:
    """Counts and mean confidence by day, refusal type and question type."""
    return refusals.groupBy("day", "refusal_type", "question_type").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def refusal_top_questions(refusals: DataFrame, most: int = 20) -> DataFrame:
    return refusals.groupBy("question").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "question").limit(most)


def expired(log: DataFrame, now: Column, days: Column) -> DataFrame:
    """The rows that retention deletes: older than ``days``, which may depend on the row."""
    return log.filter(F.col("ts") < now - F.make_dt_interval(days=days))
