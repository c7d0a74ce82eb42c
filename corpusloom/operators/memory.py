"""Event logs of users: latest and earliest events, retention, upserts, outbox replay, caches.

Everything a long-term store does one user at a time is one pass over all users here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions import vectors


def newest(events: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The newest ``most`` events of each key; ``order`` sorts newest first."""
    return events.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= most)


def earliest(events: DataFrame, keys: list[str], at: str, carry: str) -> DataFrame:
    """The earliest event of each key; late arrivals change nothing but an earlier time."""
    return events.groupBy(*keys).agg(F.min(F.struct(at, carry)).alias("first")).select(*keys, f"first.{at}", f"first.{carry}")


def merge_earliest(base: DataFrame, more: DataFrame) -> DataFrame:
    """(key, name, at): per key and name the smaller time of two tables."""
    return base.unionByName(more).groupBy("key", "name").agg(F.min("at").alias("at"))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``base`` with the last update of each key in their place."""
    every = base.withColumn(order, F.lit(None).cast(dict(updates.dtypes)[order])).unionByName(updates)
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))
    return every.withColumn("nth", nth).filter("nth = 1").drop("nth")


def merge_fields(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Field by field: the update's value where it has one."""
    fields = [c for c in base.columns if c not in keys]
    b, u = base.alias("b"), updates.alias("u")
    joined = b.join(u, keys, "full")
    return joined.select(*keys, *[F.coalesce(F.col(f"u.{c}"), F.col(f"b.{c}")).alias(c) for c in fields])


def retained(events: DataFrame, keys: list[str], now: Column, days: Column, most: Column) -> DataFrame:
    """What retention keeps: not older than ``days``, then the newest ``most`` of each key.

    events: (ts, event_id, ...); ``days`` and ``most`` may depend on the row's key.
    """
    young = events.filter(F.col("ts") >= now - F.make_dt_interval(days=days))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return young.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def merge_lists(items: DataFrame, most: int) -> DataFrame:
    """Per key the distinct items in order of arrival, trimmed of edge punctuation, the first ``most``.

    items: (key, seq, item). Only the first arrival of each item is kept before lists are made.
    """
    flat = F.regexp_replace("item", r"^[\s,.;:!?]+|[\s,.;:!?]+$", "")
    first = items.withColumn("item", flat).filter("item <> ''").groupBy("key", "item").agg(F.min("seq").alias("seq"))
    nth = F.row_number().over(W.partitionBy("key").orderBy("seq", "item"))
    kept = first.withColumn("nth", nth).filter(F.col("nth") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("nth", "item"))), lambda x: x["item"])
    return kept.groupBy("key").agg(ordered.alias("items"))


def replay(outbox: DataFrame, done: DataFrame, failing: Column, most_retries: int = 10) -> tuple[DataFrame, DataFrame]:
    """(newly delivered, still pending) of an outbox (id, event_id, retries, ...).

    Delivery is idempotent by event_id: what is done already, or pending twice, is delivered
    once. Failures get another retry, and go after ``most_retries``.
    """
    fresh = outbox.join(done.select("event_id"), "event_id", "left_anti").withColumn("failed", failing)
    first = F.row_number().over(W.partitionBy("event_id").orderBy("id"))
    sent = fresh.filter("not failed").withColumn("nth", first).filter("nth = 1").drop("nth", "failed")
    left = fresh.filter("failed").withColumn("retries", F.col("retries") + 1).filter(F.col("retries") < most_retries).drop("failed")
    return sent, left


def live_entries(entries: DataFrame, now: Column) -> DataFrame:
    """Cache entries within their time to live: (key, written_at, ttl_seconds, ...)."""
    return entries.filter(F.unix_timestamp(now) - F.unix_timestamp("written_at") < F.col("ttl_seconds"))


def evicted(entries: DataFrame, capacity: int, share: float) -> DataFrame:
    """Keys to evict when the cache is at capacity: the least recently used ``share``, oldest first.

    entries: (key, last_access). The cut is found by counting access times, not by sorting keys in one task.
    """
    n = entries.count()
    if n < capacity:
        return entries.limit(0)
    k = int(n * share)
    per = entries.groupBy(F.date_trunc("hour", "last_access").alias("hour")).agg(F.count("*").alias("c"))
    upto = per.withColumn("upto", F.sum("c").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, 0)))  # one row an hour
    edge = upto.filter(F.col("upto") >= k).agg(F.min(F.struct("hour", (F.lit(k) - F.col("upto") + F.col("c")).alias("take"))).alias("e")).first()["e"]
    hour = F.date_trunc("hour", "last_access")
    whole = entries.filter(hour < F.lit(edge["hour"]))
    rest = entries.filter(hour == F.lit(edge["hour"])).orderBy("last_access", "key").limit(edge["take"])
    return whole.unionByName(rest)


def cache_lookup(queries: DataFrame, entries: DataFrame, recent: int, least: float, enough: float = 0.98) -> DataFrame:
    """Similar entry of each query among the ``recent`` last used, if its cosine reaches ``least``.

    The first by recency that reaches ``enough`` ends the search if none before it is better;
    else the best is taken. queries: (query_id, q, version), entries: (entry_id, v, version,
    last_access). A hit of another version is a miss. The entries compared are bounded by
    ``recent`` and broadcast.
    """
    last = entries.orderBy(F.col("last_access").desc(), "entry_id").limit(recent).withColumnRenamed("version", "entry_version")
    last = last.withColumn("place", F.row_number().over(W.orderBy(F.col("last_access").desc(), "entry_id")))  # at most ``recent`` rows
    both = queries.join(F.broadcast(last), F.lit(True)).withColumn("score", F.round(vectors.cosine(F.col("q"), F.col("v")), 6))
    # a score of ``enough`` ends the search, so among these the first counts, whatever comes later
    order = F.struct((F.col("score") >= enough).alias("ends"), F.when(F.col("score") >= enough, 1.0).otherwise(F.col("score")).alias("rated"), (-F.col("place")).alias("first"))
    hit = F.struct("entry_id", "score", "version", "entry_version")
    best = both.filter(F.col("score") >= least).groupBy("query_id").agg(F.max_by(hit, order).alias("b"))
    return best.filter("b.version = b.entry_version").select("query_id", "b.entry_id", "b.score")


def thresholds(values: DataFrame, share: float, low: float, high: float) -> DataFrame:
    """Per name the value at 0-based int(n * share) and mean less deviation, both held to [low, high].

    values: (name, value). Equal values are counted before they are sorted.
    """
    counted = values.groupBy("name", "value").agg(F.count("*").alias("c"))
    by = W.partitionBy("name")
    ranked = counted.withColumns({"upto": F.sum("c").over(by.orderBy("value").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("c").over(by)})
    at = ranked.groupBy("name").agg(F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * share), F.col("n") - 1), F.col("value"))).alias("at_share"))
    spread = values.groupBy("name").agg((F.avg("value") - F.stddev_pop("value")).alias("below_mean"))
    held = lambda c: F.greatest(F.lit(low), F.least(F.lit(high), F.col(c)))
    return at.join(spread, "name").select("name", held("at_share").alias("at_share"), F.round(held("below_mean"), 6).alias("below_mean"))


def failure_islands(log: DataFrame, least: int) -> DataFrame:
    """Runs of ``least`` or more failures in a row per service: (service, first_id, n). log: (service, id, failed)."""
    by = W.partitionBy("service").orderBy("id")
    run = F.row_number().over(by) - F.row_number().over(W.partitionBy("service", "failed").orderBy("id"))
    runs = log.withColumn("run", run).filter("failed").groupBy("service", "run").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    return runs.filter(F.col("n") >= least).drop("run")


def recorded_cases(cases: DataFrame, now: Column, summary: int = 500, preview: int = 200) -> DataFrame:
    """Cases as they are stored: texts cut to a preview, an id by content, not reviewed yet.

    cases: (user_id, case_type, query, rewritten, summary, answer).
    """
    case_id = F.concat(F.lit("bc_"), F.substring(F.md5(F.concat_ws("|", "user_id", "case_type", "query", "rewritten", "answer")), 1, 12))
    return cases.select(
        case_id.alias("case_id"), "user_id", "case_type", "query", "rewritten", F.substring(F.coalesce("summary", F.lit("")), 1, summary).alias("summary"),
        F.substring(F.coalesce("answer", F.lit("")), 1, preview).alias("answer"), now.alias("created_at"), F.lit(False).alias("reviewed"),
        F.lit("").alias("expected"), F.lit(None).cast("boolean").alias("self_contained"),
    )


def open_cases(cases: DataFrame, most: int = 50, case_type: str | None = None, reviewed: bool | None = None) -> DataFrame:
    """The newest ``most`` cases of each user, if asked of one type or state, as (..., nth)."""
    if case_type is not None:
        cases = cases.filter(F.col("case_type") == case_type)
    if reviewed is not None:
        cases = cases.filter(F.col("reviewed") == reviewed)
    return newest(cases, ["user_id"], [F.col("created_at").desc(), F.col("case_id")], most)


def reviewed_cases(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Cases with their reviews (case_id, expected, self_contained, reviewed); empty or null fields change nothing."""
    r = reviews.select(F.col("case_id").alias("of"), F.col("expected").alias("e"), F.col("self_contained").alias("s"), F.col("reviewed").alias("r"))
    out = cases.join(r, F.col("case_id") == F.col("of"), "left")
    expected = F.when(F.coalesce("e", F.lit("")) != "", F.col("e")).otherwise(F.col("expected"))
    return out.withColumns({"expected": expected, "self_contained": F.coalesce("s", "self_contained"), "reviewed": F.coalesce("r", "reviewed")}).select(*cases.columns)


def pruned_cache(entries: DataFrame, now: Column, days: int = 7, most: int = 500, factor: int = 2) -> DataFrame:
    """What stays of a shared cache: all of up to ``factor`` times ``most`` entries, else the newest ``most`` of the last ``days``.

    entries: (key, cached_at, ...). An entry without a time counts as the oldest.
    """
    n = entries.agg(F.count("*").alias("n"))
    fresh = F.col("cached_at").isNull() | (F.col("cached_at") >= now - F.make_dt_interval(days=F.lit(days)))
    # the newest ``most`` are found by a distributed top-k
    first = entries.filter(fresh).orderBy(F.col("cached_at").desc_nulls_last(), "key").limit(most).select(F.col("key").alias("kept"))
    out = entries.crossJoin(F.broadcast(n)).join(first, F.col("key") == F.col("kept"), "left")  # n is one row
    return out.filter((F.col("n") <= factor * most) | F.col("kept").isNotNull()).select(*entries.columns)


def oversize(items: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(namespace, user_id, n) of those with more items than the namespace allows; others are never pruned."""
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    return items.groupBy("namespace", "user_id").agg(F.count("*").alias("n")).filter(F.col("n") > F.try_element_at(most, F.col("namespace")))


def pending_events(events: DataFrame, now: Column, days: int) -> DataFrame:
    """(n_pending, n_expired): events of an outbox still to be sent, and those too old, which are deleted unsent."""
    old = F.col("created_at") < now - F.make_dt_interval(days=F.lit(days))
    return events.agg(F.count_if(~old).alias("n_pending"), F.count_if(old).alias("n_expired"))


def threshold_stats(values: DataFrame, defaults: dict[str, float], shares: Sequence[float] = (0.05, 0.1, 0.5, 0.9), least: int = 100) -> DataFrame:
    """(name, samples, calibrated, low, high, mean, p5, ...) of each registered name: 0-based int(n * share) of the sorted values.

    values: (name, value). Equal values are counted before they are sorted; unregistered names are left out.
    """
    counted = values.filter(F.col("name").isin(list(defaults)) & F.col("value").isNotNull()).groupBy("name", "value").agg(F.count("*").alias("c"))
    by = W.partitionBy("name")
    ranked = counted.withColumns({"upto": F.sum("c").over(by.orderBy("value").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("c").over(by)})
    at = lambda s: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * s), F.col("n") - 1), F.col("value"))).alias(f"p{round(s * 100)}")
    return ranked.groupBy("name").agg(
        F.max("n").alias("samples"), (F.max("n") >= least).alias("calibrated"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.sum(F.col("value") * F.col("c")) / F.max("n"), 6).alias("mean"), *[at(s) for s in shares],
    )
