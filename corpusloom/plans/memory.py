"""Queries over event logs and conversations: ``events`` are a user's events, their type the name."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import conversation as c, evaluation as x, memory as m
from corpusloom.plans import retrieval
from corpusloom.plans.tables import read

NOW = "2024-01-25 00:00:00"
RECENT = 100


def _now():
    return F.lit(NOW).cast("timestamp")


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def latest_events(spark, sf_dir):
    return m.newest(_events(spark, sf_dir), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], 3).select("event_id", "nth")


def earliest_onset(spark, sf_dir):
    return m.earliest(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")


def merge_onset(spark, sf_dir):
    e = _events(spark, sf_dir)
    part = lambda odd: e.filter(F.col("event_id") % 2 == odd).select(F.col("user_id").alias("key"), F.col("event_type").alias("name"), F.col("ts").alias("at"))
    return m.merge_earliest(part(0), part(1))


def profile_upsert(spark, sf_dir):
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("field"))
    updates = _events(spark, sf_dir).select("user_id", F.col("event_type").alias("field"), "ts")
    return m.upsert(customer, updates, ["user_id"], "ts").select("user_id", "field")


def profile_merge(spark, sf_dir):
    base = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    more = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return m.merge_fields(base, more.select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"), "c_mktsegment"), ["c_custkey"])


def event_retention(spark, sf_dir):
    days = F.when(F.col("event_type") == "error", 7).otherwise(20)
    most = F.when(F.col("event_type") == "view", 2).otherwise(4)
    return m.retained(_events(spark, sf_dir), ["user_id", "event_type"], _now(), days, most).select("event_id")


def merge_list_fields(spark, sf_dir):
    items = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.concat(F.lit(" "), F.col("event_type"), (F.col("k") % 5).cast("string"), F.lit(".")).alias("item"))
    return m.merge_lists(items, 8).select("key", F.array_join("items", "|").alias("items"))


def outbox_delivered(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 2).alias("event_id"), (F.col("k") % 12).cast("int").alias("retries"), "k")
    done = e.filter("event_id % 10 = 0").select("event_id")
    sent, left = m.replay(e, done, F.col("k") % 4 == 0)
    return sent.select("id", "retries", F.lit("sent").alias("state")).unionByName(left.select("id", "retries", F.lit("pending").alias("state")))


def ttl_lookup(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("key"), F.col("ts").alias("written_at"), (F.col("k") * 3600).alias("ttl_seconds"))
    return m.live_entries(e, _now()).select("key")


def lru_evict(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("last_access"))
    return m.evicted(e, 50, 0.2).select("key")


def semantic_cache_lookup(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), (F.col("vec_id") % 3).alias("version"))
    known = e.select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("v"), (F.col("vec_id") % 2).alias("version"), F.col("vec_id").alias("last_access"))
    return m.cache_lookup(asked, known, RECENT, 0.25).select("query_id", "entry_id")


def adaptive_threshold(spark, sf_dir):
    return m.thresholds(_events(spark, sf_dir).select(F.col("event_type").alias("name"), "value"), 0.1, 2.0, 60.0)


def breaker_log(spark, sf_dir):
    log = _events(spark, sf_dir).select(F.col("user_id").alias("service"), F.col("event_id").alias("id"), (F.col("k") < 40).alias("failed"))
    return m.failure_islands(log, 3)


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations")


def conversation_budgets(spark, sf_dir):
    return c.budgets(_turns(spark, sf_dir), 8192, 0.7)


def adaptive_rounds(spark, sf_dir):
    return c.adaptive_rounds(_turns(spark, sf_dir), 2000, 0.7)


def message_window(spark, sf_dir):
    return c.window(_turns(spark, sf_dir), 2).select("conv_id", "turn")


def compress_messages(spark, sf_dir):
    return c.compress(_turns(spark, sf_dir)).select("conv_id", "turn", F.md5("text").alias("text_md5"))


def history_render(spark, sf_dir):
    return c.render(_turns(spark, sf_dir), 400).select("conv_id", F.md5("history").alias("history_md5"))


def context_route(spark, sf_dir):
    has = lambda w: F.contains(F.lower("text"), F.lit(w))
    return c.route_from_context(_turns(spark, sf_dir), has("tion") & (F.col("role") == "user"), has("and"), F.length("text") <= 200)


def _samples(spark, sf_dir):
    """Each benchmark item as a question, its best hit as the answer, the next three hits as contexts, all whole."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), tokens(F.col("text")).alias("question"))
    hits = retrieval.bm25_hits(spark, sf_dir, 4).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id")
    hits = hits.select(F.col("query_id").alias("id"), "rank", tokens(F.col("text")).alias("t"))
    rest = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "t"))))
    per = hits.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("t"))).alias("answer"), F.transform(rest, lambda v: v["t"]).alias("contexts"))
    return q.join(per, "id").select("id", "question", "answer", "contexts")


def rule_metrics(spark, sf_dir):
    return x.overlap_metrics(_samples(spark, sf_dir))


def metric_averages(spark, sf_dir):
    return x.averages(x.overlap_metrics(_samples(spark, sf_dir)))


def version_compare(spark, sf_dir):
    s = x.overlap_metrics(_samples(spark, sf_dir))
    return x.compare(x.averages(s.filter("id % 2 = 0").drop("relevance")), x.averages(s.filter("id % 2 = 1")))


def classification_report(spark, sf_dir):
    return x.classification_report(read(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("truth"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).cast("string").alias("guess")))


def accuracy_by_layer(spark, sf_dir):
    r = read(spark, sf_dir, "labels").select(F.col("toxic").alias("layer"), (F.col("doc_id") % 3).alias("difficulty"), F.col("quality").alias("truth"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(F.col("quality")).alias("guess"))
    return x.accuracy_by(r, "layer", "difficulty")


def regression_report(spark, sf_dir):
    outcome = F.element_at(F.array(F.lit("pass"), F.lit("pass"), F.lit("fail"), F.lit("skip")), (F.col("k") % 4 + 1).cast("int"))
    return x.pass_rates(_events(spark, sf_dir).select(F.col("event_type").alias("kind"), outcome.alias("outcome")))


def unevaluated(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return x.not_evaluated(b, b.filter("item_id % 3 = 0")).select("item_id")


def coverage_gap(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+tion"), F.lit(0))).alias("term"))
    known = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+tion"), F.lit(0))).alias("term"))
    return x.coverage(found, known)


QUERIES = {f.__name__: f for f in (
    latest_events, earliest_onset, merge_onset, profile_upsert, profile_merge, event_retention, merge_list_fields, outbox_delivered, ttl_lookup,
    lru_evict, semantic_cache_lookup, adaptive_threshold, breaker_log, conversation_budgets, adaptive_rounds, message_window, compress_messages,
    history_render, context_route, rule_metrics, metric_averages, version_compare, classification_report, accuracy_by_layer, regression_report,
    unevaluated, coverage_gap,
)}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_TOK = "regexp_extract_all(lower({0}), '[一-鿿a-z0-9]+')"
_SAMPLES = f"""{retrieval.BM25_SQL},
h AS (SELECT query_id AS id, rank, {_TOK.format('text')} AS t FROM ranked JOIN d USING (chunk_id) WHERE rank <= 4),
g AS (SELECT id, arg_min(t, rank) AS answer, coalesce(list(t ORDER BY rank) FILTER (rank > 1), []) AS contexts FROM h GROUP BY id),
sam AS (SELECT id, {_TOK.format('question')} AS question, answer, contexts FROM g JOIN q ON q.query_id = id),
m AS (SELECT id, len(list_intersect(answer, flatten(contexts))) / len(list_distinct(answer))::DOUBLE AS faithfulness, len(list_intersect(question, answer)) / len(list_distinct(question))::DOUBLE AS relevance,
  len(list_intersect(question, flatten(contexts))) / len(list_distinct(question))::DOUBLE AS context_relevance, len(list_filter(contexts, lambda c: list_has_any(c, question))) / len(contexts)::DOUBLE AS context_precision FROM sam)"""
_LONG = "UNPIVOT {0} ON faithfulness, relevance, context_relevance, context_precision INTO NAME metric VALUE score"

ORACLES = {
    "latest_events": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 3",
    "earliest_onset": "SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY ALL",
    "merge_onset": "SELECT user_id AS key, event_type AS name, min(ts) AS at FROM events GROUP BY ALL",
    "profile_upsert": """WITH e AS (SELECT user_id, event_type AS field, ts FROM events UNION ALL SELECT c_custkey, c_mktsegment, NULL FROM customer)
SELECT user_id, field FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST) = 1""",
    "profile_merge": """WITH o AS (SELECT o_custkey AS c_custkey, max(o_orderpriority) AS p FROM orders GROUP BY 1)
SELECT coalesce(c.c_custkey, o.c_custkey) AS c_custkey, c_name, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN o ON c.c_custkey = o.c_custkey""",
    "event_retention": f"""SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - to_days(CASE WHEN event_type = 'error' THEN 7 ELSE 20 END)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) <= CASE WHEN event_type = 'view' THEN 2 ELSE 4 END""",
    "merge_list_fields": f"""WITH i AS (SELECT user_id AS key, event_type || ({_K} % 5) AS item, min(event_id) AS seq FROM events GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, item) AS nth FROM i) SELECT key, string_agg(item, '|' ORDER BY nth) AS items FROM n WHERE nth <= 8 GROUP BY key""",
    "outbox_delivered": f"""WITH e AS (SELECT event_id AS id, event_id // 2 AS event_id, ({_K} % 12)::INT AS retries, {_K} AS k FROM events), f AS (SELECT * FROM e WHERE event_id % 10 <> 0)
SELECT id, retries, 'sent' AS state FROM (SELECT * FROM f WHERE k % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY id) = 1)
UNION ALL SELECT id, retries + 1, 'pending' FROM f WHERE k % 4 = 0 AND retries + 1 < 10""",
    "ttl_lookup": f"SELECT event_id AS key FROM events WHERE epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(ts))::BIGINT < {_K} * 3600",
    "lru_evict": """WITH e AS (SELECT user_id AS key, max(ts) AS a FROM events GROUP BY 1), n AS (SELECT count(*) AS n FROM e)
SELECT key FROM e, n WHERE n >= 50 QUALIFY row_number() OVER (ORDER BY a, key) <= floor(n * 0.2::DOUBLE)""",
    "semantic_cache_lookup": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), e AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT {RECENT}),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS score FROM v q, e WHERE q.vec_id % 50 = 0),
b AS (SELECT * FROM s WHERE score >= 0.25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score >= 0.98 DESC, CASE WHEN score < 0.98 THEN score END DESC, entry_id DESC) = 1)
SELECT query_id, entry_id FROM b WHERE query_id % 3 = entry_id % 2""",
    "adaptive_threshold": """WITH s AS (SELECT event_type AS name, list_sort(list(value)) AS v, avg(value) - stddev_pop(value) AS b FROM events GROUP BY 1)
SELECT name, greatest(2.0::DOUBLE, least(60.0::DOUBLE, v[least(floor(len(v) * 0.1::DOUBLE)::BIGINT, len(v) - 1) + 1])) AS at_share, round(greatest(2.0::DOUBLE, least(60.0::DOUBLE, b)), 6) AS below_mean FROM s""",
    "breaker_log": f"""WITH l AS (SELECT user_id AS service, event_id AS id, {_K} < 40 AS failed FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY id) - row_number() OVER (PARTITION BY service, failed ORDER BY id) AS run FROM l)
SELECT service, min(id) AS first_id, count(*) AS n FROM r WHERE failed GROUP BY service, run HAVING count(*) >= 3""",
    "conversation_budgets": """SELECT conv_id, count(*) AS messages, floor(sum(length(text)) * 1.5::DOUBLE)::BIGINT AS tokens, floor(sum(length(text)) * 1.5::DOUBLE) > 5734 AS compress, count(*) > 8 AS snapshot FROM conversations GROUP BY conv_id""",
    "adaptive_rounds": """WITH t AS (SELECT *, sum(floor(length(text) * 1.5::DOUBLE)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 1400 AS fits FROM conversations)
SELECT conv_id, greatest(1, least(10, count(*) FILTER (fits AND role = 'user'))) AS rounds FROM t GROUP BY conv_id""",
    "message_window": """SELECT conv_id, turn FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - (role = 'user')::INT AS b FROM conversations) WHERE b < 2""",
    "compress_messages": """WITH t AS (SELECT *, count(*) OVER w AS n, max(CASE WHEN role = 'assistant' THEN turn END) OVER w AS last FROM conversations WINDOW w AS (PARTITION BY conv_id))
SELECT conv_id, turn, md5(CASE WHEN n <= 3 THEN text WHEN role = 'assistant' AND turn < last THEN substr(regexp_extract(text, '^[^.!?\\n]*[.!?]?'), 1, 80) || ' [...]'
  WHEN length(text) > 2000 THEN substr(text, 1, 800) || ' ... ' || right(text, 400) ELSE text END) AS text_md5 FROM t""",
    "history_render": """SELECT conv_id, md5(string_agg(role || ': ' || CASE WHEN role = 'assistant' AND length(text) > 400 THEN substr(text, 1, 266) || right(text, 134) ELSE text END, chr(10) ORDER BY turn)) AS history_md5 FROM conversations GROUP BY conv_id""",
    "context_route": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b, contains(lower(text), 'tion') AND role = 'user' AS s, contains(lower(text), 'and') AS k, length(text) <= 200 AS f FROM conversations),
g AS (SELECT conv_id, coalesce(bool_or(s) FILTER (b BETWEEN 2 AND 5), false) AS s, coalesce(bool_or(k) FILTER (b BETWEEN 2 AND 5), false) AS k, coalesce(bool_or(f) FILTER (b = 1), false) AS f FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN f AND s THEN 'symptom' WHEN s AND NOT k THEN 'symptom' WHEN k AND NOT s THEN 'knowledge' END AS route FROM g""",
    "rule_metrics": f"WITH {_SAMPLES} SELECT * FROM m",
    "metric_averages": f"WITH {_SAMPLES} SELECT metric, round(avg(score), 4) AS mean FROM ({_LONG.format('m')}) GROUP BY metric",
    "version_compare": f"""WITH {_SAMPLES}, lg AS ({_LONG.format('m')}), a AS (SELECT metric, round(avg(score) FILTER (id % 2 = 0 AND metric <> 'relevance'), 4) AS old, round(avg(score) FILTER (id % 2 = 1), 4) AS new FROM lg GROUP BY metric)
SELECT metric, coalesce(old, 0.0::DOUBLE) AS old, new, round(new - coalesce(old, 0), 4) AS delta, CASE WHEN round(new - coalesce(old, 0), 4) > 1e-9 THEN 'improved' WHEN round(new - coalesce(old, 0), 4) < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM a""",
    "classification_report": """WITH p AS (SELECT quality AS t, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS g FROM labels), k AS (SELECT unnest([0, 1]) AS label),
c AS (SELECT label, count(*) FILTER (t = label) AS support, count(*) FILTER (g = label) AS guessed, count(*) FILTER (t = label AND g = label) AS hit FROM k, p GROUP BY label),
r AS (SELECT label::VARCHAR AS label, hit / guessed::DOUBLE AS precision, hit / support::DOUBLE AS recall, 2 * (hit / guessed::DOUBLE) * (hit / support::DOUBLE) / (hit / guessed::DOUBLE + hit / support::DOUBLE) AS f1, support, hit FROM c)
SELECT label, precision, recall, f1, support FROM r UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM r
UNION ALL SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM r
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support)::BIGINT FROM r""",
    "accuracy_by_layer": "SELECT toxic AS layer, doc_id % 3 AS difficulty, count(*) AS n, avg((quality = CASE WHEN doc_id % 5 = 0 THEN 0 ELSE quality END)::INT) AS accuracy FROM labels GROUP BY ALL",
    "regression_report": f"""WITH r AS (SELECT event_type AS kind, ['pass', 'pass', 'fail', 'skip'][{_K} % 4 + 1] AS o FROM events)
SELECT kind, count(*) FILTER (o = 'pass') AS passed, count(*) FILTER (o = 'fail') AS failed, count(*) FILTER (o = 'skip') AS skipped,
  count(*) FILTER (o = 'pass') / greatest(count(*) FILTER (o <> 'skip'), 1)::DOUBLE AS pass_rate FROM r GROUP BY kind""",
    "unevaluated": "SELECT item_id FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id % 3 = 0)",
    "coverage_gap": """WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+tion')) AS term FROM documents), k AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+tion')) AS term FROM benchmark)
SELECT term, (SELECT round(count(*) FILTER (term IN (FROM k)) * 100 / count(*)::DOUBLE, 2) FROM f) AS coverage FROM f WHERE term NOT IN (FROM k) ORDER BY term LIMIT 100""",
}
