"""Queries of upkeep: deleted chunks, cases, caches, thresholds, large outputs, summaries, coercions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import coerce as k
from corpusloom.operators import conversation as c, memory as m, versioning as v
from corpusloom.plans.tables import read

NOW = "2024-02-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp")


def _events(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.withColumn("at", F.col("ts").cast("timestamp"))


def _chunks(spark, sf_dir):
    """Orders as chunks of their customer: every third is deleted, half of these with a time."""
    key = F.col("o_orderkey")
    gone = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(key % 700).cast("int"))
    return read(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("source"), (key % 3 == 0).alias("is_deleted"), F.when(key % 2 == 0, gone).alias("deleted_at"),
        gone.alias("updated_at"), F.when(key % 5 == 0, "pending").otherwise("active").alias("status"),
    )


def restored_chunks(spark, sf_dir):
    sources = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("source"))
    return v.restore(_chunks(spark, sf_dir), sources, _now()).select("id", "is_deleted", (F.col("updated_at") == _now()).alias("touched"))


def purged_chunks(spark, sf_dir):
    return v.purge(_chunks(spark, sf_dir), _now(), 20).select("id")


def activated_chunks(spark, sf_dir):
    return v.activate_pending(_chunks(spark, sf_dir), _now()).select("id", "status", F.col("activated_at").isNotNull().alias("activated"))


def embedding_consistency(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    model = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 != 1, F.col("p_brand"))
    return p.select("p_partkey", v.embedded_alike(model, F.col("p_size") % 3 * 512, "Brand#13", 1024).alias("alike"))


def audit_tail(spark, sf_dir):
    return v.newest_entries(_events(spark, sf_dir), "event_id", 50).select("event_id", "event_type")


def _cases(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(
        F.concat("event_id", F.lit("")).alias("case_id"), "user_id", F.col("event_type").alias("case_type"), F.col("at").alias("created_at"),
        (F.col("k") % 3 == 0).alias("reviewed"), F.lit("").alias("expected"), F.lit(None).cast("boolean").alias("self_contained"),
    )


def recorded_cases(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    cases = d.select(
        F.coalesce("source", F.lit("system")).alias("user_id"), F.lit("retrieval_miss").alias("case_type"), F.col("doc_id").cast("string").alias("query"),
        F.coalesce("lang", F.lit("")).alias("rewritten"), F.col("text").alias("summary"), F.col("text").alias("answer"),
    )
    out = m.recorded_cases(cases, _now())
    return out.select("query", F.md5("summary").alias("summary_md5"), F.md5("answer").alias("answer_md5"), "reviewed", F.length("case_id").alias("id_length"))


def open_cases(spark, sf_dir):
    return m.open_cases(_cases(spark, sf_dir), 3, reviewed=False).select("case_id", "user_id", "nth")


def reviewed_cases(spark, sf_dir):
    r = _events(spark, sf_dir).filter("event_id % 4 = 0").select(
        F.concat("event_id", F.lit("")).alias("case_id"), F.when(F.col("k") % 2 == 0, F.col("event_type")).otherwise("").alias("expected"),
        F.when(F.col("k") % 5 == 0, F.col("k") % 10 == 0).alias("self_contained"), F.lit(True).alias("reviewed"),
    )
    return m.reviewed_cases(_cases(spark, sf_dir), r).select("case_id", "expected", F.col("self_contained").cast("string").alias("self_contained"), "reviewed")


def pruned_cache(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").alias("key"), F.when(F.col("k") % 9 != 0, F.col("at")).alias("cached_at"))
    return m.pruned_cache(e, F.lit("2024-01-25").cast("timestamp"), 10, 300).select("key")


def oversize_namespaces(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("namespace"), "user_id")
    return m.oversize(e, {"view": 4, "click": 3, "error": 1})


def outbox_state(spark, sf_dir):
    return m.pending_events(_events(spark, sf_dir).select(F.col("at").alias("created_at")), F.lit("2024-01-25").cast("timestamp"), 7)


def threshold_stats(spark, sf_dir):
    return m.threshold_stats(_events(spark, sf_dir).select(F.col("event_type").alias("name"), "value"), {"view": 1.0, "click": 2.0, "error": 3.0})


def cache_keys(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    versions = {"top_k": "5", "kb_version": F.concat(F.lit("v"), F.col("item_id") % 3), "filter": F.when(F.col("item_id") % 2 == 0, "live")}
    return b.select("item_id", k.cache_key(F.col("text"), versions, "rag:").alias("key"), k.answer_key(F.col("text"), F.lit("kb1"), F.lit("p1")).alias("answer_key"))


def persisted_outputs(spark, sf_dir):
    """Documents as turns: placeholders for those of over 2,000 bytes, and all texts back again."""
    turns = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), "text")
    short, outputs = c.persist_large(turns, 2000)
    back = c.restored(short, outputs).select(F.col("conv_id").alias("of"), F.md5("text").alias("restored_md5"))
    short = short.select("conv_id", F.col("text").startswith("<persisted-output").alias("persisted"), F.when(F.col("text").startswith("<persisted-output"), F.regexp_extract("text", r'(?s) preview="(.*)">$', 1)).alias("preview"))
    return short.join(back, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "persisted", F.md5("preview").alias("preview_md5"), "restored_md5")


def conversation_summaries(spark, sf_dir):
    s = c.rule_summary(read(spark, sf_dir, "conversations"), "ung |tion", "the ([a-z]+)", "(and [a-z]{5,50})")
    return s.select("conv_id", F.md5("goal").alias("goal_md5"), F.array_join("findings", "|").alias("findings"), F.array_join("references", "|").alias("refs"), F.md5(F.array_join("constraints", "|")).alias("constraints_md5"))


def coerced_fields(spark, sf_dir):
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    listed = F.concat_ws("、", F.col("o_orderpriority"), F.lit(""), F.col("o_orderstatus"))
    kind = F.element_at(F.array(*map(F.lit, ["Symptoms", " 知识 ", "general_query", "other"])), (key % 4 + 1).cast("int"))
    said = F.concat(F.when(key % 2 == 0, " Final: ").when(key % 3 == 0, "FINAL：").otherwise(""), F.col("o_orderstatus"))
    return o.select(
        "o_orderkey", k.age(F.concat(F.lit("about "), (key % 90).cast("string"), F.lit("岁"))).alias("age"), k.age(F.lit("unknown")).cast("string").alias("no_age"),
        F.array_join(k.items(listed), "|").alias("items"), F.array_join(k.allergies(F.concat_ws("，", F.lit(" a b "), F.lit(""), "o_orderstatus")), "|").alias("allergies"),
        k.question_type(kind).alias("kind"), k.without_prefix(said, "FINAL").alias("final"),
        k.first_known(F.when(key % 2 == 0, "old").when(key % 3 == 0, " "), F.lit("new")).alias("complaint"),
        k.without_markers(F.concat(F.lit("x [来源:a b] "), F.col("o_orderstatus"), F.lit(" [来源:] [y]"))).alias("unmarked"),
    )


def split_questions(spark, sf_dir):
    asked = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit("? and what then ？ "))).otherwise(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(k.questions(asked), "|")).alias("questions_md5"))


def bigram_counts(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(k.bigrams(F.col("text"))).alias("pair")).groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("pair").alias("distinct_pairs"))


def described_differences(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    other = F.when(F.col("item_id") % 5 == 0, "").when(F.col("item_id") % 5 == 1, F.concat("text", F.lit(" !"))).otherwise(F.replace("text", F.lit("an"), F.lit("x")))
    return b.select("item_id", k.described_difference(other, F.col("text")).alias("difference"))


QUERIES = {f.__name__: f for f in (
    restored_chunks, purged_chunks, activated_chunks, embedding_consistency, audit_tail, recorded_cases, open_cases, reviewed_cases, pruned_cache,
    oversize_namespaces, outbox_state, threshold_stats, cache_keys, persisted_outputs, conversation_summaries, coerced_fields, split_questions,
    bigram_counts, described_differences,
)}

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_CHUNKS = "c AS (SELECT o_orderkey AS id, o_custkey AS source, o_orderkey % 3 = 0 AS gone, TIMESTAMP '2024-01-01' + to_hours((o_orderkey % 700)::INT) AS t FROM orders)"
_CLEAN = r"trim(regexp_replace(text, '[，。！？、；：（）\[\]{}【】《》\s0-9\-_=+|\\<>]+', ' ', 'g'))"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[一-鿿A-Za-z0-9]{{2,}}'))"

ORACLES = {
    "restored_chunks": f"""WITH {_CHUNKS}, s AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT id, gone AND source NOT IN (FROM s) AS is_deleted, gone AND source IN (FROM s) OR t = TIMESTAMP '{NOW}' AS touched FROM c""",
    "purged_chunks": f"WITH {_CHUNKS} SELECT id FROM c WHERE NOT (gone AND id % 2 = 0 AND t < TIMESTAMP '{NOW}' - to_days(20))",
    "activated_chunks": "SELECT o_orderkey AS id, 'active' AS status, o_orderkey % 5 = 0 AS activated FROM orders",
    "embedding_consistency": "SELECT p_partkey, p_partkey % 4 IN (0, 1) OR p_size % 3 = 0 OR (p_brand = 'Brand#13' AND p_size % 3 = 2) AS alike FROM part",
    "audit_tail": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
    "recorded_cases": "SELECT doc_id::VARCHAR AS query, md5(substr(coalesce(text, ''), 1, 500)) AS summary_md5, md5(substr(coalesce(text, ''), 1, 200)) AS answer_md5, false AS reviewed, 15 AS id_length FROM documents",
    "open_cases": f"""SELECT event_id::VARCHAR AS case_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR) AS nth FROM events WHERE {_K} % 3 <> 0 QUALIFY nth <= 3""",
    "reviewed_cases": f"""SELECT event_id::VARCHAR AS case_id, CASE WHEN event_id % 4 = 0 AND {_K} % 2 = 0 THEN event_type ELSE '' END AS expected,
  CASE WHEN event_id % 4 = 0 AND {_K} % 5 = 0 THEN ({_K} % 10 = 0)::VARCHAR END AS self_contained, event_id % 4 = 0 OR {_K} % 3 = 0 AS reviewed FROM events""",
    "pruned_cache": f"""WITH e AS (SELECT event_id AS key, CASE WHEN {_K} % 9 <> 0 THEN ts END AS t FROM events)
SELECT key FROM e WHERE (SELECT count(*) FROM e) <= 600 OR key IN (SELECT key FROM e WHERE t IS NULL OR t >= TIMESTAMP '2024-01-25' - to_days(10) ORDER BY t DESC NULLS LAST, key LIMIT 300)""",
    "oversize_namespaces": """SELECT event_type AS namespace, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > CASE event_type WHEN 'view' THEN 4 WHEN 'click' THEN 3 WHEN 'error' THEN 1 END""",
    "outbox_state": """SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-18') AS n_pending, count(*) FILTER (ts < TIMESTAMP '2024-01-18') AS n_expired FROM events""",
    "threshold_stats": """WITH s AS (SELECT event_type AS name, list_sort(list(value)) AS v FROM events WHERE event_type IN ('view', 'click', 'error') AND value IS NOT NULL GROUP BY 1)
SELECT name, len(v) AS samples, len(v) >= 100 AS calibrated, v[1] AS low, v[-1] AS high, round(list_avg(v), 6) AS mean, v[floor(len(v) * 0.05::DOUBLE)::INT + 1] AS p5, v[floor(len(v) * 0.1::DOUBLE)::INT + 1] AS p10,
  v[floor(len(v) * 0.5::DOUBLE)::INT + 1] AS p50, v[floor(len(v) * 0.9::DOUBLE)::INT + 1] AS p90 FROM s""",
    "cache_keys": """SELECT item_id, 'rag:' || md5(text || CASE WHEN item_id % 2 = 0 THEN '|filter=live' ELSE '' END || '|kb_version=v' || (item_id % 3) || '|top_k=5') AS key, 'answer:' || substr(md5(text || ':kb1:p1'), 1, 16) AS answer_key FROM benchmark""",
    "persisted_outputs": """SELECT doc_id AS conv_id, coalesce(strlen(text) > 2000, false) AS persisted, CASE WHEN strlen(text) > 2000 THEN md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) END AS preview_md5,
  md5(text) AS restored_md5 FROM documents""",
    "conversation_summaries": """WITH t AS (SELECT *, CASE WHEN role = 'assistant' THEN regexp_extract_all(text, 'and [a-z]{5,50}')[1:3] END AS f, CASE WHEN role = 'assistant' THEN regexp_extract_all(text, 'the ([a-z]+)', 1) END AS n FROM conversations)
SELECT conv_id, md5(arg_min(substr(text, 1, 100), turn) FILTER (role = 'user')) AS goal_md5, coalesce(array_to_string(flatten(list(f ORDER BY turn) FILTER (f IS NOT NULL))[1:5], '|'), '') AS findings,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(n) FILTER (n IS NOT NULL))))[1:5], '|'), '') AS refs,
  md5(coalesce(string_agg(substr(text, 1, 80), '|' ORDER BY turn) FILTER (role = 'user' AND regexp_matches(text, 'ung |tion')), '')) AS constraints_md5 FROM t GROUP BY conv_id""",
    "coerced_fields": """SELECT o_orderkey, (o_orderkey % 90)::INT AS age, NULL::VARCHAR AS no_age, regexp_replace(o_orderpriority, '[ ,]+', '|', 'g') || '|' || o_orderstatus AS items, 'a b|' || o_orderstatus AS allergies,
  ['symptom', 'knowledge', 'general', 'other'][o_orderkey % 4 + 1] AS kind, o_orderstatus AS final, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS complaint, 'x  ' || o_orderstatus || '  [y]' AS unmarked FROM orders""",
    "split_questions": """WITH q AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || '? and what then ？ ' ELSE text END AS t FROM conversations),
p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '[？?]'), lambda x: trim(x)), lambda x: x <> '') AS ps FROM q)
SELECT conv_id, turn, md5(CASE WHEN len(ps) >= 2 THEN array_to_string(list_transform(ps, lambda x: x || '？'), '|') ELSE t END) AS questions_md5 FROM p""",
    "bigram_counts": f"""WITH c AS (SELECT item_id, {_CLEAN} AS t FROM benchmark), p AS (SELECT item_id, list_filter(list_transform(range(1, length(t)), lambda k: substr(t, k, 2)), lambda x: NOT contains(x, ' ')) AS ps FROM c)
SELECT item_id, len(ps) AS n, len(list_distinct(ps)) AS distinct_pairs FROM p WHERE len(ps) > 0""",
    "described_differences": f"""WITH b AS (SELECT item_id, text AS e, CASE item_id % 5 WHEN 0 THEN '' WHEN 1 THEN text || ' !' ELSE replace(text, 'an', 'x') END AS a FROM benchmark),
w AS (SELECT *, {_WORDS.format('e')} AS we, {_WORDS.format('a')} AS wa FROM b), d AS (SELECT *, list_sort(list_filter(we, lambda x: NOT list_contains(wa, x)))[1:5] AS mi, list_sort(list_filter(wa, lambda x: NOT list_contains(we, x)))[1:5] AS ex FROM w)
SELECT item_id, CASE WHEN a = '' THEN 'actual is empty' WHEN len(mi) + len(ex) = 0 THEN 'differs in meaning'
  ELSE concat_ws('; ', CASE WHEN len(mi) > 0 THEN 'missing: ' || array_to_string(mi, ', ') END, CASE WHEN len(ex) > 0 THEN 'extra: ' || array_to_string(ex, ', ') END) END AS difference FROM d""",
}
