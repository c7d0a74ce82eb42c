"""Rule queries: made-up dictionaries over documents, conversations and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import rules as r
from corpusloom.plans.tables import read

WORDS = {"then": "when", "thenth": "when", "and": "both", "the": "article", "from": "source", "und": "both", "avec": "with", "pour": "for"}
PLAIN = ["tion", "avec", "und"]
INTENTS = ["the", "de"]
CARE = [("and", ("alpha", "beta")), ("en", ("beta", "gamma"))]
CHAIN = [("the ", "a "), ("a th", "ath"), ("und", "and")]


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def dictionary_match(spark, sf_dir):
    return r.find_all(_docs(spark, sf_dir), WORDS, negators=["not "])


def dictionary_names(spark, sf_dir):
    return r.canonical_names(r.find_all(_docs(spark, sf_dir), WORDS)).select("id", F.array_join("names", ",").alias("names"))


def dictionary_counts(spark, sf_dir):
    hits = r.find_all(_docs(spark, sf_dir), {w: w for w in PLAIN}, boundaries=False)
    return hits.groupBy("id", "keyword").agg(F.count("*").alias("n"))


def route_cascade(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", r.route(F.col("text"), ["ention", "heit"], ["ble", "ung"], ["hello", "hi"]).alias("route"))


def route_labels(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", r.normalise_label(F.concat(F.lit(" Route: "), F.col("event_type")), ["click", "view", "purchase"], "general").alias("label"))


def query_normalise(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.md5(r.rewrite(F.col("text"), CHAIN)).alias("text_md5"))


def background_strip(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(r.strip_background(F.col("text"), "the ", " and")).alias("text_md5"))


def enrich_query(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(r.enrich(F.col("text"), INTENTS, CARE, ("delta",))).alias("text_md5"))


def rewrite_guard(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    return b.select("item_id", F.md5(r.guard(F.col("text"), F.replace("text", F.lit("an"), F.lit("")), ["and ", " inon"])).alias("text_md5"), r.has_anaphora(F.col("text"), ["this ", "it "], ["tion"]).alias("anaphora"))


def same_query(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    other = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" "), F.col("text"), F.lit("!!"))).otherwise(F.upper("text"))
    return b.select("item_id", r.same_query(F.col("text"), other).alias("same"))


def dosage_parse(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("mg"), F.lit("g"), F.lit(" ug"), F.lit("ml")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", r.dosage_mg(F.concat(F.lit("take "), F.col("p_size").cast("string"), unit, F.lit(" daily"))).alias("mg"))


def dosage_safety(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("single_mg"), (F.col("p_partkey") % 4).alias("per_day"), F.when(F.col("p_partkey") % 9 == 0, 120).alias("daily_mg"), F.lit(100).alias("max_mg"))
    return r.dosage_check(p)


def _baskets(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("i"), (F.col("l_partkey") % 20).cast("string")).alias("item"))


def interaction_pairs(spark, sf_dir):
    rules = spark.createDataFrame([("i1", "i2", "high"), ("i5", "i3", "low"), ("i2", "i1", "high"), ("i7", "i19", "mid")], "a string, b string, risk string")
    return r.interactions(_baskets(spark, sf_dir), rules)


def combination_risks(spark, sf_dir):
    return r.combinations(_baskets(spark, sf_dir), {"r1": ["i1", "i2"], "r2": ["i3", "i4", "i5"], "r3": ["i0"], "r4": ["item i7", "i19"]})


def triage(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    level = F.when(F.col("k") % 7 == 0, "severe").otherwise("mild")
    return e.select("event_id", r.urgency(F.col("event_type") == "error", F.col("k") % 11 == 0, level, F.col("value"), F.col("event_type") == "click").alias("level"))


def department_advice(spark, sf_dir):
    of = spark.createDataFrame([("i1", "north"), ("i2", "south"), ("i3", "north"), ("i4", "east")], "item string, department string")
    return r.departments(_baskets(spark, sf_dir), of, "general")


def outer_merge(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    seen = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_size").alias("value"), F.lit("cm").alias("unit"))
    found = p.filter("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), (F.col("p_size") + 1).alias("value"), F.when(F.col("p_partkey") % 5 == 0, "mm").alias("unit"))
    return r.outer_merge(seen, found)


def assertion_matches(spark, sf_dir):
    return r.assertions(_docs(spark, sf_dir), [r"[a-z]+heit", r"the [a-z]+tion"])


def json_blocks(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("see ```json\n"), F.col("props"), F.lit("\n``` end"))).otherwise(F.concat(F.lit("x "), F.col("props"), F.lit(" y")))
    return e.select("event_id", F.get_json_object(t.first_json_object(fenced), "$.k").cast("long").alias("k"))


def comparison_form(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(t.normalise_for_comparison(F.concat(F.lit("，"), F.col("text"), F.lit("！ ")))).alias("text_md5"))


def age_groups(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", r.age_group(F.concat(F.lit("patient, "), (F.col("p_size") * 2).cast("string"), F.when(F.col("p_partkey") % 3 > 0, " years").otherwise(" kg"))).alias("age_group"))


QUERIES = {f.__name__: f for f in (
    dictionary_match, dictionary_names, dictionary_counts, route_cascade, route_labels, query_normalise, background_strip, enrich_query, rewrite_guard,
    same_query, dosage_parse, dosage_safety, interaction_pairs, combination_risks, triage, department_advice, outer_merge, assertion_matches,
    json_blocks, comparison_form, age_groups,
)}

_ITEMS = "SELECT DISTINCT l_orderkey AS id, 'i' || (l_partkey % 20) AS item FROM lineitem"
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

ORACLES = {
    "dictionary_counts": """SELECT id, keyword, n FROM (SELECT doc_id AS id, unnest(['tion', 'avec', 'und']) AS keyword, unnest([len(string_split(text, 'tion')) - 1, len(string_split(text, 'avec')) - 1, len(string_split(text, 'und')) - 1]) AS n FROM documents) WHERE n > 0""",
    "route_cascade": """WITH c AS (SELECT *, lower(trim(text)) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN t = '' THEN 'general' WHEN contains(t, 'ention') OR contains(t, 'heit') THEN 'symptom'
  WHEN contains(t, 'ble') OR contains(t, 'ung') THEN 'knowledge' WHEN t IN ('hello', 'hi') OR length(t) <= 4 THEN 'general' END AS route FROM c""",
    "route_labels": "SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN event_type ELSE 'general' END AS label FROM events",
    "query_normalise": "SELECT doc_id AS id, md5(replace(replace(replace(text, 'the ', 'a '), 'a th', 'ath'), 'und', 'and')) AS text_md5 FROM documents",
    "background_strip": r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, 'the .{1,12}? and', '', 'g'), '^[, ]+|[, ]+$', '', 'g')) AS text_md5 FROM conversations",
    "enrich_query": """WITH w AS (SELECT item_id, text, list_concat(CASE WHEN contains(text, 'and') THEN ['alpha', 'beta'] ELSE [] END, CASE WHEN contains(text, 'en') THEN ['beta', 'gamma'] ELSE [] END) AS w FROM benchmark),
f AS (SELECT *, CASE WHEN len(w) = 0 THEN ['delta'] ELSE list_filter(w, lambda x, i: list_position(w, x) = i) END AS u FROM w), g AS (SELECT *, list_filter(u, lambda x: NOT contains(text, x)) AS fresh FROM f)
SELECT item_id, md5(CASE WHEN (contains(text, 'the') OR contains(text, 'de')) AND len(fresh) > 0 THEN text || ' ' || array_to_string(fresh, ' ') ELSE text END) AS text_md5 FROM g""",
    "rewrite_guard": """WITH x AS (SELECT item_id, text, replace(text, 'an', '') AS w FROM benchmark) SELECT item_id, md5(CASE WHEN contains(text, 'and ') AND NOT contains(w, 'and ') OR contains(text, ' inon') AND NOT contains(w, ' inon') THEN text ELSE w END) AS text_md5,
  contains(text, 'this ') OR contains(text, 'it ') OR length(text) < 15 AND NOT contains(text, 'tion') AS anaphora FROM x""",
    "same_query": r"""WITH x AS (SELECT item_id, text, CASE WHEN item_id % 2 = 0 THEN ' ' || text || '!!' ELSE upper(text) END AS o FROM benchmark)
SELECT item_id, regexp_replace(regexp_replace(text, '[ \t\n\r]+', '', 'g'), '^[,.!?;:]+|[,.!?;:]+$', '', 'g') = regexp_replace(regexp_replace(o, '[ \t\n\r]+', '', 'g'), '^[,.!?;:]+|[,.!?;:]+$', '', 'g') AS same FROM x""",
    "dosage_parse": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1000.0::DOUBLE WHEN 2 THEN p_size / 1000.0::DOUBLE END AS mg FROM part",
    "dosage_safety": "SELECT p_partkey AS id, p_size > 100 OR p_partkey % 9 = 0 OR p_size * (p_partkey % 4) > 100 AS exceeds FROM part",
    "interaction_pairs": f"""WITH i AS ({_ITEMS}), r(a, b, risk) AS (VALUES ('i1', 'i2', 'high'), ('i3', 'i5', 'low'), ('i19', 'i7', 'mid'))
SELECT x.id, r.a, r.b, r.risk FROM i x JOIN i y ON x.id = y.id JOIN r ON x.item = r.a AND y.item = r.b""",
    "combination_risks": f"""WITH i AS ({_ITEMS}), r(rule, word) AS (VALUES ('r1', 'i1'), ('r1', 'i2'), ('r2', 'i3'), ('r2', 'i4'), ('r2', 'i5'), ('r3', 'i0'), ('r4', 'item i7'), ('r4', 'i19'))
SELECT id, rule FROM i JOIN r ON contains(item, word) OR contains(word, item) GROUP BY id, rule
HAVING count(DISTINCT word) = (SELECT count(DISTINCT word) FROM r q WHERE q.rule = r.rule)""",
    "triage": f"""SELECT event_id, CASE WHEN event_type = 'error' OR {_K} % 11 = 0 THEN 'red' WHEN {_K} % 7 = 0 OR value > 72 OR event_type = 'click' THEN 'yellow' ELSE 'green' END AS level FROM events""",
    "department_advice": f"""WITH i AS ({_ITEMS}), d(item, department) AS (VALUES ('i1', 'north'), ('i2', 'south'), ('i3', 'north'), ('i4', 'east'))
SELECT id, coalesce(string_agg(DISTINCT department, ',' ORDER BY department), 'general') AS departments FROM i LEFT JOIN d USING (item) GROUP BY id""",
    "outer_merge": """WITH s AS (SELECT p_partkey AS id, p_brand AS name, p_size AS value, 'cm' AS unit FROM part WHERE p_partkey % 3 <> 0),
r AS (SELECT p_partkey AS id, p_brand AS name, p_size + 1 AS value, CASE WHEN p_partkey % 5 = 0 THEN 'mm' END AS unit FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(s.id, r.id) AS id, coalesce(s.name, r.name) AS name, coalesce(r.value, s.value) AS value, coalesce(r.unit, s.unit) AS unit,
  CASE WHEN s.value IS NOT NULL AND r.value IS NOT NULL THEN 'verified' WHEN r.value IS NOT NULL THEN 'read_only' ELSE 'seen_only' END AS origin FROM s FULL JOIN r ON s.id = r.id AND s.name = r.name""",
    "assertion_matches": """WITH d AS (SELECT doc_id AS id, 0 AS pattern, regexp_extract_all(text, '[a-z]+heit') AS m FROM documents UNION ALL SELECT doc_id, 1, regexp_extract_all(text, 'the [a-z]+tion') FROM documents)
SELECT id, pattern, unnest(range(len(m)))::INT AS n, unnest(m) AS match FROM d""",
    "json_blocks": f"SELECT event_id, {_K} AS k FROM events",
    "comparison_form": r"SELECT item_id, md5(regexp_replace(lower(',' || regexp_replace(text, '[ \t\n\r]+', '', 'g') || '!'), '^[,.!?;:()]+|[,.!?;:()]+$', '', 'g')) AS text_md5 FROM benchmark",
    "age_groups": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_size * 2 < 16 THEN 'child' WHEN p_size * 2 >= 60 THEN 'elderly' ELSE 'adult' END AS age_group FROM part",
}
