"""Review queries: turns of conversations as answers, baskets of orders as findings and items."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import review as r
from corpusloom.plans.tables import read

RULES = r.ReviewRules(
    assertions=[r.Assertion("the [a-z]+tion", "perhaps the ", "the "), r.Assertion("and ", "or ")],
    urgent=["pain 3", "faint", "ention"], care=["doctor", "heit", "clinic"], disclaimer="For information only.", disclaimer_marks=["only", "ung "],
)
TRIAGE = r.TriageRules(
    urgent=["i17", "item i3"], watch=["i5", "i8"], combinations={"c1": ["i1", "i2"], "c2": ["i4", "i6", "i9"]}, departments={"i1": "north", "i2": "south", "i9": "east"},
)
MEDICATION = r.MedicationRules(
    contraindications={"i1": ["URGENT", "child"], "i2": ["LOW"], "i3": [], "i4": ["not specified"]}, interactions=[("i1", "i2"), ("i3", "i4")],
    fields={"use": "Use of {item}: see the leaflet.", "dose": "Dose of {item}: as told."}, child_notes={"i3": "half of it"}, child_words=["child", "O dose"], disclaimer="Ask a doctor.",
)


def _answers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    name = F.concat(F.lit("pain "), (F.col("turn") % 5).cast("string"))
    onset = F.when(F.col("conv_id") % 9 == 0, F.array(F.lit("faint spell"))).otherwise(F.array().cast("array<string>"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("answer"), F.array(name).alias("findings"), onset.alias("onset_names"))


def answer_review(spark, sf_dir):
    out = r.review(_answers(spark, sf_dir), RULES)
    return out.select("id", "status", F.array_join("risk_tags", ",").alias("tags"), F.md5("revised").alias("revised_md5"))


def assertion_positions(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.explode(r.assertion_places(F.col("text"), [r.Assertion("and ", "or ")])).alias("a"))
    return found.select("doc_id", "a.match", "a.position")


def _baskets(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem")
    items = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("i"), (F.col("l_partkey") % 20).cast("string")))).alias("findings"))
    return items.join(read(spark, sf_dir, "orders"), F.col("id") == F.col("o_orderkey"))


def triage_report(spark, sf_dir):
    people = _baskets(spark, sf_dir).select(
        "id", "findings", F.when(F.col("o_orderstatus") == "F", "severe").alias("severity"), F.when(F.col("id") % 3 == 0, (F.col("id") % 100).cast("double")).alias("hours")
    )
    return r.triage(people, TRIAGE).select("id", "level", F.array_join("risk_tags", ",").alias("tags"), "status", F.md5("advice").alias("advice_md5"))


def symptom_durations(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("onset"))
    return r.longest_duration(e, F.lit("2024-02-01 00:00:00").cast("timestamp"))


def medication_review(spark, sf_dir):
    answer = F.concat(F.lit("for "), F.col("o_orderstatus"), F.when(F.col("id") % 2 == 0, " use").otherwise(""), F.when(F.col("id") % 3 == 0, " dose").otherwise(""), F.lit("  "))
    people = _baskets(spark, sf_dir).select("id", answer.alias("answer"), F.col("findings").alias("items"), F.array("o_orderpriority").alias("conditions"))
    out = r.review_medication(people, MEDICATION)
    return out.select("id", "status", F.array_join("risk_tags", ",").alias("tags"), F.md5("revised").alias("revised_md5"))


QUERIES = {f.__name__: f for f in (answer_review, assertion_positions, triage_report, symptom_durations, medication_review)}

_TRIM = r"regexp_replace({0}, '\s+$', '')"
_ITEMS = "SELECT l_orderkey AS id, list_sort(list(DISTINCT 'i' || (l_partkey % 20))) AS f FROM lineitem GROUP BY 1"
_HAS = "len(list_filter(f, lambda x: contains(x, '{0}') OR contains('{0}', x))) > 0"

ORACLES = {
    "answer_review": rf"""WITH a AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS t, 'pain ' || (turn % 5) AS f, conv_id % 9 = 0 AS onset FROM conversations),
e AS (SELECT *, list_filter([CASE WHEN f = 'pain 3' THEN f END, CASE WHEN onset THEN 'faint spell' END, CASE WHEN contains(t, 'pain 3') AND f <> 'pain 3' THEN 'pain 3' END,
  CASE WHEN contains(t, 'faint') THEN 'faint' END, CASE WHEN contains(t, 'ention') THEN 'ention' END], lambda x: x IS NOT NULL) AS found,
  regexp_matches(t, 'the [a-z]+tion') OR contains(t, 'and ') AS claimed, contains(t, 'only') OR contains(t, 'ung ') AS disclaimed, contains(t, 'doctor') OR contains(t, 'heit') OR contains(t, 'clinic') AS care FROM a),
g AS (SELECT *, len(found) > 0 AND NOT care AS alert, replace(regexp_replace(t, 'the ([a-z]+tion)', 'perhaps the \1', 'g'), 'and ', 'or ') AS r1 FROM e),
h AS (SELECT *, CASE WHEN alert THEN {_TRIM.format('r1')} || chr(10) || chr(10) || 'Urgent: you mentioned ' || array_to_string(found, ', ') || ', please see a doctor at once.' ELSE r1 END AS r2 FROM g)
SELECT id, CASE WHEN claimed OR alert OR NOT disclaimed THEN 'revise' ELSE 'pass' END AS status,
  array_to_string(list_filter([CASE WHEN claimed THEN 'diagnostic_assertion' END, CASE WHEN alert THEN 'emergency_risk_missed' END], lambda x: x IS NOT NULL), ',') AS tags,
  md5(CASE WHEN disclaimed THEN r2 ELSE {_TRIM.format('r2')} || chr(10) || chr(10) || 'For information only.' END) AS revised_md5 FROM h""",
    "assertion_positions": """WITH p AS (SELECT doc_id, string_split(text, 'and ') AS s FROM documents), k AS (SELECT doc_id, s, unnest(range(1, len(s))) AS k FROM p)
SELECT doc_id, 'and ' AS match, (list_sum(list_transform(s[1:k], lambda x: length(x))) + 4 * (k - 1))::INT AS position FROM k""",
    "triage_report": f"""WITH i AS ({_ITEMS}), p AS (SELECT id, f, o_orderstatus = 'F' AS severe, CASE WHEN id % 3 = 0 THEN id % 100 END AS hours FROM i JOIN orders ON o_orderkey = id),
w AS (SELECT *, list_filter([CASE WHEN {_HAS.format('i17')} THEN 'i17' END, CASE WHEN {_HAS.format('item i3')} THEN 'item i3' END], lambda x: x IS NOT NULL) AS urgent,
  list_filter([CASE WHEN {_HAS.format('i1')} AND {_HAS.format('i2')} THEN 'c1' END, CASE WHEN {_HAS.format('i4')} AND {_HAS.format('i6')} AND {_HAS.format('i9')} THEN 'c2' END], lambda x: x IS NOT NULL) AS tog,
  list_filter(['i5', 'i8'], lambda x: contains(array_to_string(f, ' '), x)) AS watch, coalesce(hours > 72, false) AS long,
  list_sort(list_distinct(list_filter(list_transform(f, lambda x: CASE WHEN contains(x, 'i1') THEN 'north' WHEN contains(x, 'i2') THEN 'south' WHEN contains(x, 'i9') THEN 'east' END), lambda d: d IS NOT NULL))) AS d FROM p),
v AS (SELECT *, CASE WHEN len(urgent) + len(tog) > 0 THEN 'red' WHEN severe OR long OR len(watch) > 0 THEN 'yellow' ELSE 'green' END AS level,
  CASE WHEN len(urgent) > 0 THEN 'urgent: ' || array_to_string(urgent, ', ') WHEN len(tog) > 0 THEN 'together: ' || array_to_string(tog, ', ') WHEN severe THEN 'severe' WHEN long THEN 'long'
    WHEN len(watch) > 0 THEN 'watch: ' || array_to_string(watch, ', ') ELSE 'mild' END AS reason FROM w)
SELECT id, level, array_to_string(list_filter([CASE WHEN len(urgent) > 0 THEN 'emergency_symptom' END, CASE WHEN len(tog) > 0 THEN 'dangerous_combination' END, CASE WHEN long THEN 'duration_exceeded' END], lambda x: x IS NOT NULL), ',') AS tags,
  CASE WHEN level = 'green' THEN 'pass' ELSE 'revise' END AS status,
  md5('level: ' || CASE level WHEN 'red' THEN 'emergency' WHEN 'yellow' THEN 'see a doctor' ELSE 'at home' END || chr(10) || 'findings: ' || array_to_string(f, ', ') || chr(10) || 'lasted: ' || coalesce(hours || ' h', 'not known')
    || chr(10) || 'do: ' || CASE level WHEN 'yellow' THEN 'see ' || CASE WHEN len(d) > 0 THEN array_to_string(d, ' or ') ELSE 'general' END WHEN 'red' THEN 'go at once' ELSE 'rest' END || chr(10) || 'reason: ' || reason) AS advice_md5 FROM v""",
    "symptom_durations": """SELECT user_id AS id, round(greatest(0, max(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts)) / 3600000000.0::DOUBLE), 1) AS hours FROM events WHERE event_id % 4 <> 0 AND ts IS NOT NULL GROUP BY 1""",
    "medication_review": rf"""WITH i AS ({_ITEMS}), p AS (SELECT id, f, o_orderpriority AS c, 'for ' || o_orderstatus || CASE WHEN id % 2 = 0 THEN ' use' ELSE '' END || CASE WHEN id % 3 = 0 THEN ' dose' ELSE '' END || '  ' AS t FROM i JOIN orders ON o_orderkey = id),
m AS (SELECT *, list_contains(f, 'i1') AS h1, list_contains(f, 'i2') AS h2, list_contains(f, 'i3') AS h3, list_contains(f, 'i4') AS h4, list_filter(f, lambda x: x NOT IN ('i1', 'i2', 'i3', 'i4')) AS unknown,
  list_contains(f, 'i1') AND (contains('URGENT', c) OR contains(c, 'URGENT')) AS x1, list_contains(f, 'i2') AND (contains('LOW', c) OR contains(c, 'LOW')) AS x2,
  list_contains(f, 'i4') AND (contains('not specified', c) OR contains(c, 'not specified')) AS x4, NOT contains(t, 'use') AS no_use, NOT contains(t, 'dose') AS no_dose FROM p),
g AS (SELECT *, list_filter([CASE WHEN x1 THEN 'contraindication:i1' END, CASE WHEN x2 THEN 'contraindication:i2' END, CASE WHEN x4 THEN 'contraindication:i4' END, CASE WHEN h1 AND h2 OR h3 AND h4 THEN 'drug_interaction' END,
  CASE WHEN (h1 OR h2 OR h3 OR h4) AND (no_use OR no_dose) THEN 'incomplete_fields' END, CASE WHEN len(unknown) > 0 THEN 'unknown_drug' END], lambda x: x IS NOT NULL) AS tags FROM m),
r AS (SELECT *, array_to_string(list_filter([{_TRIM.format('t')}, CASE WHEN x1 THEN 'Not to be taken: i1 with URGENT.' END, CASE WHEN x2 THEN 'Not to be taken: i2 with LOW.' END, CASE WHEN x4 THEN 'Not to be taken: i4 with not specified.' END,
  CASE WHEN h1 AND h2 OR h3 AND h4 THEN 'Interactions:' || chr(10) || array_to_string(list_filter([CASE WHEN h1 AND h2 THEN '  - i1 and i2 interact' END, CASE WHEN h3 AND h4 THEN '  - i3 and i4 interact' END], lambda x: x IS NOT NULL), chr(10)) END,
  {', '.join(f"CASE WHEN h{k} AND (no_use OR no_dose) THEN array_to_string(list_filter([CASE WHEN no_use THEN 'Use of i{k}: see the leaflet.' END, CASE WHEN no_dose THEN 'Dose of i{k}: as told.' END], lambda x: x IS NOT NULL), chr(10)) END" for k in (1, 2, 3, 4))},
  CASE WHEN len(unknown) > 0 THEN 'Not in the rules: ' || array_to_string(unknown, ', ') || '.' END, CASE WHEN h3 AND (contains(t, 'child') OR contains(t, 'O dose')) THEN 'For children: half of it' END, 'Ask a doctor.'], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS v FROM g)
SELECT id, CASE WHEN len(tags) > 0 THEN 'revise' ELSE 'pass' END AS status, array_to_string(tags, ',') AS tags, md5(CASE WHEN len(tags) > 0 THEN v ELSE t END) AS revised_md5 FROM r""",
}
