"""Metadata queries: parts as documents with made-up file names, properties and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import metadata as m
from corpusloom.plans.tables import read

AUTHORITY = {"national": ["BRUSHED", "gov"], "society": ["STEEL", "soc"], "faq": ["TIN"]}
KINDS = {"metal": ["COPPER", "BRASS", "NICKEL"], "other": ["PLATED"]}


def _files(spark, sf_dir):
    """File names of all four shapes."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 500).cast("int")), "yyyy-MM-dd")
    day = F.when(k % 2 == 0, F.replace(day, F.lit("-"), F.lit(""))).otherwise(day)
    name = F.col("p_type")
    stem = (
        F.when(k % 4 == 0, F.concat_ws("_", name, F.concat(F.lit("v"), (k % 7).cast("string"), F.lit(".1")), day, F.element_at(F.array(*map(F.lit, ["Gov", "society", "soc", "blog"])), (k % 16 / 4 + 1).cast("int"))))
        .when(k % 4 == 1, F.concat_ws("_", name, F.concat(F.lit("v"), (k % 5).cast("string")), day)).when(k % 4 == 2, F.concat_ws("_", name, day)).otherwise(name)
    )
    return p.select(k.alias("doc_id"), "p_size", stem.alias("stem"), F.concat(F.lit("D:"), F.replace(day, F.lit("-"), F.lit("")), F.lit("0930+08'00'")).alias("made"))


def filename_metadata(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", m.from_filename(F.col("stem"), AUTHORITY, kind=KINDS).alias("m")).select("doc_id", "m.*")


def _resolved(spark, sf_dir):
    f, k = _files(spark, sf_dir), F.col("doc_id")
    names = f.select("doc_id", m.from_filename(F.col("stem"), AUTHORITY, kind=KINDS).alias("m")).select("doc_id", "m.effective_date", "m.authority_level", "m.title")
    properties = f.select("doc_id", F.when(k % 3 != 0, m.property_date(F.col("made"))).alias("effective_date"), F.when(k % 5 == 0, "faq").otherwise("unknown").alias("authority_level"))
    content = f.select("doc_id", F.when(k % 6 == 1, "2020-02-02").alias("effective_date"), F.when(k % 2 == 0, "faq").when(k % 7 == 0, "society").alias("authority_level"))
    times = f.select("doc_id", F.when(k % 4 == 3, "2024-03-03").alias("effective_date"), F.lit("x").alias("file_modified_date"))
    parts = [(names, "filename"), (properties, "file_properties"), (content, "llm_content"), (times, "filesystem")]
    out = None
    for df, source in parts:
        c = m.claims_of(df, source, [x for x in df.columns if x != "doc_id"])
        out = c if out is None else out.unionByName(c)
    return m.resolve(out)


def metadata_resolved(spark, sf_dir):
    return _resolved(spark, sf_dir)


def metadata_confidence(spark, sf_dir):
    return m.overall_confidence(_resolved(spark, sf_dir))


def metadata_applied(spark, sf_dir):
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("doc_id"))
    return m.applied(l, _resolved(spark, sf_dir), ["effective_date", "authority_level"])


QUERIES = {f.__name__: f for f in (filename_metadata, metadata_resolved, metadata_confidence, metadata_applied)}

_LEVEL = "CASE WHEN contains(stem, 'BRUSHED') OR contains(stem, 'gov') THEN 'national' WHEN contains(stem, 'STEEL') OR contains(stem, 'soc') THEN 'society' WHEN contains(stem, 'TIN') THEN 'faq' END"
_NAMES = rf"""d AS (SELECT p_partkey AS k, p_type AS name, CASE WHEN p_partkey % 2 = 0 THEN strftime(DATE '2024-01-01' + (p_partkey % 500)::INT, '%Y%m%d') ELSE strftime(DATE '2024-01-01' + (p_partkey % 500)::INT, '%Y-%m-%d') END AS day,
  strftime(DATE '2024-01-01' + (p_partkey % 500)::INT, '%Y-%m-%d') AS iso FROM part),
f AS (SELECT *, CASE k % 4 WHEN 0 THEN name || '_v' || (k % 7) || '.1_' || day || '_' || ['Gov', 'society', 'soc', 'blog'][(k % 16) // 4 + 1] WHEN 1 THEN name || '_v' || (k % 5) || '_' || day WHEN 2 THEN name || '_' || day ELSE name END AS stem FROM d),
n AS (SELECT k AS doc_id, iso, name AS title, CASE k % 4 WHEN 0 THEN (k % 7) || '.1' WHEN 1 THEN (k % 5)::VARCHAR END AS version, CASE WHEN k % 4 <> 3 THEN iso END AS effective_date,
  CASE WHEN k % 4 = 0 THEN ['national', 'society', 'society', 'unknown'][(k % 16) // 4 + 1] ELSE {_LEVEL} END AS authority_level,
  CASE WHEN contains(stem, 'COPPER') OR contains(stem, 'BRASS') OR contains(stem, 'NICKEL') THEN 'metal' WHEN contains(stem, 'PLATED') THEN 'other' END AS kind FROM f)"""
_RESOLVED = f"""{_NAMES}, claims AS (SELECT doc_id, 'effective_date' AS field, effective_date AS value, 'filename' AS source, 4 AS rank FROM n UNION ALL SELECT doc_id, 'authority_level', authority_level, 'filename', 4 FROM n
  UNION ALL SELECT doc_id, 'title', title, 'filename', 4 FROM n UNION ALL SELECT doc_id, 'effective_date', iso, 'file_properties', 3 FROM n WHERE doc_id % 3 <> 0
  UNION ALL SELECT doc_id, 'authority_level', 'faq', 'file_properties', 3 FROM n WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'effective_date', '2020-02-02', 'llm_content', 2 FROM n WHERE doc_id % 6 = 1
  UNION ALL SELECT doc_id, 'authority_level', CASE WHEN doc_id % 2 = 0 THEN 'faq' ELSE 'society' END, 'llm_content', 2 FROM n WHERE doc_id % 2 = 0 OR doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'effective_date', '2024-03-03', 'filesystem', 1 FROM n WHERE doc_id % 4 = 3),
kept AS (SELECT * FROM claims WHERE value IS NOT NULL AND value <> 'unknown'),
v AS (SELECT doc_id, field, value, count(*) AS votes, max(rank) AS rank, arg_max(source, rank) AS source FROM kept GROUP BY ALL),
w AS (SELECT doc_id, field, sum(votes)::BIGINT AS n, count(*) AS nv, max(votes) AS most, arg_max(value, votes) AS common, arg_max(value, rank) AS top, arg_max(source, rank) AS top_source FROM v GROUP BY ALL),
resolved AS (SELECT doc_id, field, CASE WHEN most * 2 > n THEN common ELSE top END AS value, CASE WHEN n = 1 THEN 'low' WHEN nv = 1 THEN 'high' ELSE 'mid' END AS confidence,
  CASE WHEN nv = 1 THEN top_source WHEN most * 2 > n THEN 'majority_vote' ELSE top_source || '(priority)' END AS source, n AS n_sources FROM w)"""

ORACLES = {
    "filename_metadata": f"WITH {_NAMES} SELECT doc_id, title, version, effective_date, authority_level, kind FROM n",
    "metadata_resolved": f"WITH {_RESOLVED} SELECT * FROM resolved",
    "metadata_confidence": f"""WITH {_RESOLVED}, c AS (SELECT doc_id, count(*) AS fields, count(*) FILTER (confidence = 'high') AS high FROM resolved GROUP BY 1)
SELECT doc_id, fields, CASE WHEN high = fields THEN 'high' WHEN high >= fields * 0.6 THEN 'mid' ELSE 'low' END AS overall, fields - high AS pending FROM c""",
    "metadata_applied": f"""WITH {_RESOLVED} SELECT l_orderkey, l_linenumber, l_partkey AS doc_id, coalesce(e.value, 'unknown') AS doc_effective_date, coalesce(a.value, 'unknown') AS doc_authority_level FROM lineitem
LEFT JOIN resolved e ON e.doc_id = l_partkey AND e.field = 'effective_date' LEFT JOIN resolved a ON a.doc_id = l_partkey AND a.field = 'authority_level'""",
}
