"""Document metadata from file names, properties, content and file times, cross-checked.

Keyword tables are arguments. A claim is a row (doc_id, field, value, source); claims of any
number of sources are resolved by aggregation, so the sources can be tables of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

#: Sources by falling priority, and fields that describe a source rather than a document.
PRIORITY = {"filename": 4, "file_properties": 3, "llm_content": 2, "filesystem": 1}
ABOUT_SOURCES = ("metadata_source", "effective_date_source", "file_created_date", "file_modified_date")
#: Fixed patterns of file names: title_v1.2_2025-01-31_level, the same without a level, title_date.
NAME_PATTERNS = (
    r"^(.+?)_v(\d+(?:\.\d+)*)_(\d{4}-?\d{2}-?\d{2})_(\w+)$",
    r"^(.+?)_v(\d+(?:\.\d+)*)_(\d{4}-?\d{2}-?\d{2})$",
    r"^(.+?)_(\d{4}-?\d{2}-?\d{2})$",
)


def normalise_date(text: Column) -> Column:
    """YYYY-MM-DD of a text that begins with such a date, with or without hyphens; others as they are."""
    day = r"^(\d{4})-?(\d{2})-?(\d{2})"
    parts = F.concat_ws("-", *[F.regexp_extract(text, day, k) for k in (1, 2, 3)])
    return F.when(text.rlike(day), parts).otherwise(text)


def property_date(text: Column) -> Column:
    """YYYY-MM-DD from the first eight digits, null with fewer (D:20250301120000+08'00')."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    parts = F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    return F.when(F.length(digits) >= 8, parts)


def first_level(text: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """The first level one of whose keywords the text has; null without."""
    out = F.lit(None).cast("string")
    for level, words in reversed(list(keywords.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, F.lit(level)).otherwise(out)
    return out


def normalise_authority(text: Column, keywords: dict[str, Sequence[str]]) -> Column:
    """The level that the text is, or whose keyword it is; else unknown."""
    low = F.lower(F.trim(text))
    out = F.when(low.isin(list(keywords)), low)
    for level, words in keywords.items():
        out = out.when(low.isin(list(words)), F.lit(level))
    return out.otherwise("unknown")


def from_filename(stem: Column, authority: dict[str, Sequence[str]], **keywords: dict[str, Sequence[str]]) -> Column:
    """struct(title, version, effective_date, authority_level, ...): the first pattern that fits, then keywords of the stem."""
    full, dated, short = NAME_PATTERNS
    some = lambda pattern, k: F.regexp_extract(stem, pattern, k)
    pick = lambda a, b, c, other: F.when(stem.rlike(full), a).when(stem.rlike(dated), b).when(stem.rlike(short), c).otherwise(other)
    missing = F.lit(None).cast("string")
    date = pick(some(full, 3), some(dated, 3), some(short, 2), missing)
    level = F.when(stem.rlike(full), normalise_authority(some(full, 4), authority)).otherwise(first_level(stem, authority))
    return F.struct(
        F.trim(pick(some(full, 1), some(dated, 1), some(short, 1), stem)).alias("title"),
        pick(some(full, 2), some(dated, 2), missing, missing).alias("version"), normalise_date(date).alias("effective_date"), level.alias("authority_level"),
        *[first_level(stem, table).alias(name) for name, table in keywords.items()],
    )


def claims_of(rows: DataFrame, source: str, fields: Sequence[str]) -> DataFrame:
    """(doc_id, field, value, source) of the known values of a wide table of one source."""
    long = rows.select("doc_id", *[F.col(f).cast("string").alias(f) for f in fields if f not in ABOUT_SOURCES])
    long = long.unpivot("doc_id", None, "field", "value").filter("value is not null and value not in ('', 'unknown')")
    return long.withColumn("source", F.lit(source))


def resolve(claims: DataFrame, priority: dict[str, int] = PRIORITY) -> DataFrame:
    """(doc_id, field, value, confidence, source, n_sources) of every claimed field.

    One source alone is low; agreement is high; a majority or, without one, the source of best
    priority is mid.
    """
    rank = F.create_map(*[x for k, v in priority.items() for x in (F.lit(k), F.lit(v))])
    known = claims.withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("source")), F.lit(0)))
    per = known.groupBy("doc_id", "field", "value").agg(F.count("*").alias("votes"), F.max(F.struct("rank", "source")).alias("best"))
    by = W.partitionBy("doc_id", "field")
    first = F.row_number().over(by.orderBy(F.col("votes").desc(), F.col("best.rank").desc(), "value"))
    every = per.select("*", first.alias("nth"), F.sum("votes").over(by).alias("n"), F.count("*").over(by).alias("values"), F.max(F.struct("best", "value")).over(by).alias("top"))
    won = every.filter("nth = 1")
    majority = F.col("votes") * 2 > F.col("n")
    value = F.when(majority, F.col("value")).otherwise(F.col("top.value"))
    confidence = F.when(F.col("n") == 1, "low").when(F.col("values") == 1, "high").otherwise("mid")
    source = (
        F.when(F.col("values") == 1, F.col("best.source")).when(majority, "majority_vote").otherwise(F.concat("top.best.source", F.lit("(priority)")))
    )
    return won.select("doc_id", "field", value.alias("value"), confidence.alias("confidence"), source.alias("source"), F.col("n").alias("n_sources"))


def overall_confidence(resolved: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, fields, overall, pending): high if all fields are, mid from ``share`` of them on; pending fields need a look."""
    high = F.count_if(F.col("confidence") == "high")
    out = resolved.groupBy("doc_id").agg(F.count("*").alias("fields"), high.alias("high"))
    level = F.when(F.col("high") == F.col("fields"), "high").when(F.col("high") >= F.col("fields") * share, "mid").otherwise("low")
    return out.select("doc_id", "fields", level.alias("overall"), (F.col("fields") - F.col("high")).alias("pending"))


def applied(chunks: DataFrame, resolved: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``chunks`` (doc_id, ...) with doc_<field> of each field, unknown where nothing was claimed."""
    wide = resolved.groupBy(F.col("doc_id").alias("of_doc")).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"doc_{f}") for f in fields])
    out = chunks.join(wide, F.col("doc_id") == F.col("of_doc"), "left").drop("of_doc")
    return out.withColumns({f"doc_{f}": F.coalesce(f"doc_{f}", F.lit("unknown")) for f in fields})
