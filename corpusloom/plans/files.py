"""Queries over pages, and batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.tables import read
from corpusloom.sources import files
from corpusloom.streaming import logs


def html_tables(spark, sf_dir):
    """Whole pages, which hold no table of their own, each with one made of its number and address at the end."""
    rows = "<table class=x><tr><th>id</th><th>about</th></tr>\n<tr><td>%d</td><td> <b>u&amp;v</b> %d </td></tr><tr><td>last</td></tr></table>"
    pages = read(spark, sf_dir, "pages")
    pages = pages.withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.format_string(rows, "page_id", F.col("page_id") % 7)))
    return files.html_tables(pages).select("page_id", "n", F.md5("table").alias("table_md5"))


def markdown_nations(spark, sf_dir):
    return files.markdown_table(read(spark, sf_dir, "nation").withColumn("empty", F.lit(None).cast("string")), "n_nationkey")


def event_windows(spark, sf_dir):
    return logs.windowed_stats(read(spark, sf_dir, "events"), width="6 hours").select("start", "event_type", "n", F.round("total", 4).alias("total"))


def rate_limit(spark, sf_dir):
    return logs.limited_batch(read(spark, sf_dir, "events"), 2, 36000)


QUERIES = {f.__name__: f for f in (html_tables, markdown_nations, event_windows, rate_limit)}
ORACLES = {
    "html_tables": """SELECT page_id, 0 AS n, md5('| id | about |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | u&v ' || (page_id % 7) || ' |' || chr(10) || '| last |  |') AS table_md5 FROM pages""",
    "markdown_nations": "SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS \"table\" FROM nation",
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
