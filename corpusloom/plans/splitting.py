"""Table-aware splitting: a Markdown document of each customer with orders, and all ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import table_split
from corpusloom.plans.tables import read


def _orders(spark, sf_dir):
    """A heading, a table of the customer's orders and a closing line; every fifth customer's head is no table."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("| "), F.col("o_orderkey").cast("string"), F.lit(" | "), F.col("o_orderstatus"), F.lit(" | "), F.col("o_orderpriority"), F.lit(" |")).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n")
    per = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(body.alias("body"))
    rule = F.when(F.col("doc_id") % 5 == 0, "| no table |").otherwise("| --- | --- | --- |")
    text = F.concat(F.lit("# Orders of "), F.col("doc_id").cast("string"), F.lit("\n\nAll of them:\n| key | status | priority |\n"), rule, F.lit("\n"), F.col("body"), F.lit("\n\nThe end."))
    return per.select("doc_id", F.lit("orders.md").alias("source"), text.alias("text"))


def table_segments(spark, sf_dir):
    s = table_split.segments(_orders(spark, sf_dir).unionByName(read(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("doc_id"), "source", "text")))
    return s.select("doc_id", "segment", "is_table", "first_line", "last_line", F.md5("text").alias("text_md5"))


def table_chunks(spark, sf_dir):
    c = table_split.row_chunks(_orders(spark, sf_dir))
    return c.select("doc_id", "chunk_type", F.coalesce("row", F.lit(-1)).alias("row"), "primary_key", "trace", F.md5("text").alias("text_md5"))


def table_columns(spark, sf_dir):
    return table_split.table_columns(_orders(spark, sf_dir)).select("doc_id", "table_count", F.array_join("table_headers", ",").alias("headers"))


QUERIES = {f.__name__: f for f in (table_segments, table_chunks, table_columns)}

_O = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |' AS line,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
g AS (SELECT doc_id, n, string_agg(line, chr(10) ORDER BY row) AS body, string_agg(line, chr(10) ORDER BY row) FILTER (row < 3) AS shown FROM o GROUP BY doc_id, n)"""
_HEAD = "'| key | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10)"
_CONTEXT = "'文档：orders.md' || chr(10) || '表格：Orders of ' || doc_id || chr(10) || '字段：key, status, priority' || chr(10) || '---' || chr(10)"
ORACLES = {
    "table_segments": f"""WITH {_O}, d AS (
  SELECT doc_id, 0 AS segment, false AS is_table, 0 AS first_line, CASE WHEN doc_id % 5 = 0 THEN 6 + n ELSE 2 END AS last_line,
    '# Orders of ' || doc_id || chr(10) || chr(10) || 'All of them:' || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '| key | status | priority |' || chr(10) || '| no table |' || chr(10) || body || chr(10) || chr(10) || 'The end.' ELSE '' END AS text FROM g
  UNION ALL SELECT doc_id, 1, true, 3, 4 + n, {_HEAD} || body FROM g WHERE doc_id % 5 <> 0
  UNION ALL SELECT doc_id, 2, false, 5 + n, 6 + n, chr(10) || 'The end.' FROM g WHERE doc_id % 5 <> 0
  UNION ALL SELECT -1 - doc_id, 0, false, 0, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')), coalesce(text, '') FROM documents)
SELECT doc_id, segment, is_table, first_line, last_line, md5(text) AS text_md5 FROM d""",
    "table_chunks": f"""WITH {_O}
SELECT doc_id, 'table_row' AS chunk_type, row, k::VARCHAR AS primary_key, 'orders.md | Orders of ' || doc_id || ' | 行' || row || ': ' || k AS trace,
  md5('【表格上下文】' || chr(10) || {_CONTEXT} || {_HEAD} || line || chr(10) || '---' || chr(10) || '摘要：在Orders of ' || doc_id || '中，' || k || '：status' || s || '，priority' || p) AS text_md5 FROM o WHERE doc_id % 5 <> 0
UNION ALL
SELECT doc_id, 'table_overview', -1, NULL, 'orders.md | Orders of ' || doc_id || ' | 概览（前3行）',
  md5('【表格概览】' || chr(10) || {_CONTEXT} || {_HEAD} || shown || CASE WHEN n > 3 THEN chr(10) || '... (共 ' || n || ' 行数据)' ELSE '' END) FROM g WHERE doc_id % 5 <> 0""",
    "table_columns": "SELECT DISTINCT o_custkey AS doc_id, 1 AS table_count, 'key,status,priority' AS headers FROM orders WHERE o_custkey % 5 <> 0",
}
