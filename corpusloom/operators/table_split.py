"""Documents cut into prose and Markdown tables, and tables into an overview and a chunk for each row.

A table begins, in a run of adjacent lines between bars, at the first line that a separator line
follows, and goes on to the end of the run; lines of the run before it are prose. All steps are
windows over a document's lines. Segments of a document, joined by line breaks, give it back.
Documents are dealt over tasks of about TASK_CHARS, so a task's windows don't grow with the input.

Defined cases: null text is one empty line of prose; a table whose head is a separator or that
has no row besides separators is kept whole; its last separator line stands in every chunk; a
table's title is the nearest heading within ABOVE lines before it; cells beyond the shorter of
head and row are left out of the summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.operators.chunking import lines

ROW = r"^\s*\|.+\|\s*$"
SEPARATOR = r"^\s*\|[\s\-:]+\|[\s\-:|]*\|\s*$"
TASK_CHARS = 1 << 21
ABOVE = 9
SHOWN = 3
#: Heads of the first column that tell a table of comparisons, whose columns are the things compared.
DIMENSIONS = ("项目", "症状", "指标", "参数", "类型", "特征", "区别", "方面")


def marked_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, line, is_row, is_sep, head): head is the first line of the table that a line belongs to."""
    in_doc = W.partitionBy("doc_id").orderBy("n")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = docs.select("doc_id", "text").repartition(max(1, -(-chars // TASK_CHARS)), "doc_id")
    rows = lines(dealt).withColumns({"is_row": F.col("line").rlike(ROW), "is_sep": F.col("line").rlike(SEPARATOR)})
    # lines of a run share the number of other lines before them
    rows = rows.withColumn("run", F.sum((~F.col("is_row")).cast("int")).over(in_doc.rowsBetween(W.unboundedPreceding, 0)))
    follows = F.lead("is_sep").over(in_doc) & F.col("is_row") & (F.lead("run").over(in_doc) == F.col("run"))
    head = F.min(F.when(F.col("opens"), F.col("n"))).over(W.partitionBy("doc_id", "run"))
    rows = rows.withColumn("opens", F.coalesce(follows, F.lit(False))).withColumn("head", head)
    return rows.withColumn("head", F.when(F.col("is_row") & (F.col("n") >= F.col("head")), F.col("head"))).drop("run", "opens")


def _joined(order: str, line: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n")


def segments(docs: DataFrame) -> DataFrame:
    """(doc_id, segment, is_table, first_line, last_line, text) of every document, segments from 0."""
    in_doc = W.partitionBy("doc_id").orderBy("n")
    rows = marked_lines(docs)
    kind = F.coalesce("head", F.lit(-1))
    rows = rows.withColumn("new", (kind != F.coalesce(F.lag(kind).over(in_doc), F.lit(-2))).cast("int"))
    rows = rows.withColumn("segment", F.sum("new").over(in_doc.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return rows.groupBy("doc_id", "segment").agg(
        F.max(F.col("head").isNotNull()).alias("is_table"), F.min("n").alias("first_line"), F.max("n").alias("last_line"), _joined("n", "line").alias("text")
    )


def cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), lambda c: F.trim(c))


def table_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, head, title, columns, separator, row, line): each row of each table, from 0, with what it needs to stand alone.

    A table that is kept whole has one row of number -1 with its text as ``line``.
    """
    in_doc, up_to = W.partitionBy("doc_id").orderBy("n"), (W.unboundedPreceding, -1)
    mark = F.when(F.trim("line").startswith("#"), F.struct("n", F.trim(F.regexp_replace(F.trim("line"), "^#+", "")).alias("title")))
    rows = marked_lines(docs).withColumn("above", F.last(mark, ignorenulls=True).over(in_doc.rowsBetween(*up_to)))
    rows = rows.filter("head is not null")
    near = (F.col("n") == F.col("head")) & (F.col("head") - F.col("above.n") <= ABOVE)
    of = W.partitionBy("doc_id", "head")
    first = lambda c: F.max(F.when(F.col("n") == F.col("head"), c)).over(of)
    data = ~F.col("is_sep") & (F.col("n") > F.col("head"))
    rows = rows.withColumns({
        "title": F.coalesce(F.max(F.when(near, F.col("above.title"))).over(of), F.lit("")), "head_line": first(F.col("line")), "broken": first(F.col("is_sep")),
        "separator": F.max_by(F.when(F.col("is_sep"), F.col("line")), F.when(F.col("is_sep"), F.col("n"))).over(of),
        "data": data, "n_rows": F.count_if(data).over(of),
    })
    whole = F.col("broken") | (F.col("n_rows") == 0)
    kept = rows.filter(whole).groupBy("doc_id", "head", "title", "head_line", "separator", "n_rows").agg(_joined("n", "line").alias("line")).withColumn("row", F.lit(-1))
    split = rows.filter(~whole & F.col("data")).withColumn("row", F.row_number().over(W.partitionBy("doc_id", "head").orderBy("n")) - 1)
    shape = ["doc_id", "head", "title", "head_line", "separator", "n_rows", "row", "line"]
    return split.select(*shape).unionByName(kept.select(*shape))


def summary(headers: Column, values: Column, title: Column) -> Column:
    """A sentence that names the row by its first cell and tells the others."""
    pair = lambda link: F.filter(F.zip_with(F.slice(headers, 2, 1 << 30), F.slice(values, 2, 1 << 30), lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit(link), v))), lambda x: x.isNotNull())
    compares = F.element_at(headers, 1).isin(list(DIMENSIONS))
    told = F.when(compares, F.array_join(pair("为"), "，")).otherwise(F.array_join(pair(""), "，"))
    key = F.element_at(values, 1)
    line = F.when(told == "", key).otherwise(F.concat(key, F.lit("："), told))
    return F.when(title == "", line).otherwise(F.concat(F.lit("在"), title, F.lit("中，"), line))


def row_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, head, chunk_type, row, primary_key, trace, text) of every table of documents (doc_id, source, text).

    chunk_type: table_overview, table_row, or table for one that is kept whole.
    """
    rows = table_lines(docs).join(docs.select("doc_id", F.coalesce("source", F.lit("未知文档")).alias("source")), "doc_id")
    headers = cells(F.col("head_line"))
    named = F.when(F.col("title") == "", F.lit("")).otherwise(F.concat(F.lit("表格："), F.col("title"), F.lit("\n")))
    context = F.concat(F.lit("文档："), F.col("source"), F.lit("\n"), named, F.lit("字段："), F.array_join(headers, ", "))
    rows = rows.withColumns({"context": context, "headers": headers, "values": cells(F.col("line"))})
    key = F.when(F.col("row") >= 0, F.element_at("values", 1))
    text = F.concat(F.lit("【表格上下文】\n"), F.col("context"), F.lit("\n---\n"), F.concat_ws("\n", "head_line", "separator", "line"), F.lit("\n---\n摘要："), summary(F.col("headers"), F.col("values"), F.col("title")))
    trace = F.concat(F.col("source"), F.lit(" | "), F.col("title"), F.lit(" | 行"), F.col("row").cast("string"), F.lit(": "), key)
    shape = ["doc_id", "head", "chunk_type", "row", "primary_key", "trace", "text"]
    one = rows.select(
        "doc_id", "head", F.when(F.col("row") >= 0, "table_row").otherwise("table").alias("chunk_type"), F.when(F.col("row") >= 0, F.col("row")).alias("row"),
        key.alias("primary_key"), F.when(F.col("row") >= 0, trace).alias("trace"), F.when(F.col("row") >= 0, text).otherwise(F.col("line")).alias("text"),
    )
    shown = rows.filter((F.col("row") >= 0) & (F.col("row") < SHOWN)).groupBy("doc_id", "head", "source", "title", "head_line", "separator", "n_rows", "context").agg(_joined("row", "line").alias("body"))
    more = F.when(F.col("n_rows") > SHOWN, F.concat(F.lit("\n... (共 "), F.col("n_rows").cast("string"), F.lit(" 行数据)"))).otherwise(F.lit(""))
    overview = shown.select(
        "doc_id", "head", F.lit("table_overview").alias("chunk_type"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("string").alias("primary_key"),
        F.concat(F.col("source"), F.lit(" | "), F.col("title"), F.lit(f" | 概览（前{SHOWN}行）")).alias("trace"),
        F.concat(F.lit("【表格概览】\n"), F.col("context"), F.lit("\n---\n"), F.concat_ws("\n", "head_line", "separator", "body"), more).alias("text"),
    )
    return one.select(*shape).unionByName(overview.select(*shape))


def table_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, table_count, table_headers) of documents with tables, headers once each in order."""
    heads = marked_lines(docs).filter(F.col("n") == F.col("head")).select("doc_id", "n", cells(F.trim("line")).alias("h"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("n", "h"))), lambda x: x["h"])
    return heads.groupBy("doc_id").agg(F.count("*").alias("table_count"), F.array_distinct(F.flatten(every)).alias("table_headers"))
