"""Files as tables: text in several encodings, Markdown, CSV, JSON lines, HTML tables, and writers.

Readers list paths through Spark, so any store it reaches will do. Formats that need a parser
from outside (PDF, Word, spreadsheets, scans) take it as a function of bytes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.shadow import Pointer

#: Tried in order; the first that decodes wins.
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-8-sig")

TEST_SET = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "query", "golden_label", "category", "difficulty")])


def decoded(raw: bytes, encodings: Sequence[str] = ENCODINGS) -> str | None:
    for name in encodings:
        try:
            return raw.decode(name).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return None


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}", encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """(path, text, modified_at); text is null where no encoding fits."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        return pd.Series([decoded(bytes(c), encodings) for c in content], dtype=object)

    return read_binary(spark, path, pattern).select("path", text("content").alias("text"), F.col("modificationTime").alias("modified_at"))


def read_with(spark: SparkSession, path: str, pattern: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, part, text) of files that ``parse`` turns into texts, such as pages or sheets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, t) for p, c in zip(batch["path"], batch["content"], strict=True) for k, t in enumerate(parse(bytes(c)))]
            yield pd.DataFrame(rows, columns=["path", "part", "text"])

    return read_binary(spark, path, pattern).select("path", "content").mapInPandas(run, "path string, part int, text string")


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    return spark.read.option("header", "true").option("encoding", encoding).csv(path)


def read_test_set(spark: SparkSession, path: str, schema: T.StructType = TEST_SET) -> DataFrame:
    return spark.read.schema(schema).json(path)


def markdown_table(rows: DataFrame, order: str, most: int = 200) -> DataFrame:
    """One row: the first ``most`` rows as a Markdown table, columns without values left out."""
    some = rows.orderBy(order).limit(most)
    counts = some.select([F.count(c).alias(c) for c in some.columns]).first().asDict()
    cols = [c for c in some.columns if counts[c]]
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in cols]
    body = some.select(F.col(order).alias("_o"), line(cells).alias("line"))
    head = f"| {' | '.join(cols)} |\n| {' | '.join('---' for _ in cols)} |"
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_o", "line"))), lambda x: x["line"])
    return body.agg(F.concat_ws("\n", F.lit(head), F.array_join(ordered, "\n")).alias("table"))


_TABLE, _ROW, _CELL, _TAG = (re.compile(p, re.I | re.S) for p in (r"<table.*?</table>", r"<tr.*?</tr>", r"<t[dh][^>]*>(.*?)</t[dh]>", r"<[^>]+>"))


def tables_in(page: str) -> list[str]:
    """The tables of a page as Markdown, short rows filled up."""
    out = []
    for table in _TABLE.findall(page):
        rows = [[" ".join(html.unescape(_TAG.sub(" ", c)).split()) for c in _CELL.findall(r)] for r in _ROW.findall(table)]
        rows = [r for r in rows if r]
        if rows:
            wide = max(map(len, rows))
            lines = [f"| {' | '.join(r + [''] * (wide - len(r)))} |" for r in rows]
            out.append("\n".join([lines[0], f"|{' --- |' * wide}", *lines[1:]]))
    return out


def html_tables(pages: DataFrame) -> DataFrame:
    """(page_id, n, table) of every table in ``html``."""

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([tables_in(t or "") for t in text], dtype=object)

    return pages.select("page_id", F.posexplode(found("html")).alias("n", "table"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_pointer(spark: SparkSession, path: str, current: str, previous: str | None) -> None:
    """Names the live collection and the one before; what was named before stays whole until then."""
    pointer = Pointer(spark, path)
    held = pointer.read()
    if not pointer.write({"current": current, "previous": previous}, held[0] if held else None):
        raise RuntimeError("another switch came first")


def read_pointer(spark: SparkSession, path: str) -> tuple[str, str | None]:
    _, held = Pointer(spark, path).read()
    return held["current"], held["previous"]


def switch(spark: SparkSession, path: str, new: str) -> None:
    write_pointer(spark, path, new, read_pointer(spark, path)[0])


def roll_back(spark: SparkSession, path: str) -> None:
    current, previous = read_pointer(spark, path)
    if previous is None:
        raise ValueError("there is no previous collection")
    write_pointer(spark, path, previous, current)
