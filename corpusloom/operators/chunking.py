"""Markdown structure, tables, and packing of lines into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

_SEPARATOR = r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n, line) of every document, n from 0."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "line"))


def sections(docs: DataFrame, header: str) -> DataFrame:
    """Documents cut before each line that ``header`` matches: (doc_id, section, title, text)."""
    found = lines(docs).withColumn("is_header", F.col("line").rlike(header))
    in_doc = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    found = found.withColumn("section", F.sum(F.col("is_header").cast("int")).over(in_doc))
    return found.groupBy("doc_id", "section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"),
        F.max(F.when(F.col("is_header"), F.col("line"))).alias("title"),
    )


def tables(docs: DataFrame, mark: str = "|") -> DataFrame:
    """Runs of two or more adjacent lines with ``mark``: (doc_id, first_line, last_line, headers)."""
    found = lines(docs).filter(F.contains("line", F.lit(mark)))
    run = F.col("n") - F.row_number().over(W.partitionBy("doc_id").orderBy("n"))
    out = found.withColumn("run", run).groupBy("doc_id", "run").agg(
        F.min("n").alias("first_line"), F.max("n").alias("last_line"), F.min_by("line", "n").alias("head"), F.count("*").alias("c")
    )
    cells = F.filter(F.transform(F.split("head", r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return out.filter("c > 1").select("doc_id", "first_line", "last_line", cells.alias("headers"))


def is_separator(line: Column) -> Column:
    return line.rlike(_SEPARATOR)


def row_summaries(rows: DataFrame) -> DataFrame:
    """``title: header=cell, ...`` for rows of (row_id, title, headers, cells); empty cells are left out."""
    pairs = F.filter(F.zip_with("headers", "cells", lambda h, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(h, F.lit("="), c))), lambda x: x.isNotNull())
    return rows.select("row_id", F.concat(F.col("title"), F.lit(": "), F.array_join(pairs, ", ")).alias("summary"))


def pack(items: Column, most: int) -> Column:
    """Strings joined by newlines into groups of at most ``most`` characters, in order; a longer one stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, x):
        fits = (acc["now"] == "") | (F.length(acc["now"]) + 1 + F.length(x) <= most)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"),
            F.when(~fits | (acc["now"] == ""), x).otherwise(F.concat(acc["now"], F.lit("\n"), x)).alias("now"),
        )

    return F.aggregate(items, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))


def children(docs: DataFrame, most: int = 150) -> DataFrame:
    """(doc_id, child, text): filled lines packed to at most ``most`` characters."""
    filled = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(pack(filled, most)).alias("child", "text"))


def _split(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    mark = next((s for s in separators if s in text), "")
    rest = separators[separators.index(mark) + 1 :] if mark in separators else ()
    parts = text.split(mark) if mark else list(text)
    out: list[str] = []
    held: list[str] = []

    def flush():
        if joined := mark.join(held).strip():
            out.append(joined)

    for part in parts:
        if len(part) > size and mark:
            flush()
            held.clear()
            out += _split(part, size, overlap, rest)
            continue
        while held and len(mark.join([*held, part])) > size:
            flush()
            while held and (len(mark.join(held)) > overlap or len(mark.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def recursive_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> DataFrame:
    """(doc_id, chunk, text): cut at the coarsest separator that helps, then at finer ones, with overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [_split(t, size, overlap, separators) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "cut": cut})

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(run, "id string, cut array<string>")
    return found.select(F.col("id").cast("long").alias("doc_id"), F.posexplode("cut").alias("chunk", "text"))


def fill_down(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Nulls take the last value above them in their group."""
    above = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(above))
