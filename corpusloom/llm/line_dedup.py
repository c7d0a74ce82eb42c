"""Line dedup over a suffix array of line ids (DataFrame operations only).

A document is the sequence of its lines; blank lines carry no id and are skipped. Line ids
are ranks of line digests. Prefix doubling sorts the suffixes of all sequences: a suffix's
rank to depth 2d is the rank of (its rank to depth d, the rank to depth d of the suffix d
lines on). Ranks come from a range-partitioned sort of the distinct pairs, so no group of
equal suffixes is ever gathered: a pair that a third of the corpus shares is one row.

Suffixes with the same rank to depth d form an LCP interval of at least d. A suffix alone
in its interval is settled and leaves, so each round works on what still repeats. In an
interval, the suffix earliest by (doc_id, line) is the original; every other one is a later
copy of a run of d lines. The copies of all depths from ``min_lines`` up, merged where they
touch, are the maximal repeated runs, and they are deleted. So are later copies of a single
line of ``min_words`` words or more: a passage that long repeats on its own account, while
short lines (headings, greetings, list marks) stay unless a run repeats.

Defined cases: documents are ordered by doc_id (null first), then by a digest of the text;
rows with equal doc_id and text count as one document and come back alike; null text stays
null, empty text stays empty; a run may repeat within one document; blank lines between two
deleted lines of a run go with it, other blank lines stay. The first occurrence of a line
is never deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch, free_names

NOT_BLANK = r"[^\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
MIN_LINES = 2
#: A repeated line of so many words is a repeated passage by itself; None: single lines stay.
MIN_WORDS = 50
DOC = ("doc_id", "dh")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _filled(lines: Column) -> Column:
    """Places of the lines that aren't blank."""
    numbered = F.transform(lines, lambda x, i: F.when(x.rlike(NOT_BLANK), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _same_doc(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.dh") == F.col(f"{b}.dh"))


def _ranked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank``, a number that rises with the keys, by a distributed sort of distinct keys."""
    return groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has, with the earliest such row, ranked in key order."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*DOC, "i")).alias("first"))
    return _ranked(groups.filter("n > 1").drop("n"), keys)


def suffix_levels(docs: DataFrame, scratch: Scratch, min_words: int | None = None):
    """Yields (depth, table) for depths 1, 2, 4, ... while any suffix shares so long a prefix.

    table: (doc_id, dh, i, rank, first), a row per suffix in an LCP interval of that depth; at
    depth 1 also wordy, whether the line has ``min_words`` words.
    """
    text = docs.select("doc_id", F.xxhash64("text").alias("dh"), "text").filter("text is not null")
    lines = text.select("doc_id", "dh", _lines(F.col("text")).alias("lines"))
    lines = lines.select("doc_id", "dh", "lines", F.posexplode(_filled(F.col("lines"))).alias("i", "p"))
    line = F.element_at("lines", F.col("p") + 1)
    wordy = F.lit(False) if min_words is None else (F.length(line) >= 2 * min_words - 1) & (F.regexp_count(line, F.lit(WORD)) >= min_words)
    ids = lines.select("doc_id", "dh", "i", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), wordy.alias("wordy"))
    ids = scratch.table(ids.dropDuplicates(["doc_id", "dh", "i"]))
    level = scratch.table(ids.join(scratch.table(_repeated(ids, ["h1", "h2"])), ["h1", "h2"]).drop("h1", "h2"))
    scratch.drop(ids)
    depth = 1
    while not level.isEmpty():
        yield depth, level
        a, b = level.alias("a"), level.alias("b")
        pairs = scratch.table(
            a.join(b, _same_doc("a", "b") & (F.col("a.i") + depth == F.col("b.i"))).select(
                "a.doc_id", "a.dh", "a.i", F.col("a.rank").alias("r1"), F.col("b.rank").alias("r2")
            )
        )
        groups = scratch.table(_repeated(pairs, ["r1", "r2"]))
        level = scratch.table(pairs.join(groups, ["r1", "r2"]).drop("r1", "r2"))
        scratch.drop(pairs, groups)
        depth *= 2


def later_copies(docs: DataFrame, min_lines: int, scratch: Scratch, min_words: int | None = None) -> DataFrame:
    """(doc_id, dh, i, n, first): n lines from i repeat those at ``first``, which is earlier."""
    copies = None
    later = "not (doc_id <=> first.doc_id and dh = first.dh and i = first.i)"
    for depth, level in suffix_levels(docs, scratch, min_words):
        found = level
        if depth == 1 < min_lines and min_words is not None:
            copies = level.filter("wordy").filter(later).select(*DOC, "i", F.lit(1).alias("n"), "first")
        if depth < min_lines:
            if 2 * depth <= min_lines:
                continue
            # min_lines lines are two overlapping stretches of this depth
            a, b = level.alias("a"), level.alias("b")
            pairs = a.join(b, _same_doc("a", "b") & (F.col("a.i") + (min_lines - depth) == F.col("b.i"))).select(
                "a.doc_id", "a.dh", "a.i", F.col("a.rank").alias("r1"), F.col("b.rank").alias("r2")
            )
            pairs = scratch.table(pairs)
            found = pairs.join(_repeated(pairs, ["r1", "r2"]), ["r1", "r2"])
        part = found.filter(later).select(
            *DOC, "i", F.lit(max(depth, min_lines)).alias("n"), "first"
        )
        copies = part if copies is None else copies.unionByName(part)
    if copies is None:
        empty = docs.select("doc_id", F.xxhash64("text").alias("dh"), F.lit(0).alias("i"), F.lit(0).alias("n")).limit(0)
        return empty.withColumn("first", F.struct(*DOC, "i"))
    return copies.groupBy(*DOC, "i").agg(F.max(F.struct("n", "first")).alias("longest")).select(*DOC, "i", "longest.*")


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """Maximal runs to delete: (doc_id, dh, start, stop, first) by places among filled lines.

    ``stop`` is exclusive; ``first`` is where the longest match of the run's start occurs first.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    copies = later_copies(docs, min_lines, scratch, min_words)
    in_doc = W.partitionBy(*DOC).orderBy("i")
    reach = F.max(F.col("i") + F.col("n")).over(in_doc.rowsBetween(W.unboundedPreceding, -1))
    runs = copies.withColumn("reach", reach).withColumn(
        "run", F.sum(F.when(F.col("reach") >= F.col("i"), 0).otherwise(1)).over(in_doc.rowsBetween(W.unboundedPreceding, 0))
    )
    return runs.groupBy(*DOC, "run").agg(
        F.min("i").alias("start"), F.max(F.col("i") + F.col("n")).alias("stop"), F.min_by("first", "i").alias("first")
    ).drop("run")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, detail: bool = False, min_words: int | None = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text`` and ``n_chars``, if present, set anew.

    detail: adds n_lines (filled lines before), n_deleted and longest_run, in place of columns
    of these names. Other columns come back as they are, whatever their names.
    """
    r_id, r_dh, of_cuts, dh, of_lines, of_filled = free_names(docs, 6)
    runs = repeated_runs(docs, min_lines, min_words).select(
        F.col("doc_id").alias(r_id), F.col("dh").alias(r_dh), F.struct("start", "stop").alias("run")
    )
    runs = runs.groupBy(r_id, r_dh).agg(F.sort_array(F.collect_list("run")).alias(of_cuts))
    out = docs.withColumn(dh, F.xxhash64("text")).join(
        runs, F.col("doc_id").eqNullSafe(F.col(r_id)) & (F.col(dh) == F.col(r_dh)), "left"
    )
    cuts, lines, filled = F.col(of_cuts), F.col(of_lines), F.col(of_filled)
    out = out.withColumn(of_lines, _lines(F.col("text"))).withColumn(of_filled, _filled(lines))
    # the lines from the end of one cut to the start of the next
    edges = F.sequence(F.lit(0), F.size(cuts))
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(filled, F.get(cuts, j - 1)["stop"] - 1) + 1)
    end = lambda j: F.when(j == F.size(cuts), F.size(lines)).otherwise(F.get(filled, F.get(cuts, j)["start"]))
    kept = F.flatten(F.transform(edges, lambda j: F.slice(lines, begin(j) + 1, end(j) - begin(j))))
    text = F.when(cuts.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cuts.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    if detail:
        none = F.array().cast("array<int>")
        lengths = F.coalesce(F.transform(cuts, lambda c: c["stop"] - c["start"]), none)
        new |= {
            "n_lines": F.coalesce(F.size(filled), F.lit(0)),
            "n_deleted": F.aggregate(lengths, F.lit(0), lambda s, x: s + x),
            "longest_run": F.coalesce(F.array_max(lengths), F.lit(0)),
        }
    extra = [k for k in new if k not in docs.columns]
    return out.withColumns(new).select(*docs.columns, *extra)
