"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Each document of a source expects ``target / source_size`` copies. The expectations are
prefix-summed within the source, one offset per source is added, and a document is emitted
once per integer boundary that its stretch of the sum crosses. Documents are laid out by
size, so the words taken stay within about one document of the target.

The prefix sum never gathers a source: rows are range-partitioned by source, size and id,
each row knows its place in its partition, and the counts of the partitions before it are
added from a table with one row per partition and source.

Defined cases: null text has size 0; a null source is a source of its own, ordered last;
rows with equal ids, sizes and texts are interchangeable; an empty table gives no rows;
if all sizes are 0, all targets and copies are 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.scratch import Scratch, free_names

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(source: Column) -> Column:
    """The random offset of a source in [0, 1), the same in every run."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2
) -> DataFrame:
    """(source, source_size, target, rate, shift) from (source, size); one row per source.

    Targets share ``share`` times all sizes by weight, stop at ``most`` times the source's
    size, and what lies above is shared anew. Sources in order of the level at which they
    fill up make that a prefix sum: the first that doesn't fill up gives the level, the
    highest of those that don't. The window holds one small row per source, never documents.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    scale = 1
    for w in weights:
        scale *= w
    nth = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), nth.cast("int") + 1)
    s = totals.select("*", weight.cast("long").alias("weight")).withColumn(
        "cap", F.col("source_size") * most
    )
    fills = (F.expr(f"cap * {scale} div weight").asc(), F.col("source").asc_nulls_last())
    before = W.orderBy(*fills).rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy(*fills).rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(*fills).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.select(
        "*",
        (
            (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(from_here)
        ).alias("level"),
    )
    s = s.withColumn(
        "water",
        F.max(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.col("level"))).over(everything),
    )
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce("water", F.lit(float("inf"))))
    s = s.select("source", "source_size", target.alias("target"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.select("*", rate.alias("rate"), offset_of(F.col("source")).alias("shift"))


def mix_plan(docs: DataFrame, scratch: Scratch | None = None, **targets) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies, taken), a row per document.

    ``docs`` needs doc_id, text and source; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    sized = scratch.table(
        docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), word_count(F.col("text")).alias("size"))
    )
    order = [F.col(c).asc_nulls_last() for c in ("source", "size", "doc_id", "text_key")]
    placed = scratch.table(
        sized.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    runs = placed.groupBy("source", "part").agg(F.min("at").alias("first_at"), F.count("*").alias("n"))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    rates = source_targets(sized, **targets).withColumnRenamed("source", "of_source")
    runs = runs.join(rates, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source", "n")
    runs = runs.withColumnsRenamed({"source": "run_source", "part": "run_part"})
    rows = placed.join(runs, (F.col("part") == F.col("run_part")) & F.col("source").eqNullSafe(F.col("run_source")))
    place = F.col("ahead") + F.col("at") - F.col("first_at")
    crossed = F.floor((place + 1) * F.col("rate") + F.col("shift")) - F.floor(place * F.col("rate") + F.col("shift"))
    # no stretch of length r crosses more than ceil(r) boundaries; holds rounding to that
    copies = F.least(crossed, F.ceil("rate"))
    return rows.select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, **targets) -> DataFrame:
    """The mixed documents: the rows of ``docs``, each as often as the plan emits it."""
    cols = docs.columns
    p_id, p_key, p_source, p_copies, p_rows, key, place, emit = free_names(docs, 8)
    plan = mix_plan(docs, **targets).select(F.col("doc_id").alias(p_id), F.col("text_key").alias(p_key), F.col("source").alias(p_source), "copies")
    plan = plan.groupBy(p_id, p_key, p_source).agg(F.sum("copies").alias(p_copies), F.count("*").alias(p_rows))
    # rows that agree in id, text and source share their copies evenly
    keyed = docs.withColumn(key, F.xxhash64("text"))
    nth = F.row_number().over(W.partitionBy("doc_id", key, "source").orderBy(F.lit(1)))
    out = keyed.withColumn(place, nth).join(
        plan,
        F.col("doc_id").eqNullSafe(F.col(p_id)) & F.col(key).eqNullSafe(F.col(p_key)) & F.col("source").eqNullSafe(F.col(p_source)),
    )
    share = F.expr(f"({p_copies} * {place}) div {p_rows} - ({p_copies} * ({place} - 1)) div {p_rows}")
    return out.withColumn(emit, F.explode(F.array_repeat(F.lit(1), share.cast("int")))).select(*cols)
