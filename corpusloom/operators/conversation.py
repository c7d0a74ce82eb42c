"""Conversations as ordered turns: token budgets, windows, compression, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import head_and_tail


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) * 1.5)


def budgets(turns: DataFrame, context: int, ratio: float) -> DataFrame:
    """(conv_id, messages, tokens, compress, snapshot): sizes of each conversation and what they call for."""
    out = turns.groupBy("conv_id").agg(F.count("*").alias("messages"), F.floor(F.sum(F.length("text")) * 1.5).alias("tokens"))
    return out.withColumns({"compress": F.col("tokens") > int(context * ratio), "snapshot": F.col("messages") > 8})


def adaptive_rounds(turns: DataFrame, context: int, ratio: float, low: int = 1, high: int = 10) -> DataFrame:
    """How many user turns from the newest on fit into the budget, held to [low, high]."""
    newest_first = W.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(W.unboundedPreceding, 0)
    kept = turns.withColumn("tokens", F.sum(token_estimate(F.col("text"))).over(newest_first)).withColumn("fits", F.col("tokens") <= int(context * ratio))
    users = F.count_if(F.col("fits") & (F.col("role") == "user"))
    return kept.groupBy("conv_id").agg(F.greatest(F.lit(low), F.least(F.lit(high), users)).alias("rounds"))


def window(turns: DataFrame, rounds: int) -> DataFrame:
    """The turns of the last ``rounds`` user turns."""
    later = W.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(W.unboundedPreceding, 0)
    back = F.sum((F.col("role") == "user").cast("int")).over(later)
    own = back - (F.col("role") == "user").cast("int")
    return turns.withColumn("after", own).filter(F.col("after") < rounds).drop("after")


def compress(turns: DataFrame, head: int = 80, most: int = 2000, keep_head: int = 800, keep_tail: int = 400) -> DataFrame:
    """Assistant turns but the last become their first sentence; other long turns keep head and tail.

    Conversations of up to three turns stay as they are.
    """
    n = F.count("*").over(W.partitionBy("conv_id"))
    last = F.max(F.when(F.col("role") == "assistant", F.col("turn"))).over(W.partitionBy("conv_id"))
    sentence = F.substring(F.regexp_extract("text", r"^[^.!?\n]*[.!?]?", 0), 1, head)
    middle = F.concat(F.substring("text", 1, keep_head), F.lit(" ... "), F.right("text", F.lit(keep_tail)))
    text = (
        F.when(F.col("n") <= 3, F.col("text"))
        .when((F.col("role") == "assistant") & (F.col("turn") < F.col("last")), F.concat(sentence, F.lit(" [...]")))
        .when(F.length("text") > most, middle)
        .otherwise(F.col("text"))
    )
    return turns.withColumns({"n": n, "last": last}).withColumn("text", text).drop("n", "last")


def render(turns: DataFrame, most: int) -> DataFrame:
    """One labelled text for each conversation; assistant turns shortened to ``most`` characters."""
    shown = F.when(F.col("role") == "assistant", head_and_tail(F.col("text"), most)).otherwise(F.col("text"))
    line = F.concat(F.col("role"), F.lit(": "), shown)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return turns.groupBy("conv_id").agg(F.array_join(ordered, "\n").alias("history"))


def route_from_context(turns: DataFrame, symptom: Column, knowledge: Column, follow_up: Column) -> DataFrame:
    """Route of the last turn from the four before it: (conv_id, route).

    A follow-up prefers the symptom route if its context has it; other turns take a route
    only if the context is unambiguous.
    """
    back = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    t = turns.withColumns({"back": back, "s": symptom, "k": knowledge, "f": follow_up})
    out = t.groupBy("conv_id").agg(
        F.max(F.when(F.col("back").between(2, 5), F.col("s"))).alias("s"), F.max(F.when(F.col("back").between(2, 5), F.col("k"))).alias("k"),
        F.max(F.when(F.col("back") == 1, F.col("f"))).alias("f"),
    )
    some = lambda c: F.coalesce(F.col(c), F.lit(False))
    route = F.when(some("f") & some("s"), "symptom").when(some("s") & ~some("k"), "symptom").when(some("k") & ~some("s"), "knowledge")
    return out.select("conv_id", route.alias("route"))


def persist_large(turns: DataFrame, most_bytes: int = 30 * 1024, preview: int = 200) -> tuple[DataFrame, DataFrame]:
    """(turns with a placeholder for large texts, the large texts): outputs are (output_id, conv_id, turn, size_bytes, text).

    An output's id is a digest of its place and text, so a rerun names it alike.
    """
    size = F.octet_length("text")
    marked = turns.withColumn("output_id", F.when(size > most_bytes, F.concat(F.lit("persist_"), F.substring(F.md5(F.concat_ws("|", "conv_id", "turn", "text")), 1, 16))))
    outputs = marked.filter("output_id is not null").select("output_id", "conv_id", "turn", size.alias("size_bytes"), "text")
    head = F.when(F.length("text") > preview, F.concat(F.substring("text", 1, preview), F.lit("..."))).otherwise(F.col("text"))
    held = F.concat(F.lit('<persisted-output id="'), "output_id", F.lit('" preview="'), head, F.lit('">'))
    short = marked.withColumn("text", F.when(F.col("output_id").isNotNull(), held).otherwise(F.col("text")))
    return short.select(*turns.columns), outputs


def restored(turns: DataFrame, outputs: DataFrame) -> DataFrame:
    """``turns`` with the texts that placeholders stand for."""
    whole = outputs.select(F.col("output_id").alias("of"), F.col("text").alias("whole"))
    name = F.regexp_extract("text", r'^<persisted-output id="([^"]+)"', 1)
    out = turns.withColumn("name", name).join(whole, F.col("name") == F.col("of"), "left")
    return out.withColumn("text", F.coalesce("whole", "text")).select(*turns.columns)


def rule_summary(turns: DataFrame, constraint: str, reference: str, finding: str, most: int = 5, each: int = 3) -> DataFrame:
    """(conv_id, goal, findings, references, constraints) by patterns, without a model.

    goal: the first 100 characters of the first user turn; findings: up to ``each`` of an
    assistant turn and ``most`` in all, in order; references: distinct, in order of the text;
    constraints: 80 characters of each user turn that has one. finding and reference have one group.
    """
    user = F.col("role") == "user"
    found = F.when(F.col("role") == "assistant", F.slice(F.regexp_extract_all("text", F.lit(finding), F.lit(1)), 1, each))
    named = F.when(F.col("role") == "assistant", F.regexp_extract_all("text", F.lit(reference), F.lit(1)))
    rows = turns.select(
        "conv_id", "turn", F.when(user, F.substring("text", 1, 100)).alias("goal"), found.alias("found"), named.alias("named"),
        F.when(user & F.col("text").rlike(constraint), F.substring("text", 1, 80)).alias("limit"),
    )
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("turn", c)))), lambda x: x[c])
    per = rows.groupBy("conv_id").agg(
        F.min_by("goal", F.when(F.col("goal").isNotNull(), F.col("turn"))).alias("goal"), F.slice(F.flatten(in_order("found")), 1, most).alias("findings"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(in_order("named")))), 1, most).alias("references"), in_order("limit").alias("constraints"),
    )
    return per
