"""Evaluation: overlap metrics, classification reports, comparison of runs, dictionary coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import share_of


def overlap_metrics(samples: DataFrame) -> DataFrame:
    """(id, faithfulness, relevance, context_relevance, context_precision).

    samples: (id, question, answer, contexts) as arrays of tokens, ``contexts`` an array of them.
    """
    every = F.flatten("contexts")
    hit = F.size(F.filter("contexts", lambda c: F.arrays_overlap(c, F.col("question"))))
    n = F.size("contexts")
    return samples.select(
        "id",
        share_of(every, F.col("answer")).alias("faithfulness"),
        share_of(F.col("answer"), F.col("question")).alias("relevance"),
        share_of(every, F.col("question")).alias("context_relevance"),
        F.when(n == 0, 0.0).otherwise(hit / n).alias("context_precision"),
    )


def averages(scores: DataFrame) -> DataFrame:
    """Mean of each metric: (metric, mean)."""
    long = scores.unpivot("id", None, "metric", "score")
    return long.groupBy("metric").agg(F.round(F.avg("score"), 4).alias("mean"))


def classification_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) and rows macro, weighted and accuracy. pairs: (truth, guess)."""
    cells = pairs.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    by_truth = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("guess"), F.col("n"))).alias("hit"))
    by_guess = cells.groupBy(F.col("guess").alias("label")).agg(F.sum("n").alias("guessed"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = by_truth.join(by_guess, "label", "full").na.fill(0, ["support", "hit", "guessed"])
    rows = rows.withColumns({"precision": ratio(F.col("hit"), F.col("guessed")), "recall": ratio(F.col("hit"), F.col("support"))})
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    shape = ["label", "precision", "recall", "f1", "support"]
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    macro = rows.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    mean = rows.agg(weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1").alias("f1"), F.sum("support").alias("support"))
    right = F.sum("hit") / F.sum("support")
    accuracy = rows.agg(right.alias("precision"), right.alias("recall"), right.alias("f1"), F.sum("support").alias("support"))
    out = rows.select(*shape)
    for name, part in (("macro", macro), ("weighted", mean), ("accuracy", accuracy)):
        out = out.unionByName(part.withColumn("label", F.lit(name)).select(*shape))
    return out


def compare(old: DataFrame, new: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(metric, old, new, delta, verdict) over the metrics of either run; a missing one counts as 0."""
    both = old.withColumnRenamed("mean", "old").join(new.withColumnRenamed("mean", "new"), "metric", "full").na.fill(0.0)
    delta = F.round(F.col("new") - F.col("old"), 4)
    verdict = F.when(delta > tolerance, "improved").when(delta < -tolerance, "regressed").otherwise("unchanged")
    return both.select("metric", "old", "new", delta.alias("delta"), verdict.alias("verdict"))


def accuracy_by(results: DataFrame, *keys: str) -> DataFrame:
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("truth") == F.col("guess")).cast("int")).alias("accuracy"))


def fuzzy_match(actual: Column, expected: Column, separator: str = ",") -> Column:
    """Equal, or holds what is expected, or holds all its segments; both normalised before."""
    parts = F.filter(F.split(expected, separator), lambda p: p != "")
    return (actual == expected) | F.contains(actual, expected) | (F.size(parts) > 0) & F.forall(parts, lambda p: F.contains(actual, p))


def pass_rates(results: DataFrame) -> DataFrame:
    """(kind, passed, failed, skipped, pass_rate). results: (kind, outcome)."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    return results.groupBy("kind").agg(
        n("pass").alias("passed"), n("fail").alias("failed"), n("skip").alias("skipped"),
        (n("pass") / F.greatest(n("pass") + n("fail"), F.lit(1))).alias("pass_rate"),
    )


def not_evaluated(samples: DataFrame, past: DataFrame) -> DataFrame:
    """Samples whose question no past run has."""
    return samples.join(past.select("question").distinct(), "question", "left_anti")


def coverage(found: DataFrame, known: DataFrame, most: int = 100) -> DataFrame:
    """Terms of a corpus that the dictionary lacks, the first ``most`` in order, with coverage of all terms."""
    every = found.select("term").distinct()
    marked = every.join(known.select("term", F.lit(1).alias("known")).distinct(), "term", "left")
    share = marked.agg(F.round(F.count("known") * 100 / F.greatest(F.count("*"), F.lit(1)), 2).alias("coverage"))
    gaps = marked.filter("known is null").select("term").orderBy("term").limit(most)
    return gaps.join(F.broadcast(share), F.lit(True))
