"""Quality selection by importance resampling.

Two bag-of-n-gram models over hashed words and word pairs are counted: of the target, all
documents labelled good and not toxic, and of all raw text. A document's
log weight is the sum over its n-grams of the log ratio of the two models. Adding Gumbel
noise and taking the largest keys draws documents without replacement in proportion to
their weights.

The threshold of the top k is found by histograms that close in on it, so no task sorts the
keys. Noise comes from a digest of id and text, so reruns agree.

Defined cases: null text counts as empty and has log weight 0; without target documents all
weights are 0; rows whose keys tie at the threshold are all selected; an empty table gives
no rows. Repeated rows get equal keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import keyfilter, shingles
from corpusloom.llm.scratch import Scratch

BUCKETS = 10_000


def _buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word and of every pair of neighbours, text of each)."""
    w, per = shingles.words(texts)
    doc = np.repeat(np.arange(len(texts)), per)
    same = doc[1:] == doc[:-1]
    pairs = shingles.mix64(w[:-1] * shingles.STEP + w[1:])[same]
    every = np.concatenate((w, pairs)) % np.uint64(BUCKETS)
    return every.astype(np.int64), np.concatenate((doc, doc[1:][same]))


def _counts(some: keyfilter.Filter | None = None, others: keyfilter.Filter | None = None):
    """N-grams by bucket: of all rows and of those whose id ``some`` passes and ``others`` doesn't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            sure = np.zeros(len(texts), bool)
            if some is not None:
                known = batch["id"].notna().to_numpy()
                ids = batch["id"].fillna(0).to_numpy(np.int64)
                sure = known & some.passes(ids) & ~others.passes(ids)
            for begin, end in shingles.chunks(texts):
                bucket, doc = _buckets(texts[begin:end])
                n[0] += np.bincount(bucket, minlength=BUCKETS)
                n[1] += np.bincount(bucket[sure[begin:end][doc]], minlength=BUCKETS)
        at = np.flatnonzero(n[0])
        yield pd.DataFrame({"bucket": at, "n": n[0, at], "sure": n[1, at]})

    return run


def _counted(rows: DataFrame, *filters: keyfilter.Filter) -> np.ndarray:
    """(all, sure): the n-grams in each bucket."""
    n = np.zeros((2, BUCKETS))
    found = rows.select("id", "text").mapInPandas(_counts(*filters), "bucket int, n long, sure long")
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure")).collect():  # one row a bucket
        n[:, r["bucket"]] += r["n"], r["sure"]
    return n


def _passing(*filters: keyfilter.Filter):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.ones(len(batch), bool)
            for f in filters:
                found &= f.passes(batch["id"].to_numpy(np.int64))
            yield batch[found]

    return run


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket, with one added to every count.

    One filter passes all good documents and another all others that the first passes, so most
    good documents are known where they lie; texts that both pass are joined with the labels.
    """
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    good = good.select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known, is_good = rows.filter("id is not null"), F.col("id") == F.col("good_id")
    some = keyfilter.build(good.select(F.col("good_id").alias("key")))
    met = known.select("id").mapInPandas(_passing(some), "id long")
    others = keyfilter.build(met.join(good, is_good, "left_anti").select(F.col("id").alias("key")))
    raw, target = _counted(rows, some, others)
    unsure = known.mapInPandas(_passing(some, others), "id long, text string")
    target = target + _counted(unsure.join(good, is_good, "left_semi"))[0]
    if not target.any():
        return np.zeros(BUCKETS)
    raw, target = raw + 1, target + 1
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _weigher(ratios: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            weight, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for begin, end in shingles.chunks(texts):
                bucket, doc = _buckets(texts[begin:end])
                weight[begin:end] = np.bincount(doc, ratios[bucket], minlength=end - begin)
                n[begin:end] = np.bincount(doc, minlength=end - begin)
            yield pd.DataFrame({"id": batch["id"], "noise": batch["noise"], "n_grams": n, "log_weight": weight})

    return run


def threshold(keys: DataFrame, k: int, bins: int = 1024) -> float | None:
    """The k-th largest value of ``key``, by counting in ever narrower bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k < 1:
        return None
    above = 0
    while low < high:
        width = (high - low) / bins
        if not width or low + width == low:
            break
        part = keys.filter(F.col("key").between(low, high))
        bin_of = F.least(F.floor((F.col("key") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        found = part.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["bin"]):  # at most ``bins`` rows
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        else:
            return low
    return high if low == high else low


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.5, seed: int = 17, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, selected) of every row; ``fraction`` of them selected."""
    scratch = scratch or Scratch(docs.sparkSession, "quality")
    ratios = log_ratios(docs, labels)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    rows = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (-F.log(-F.log(uniform))).alias("noise")
    )
    weighed = rows.mapInPandas(_weigher(ratios), "id string, noise double, n_grams long, log_weight double")
    weighed = scratch.table(weighed.withColumn("key", F.col("log_weight") + F.col("noise")))
    least = threshold(weighed, math.ceil(fraction * weighed.count()))
    return weighed.select(
        F.col("id").cast("long").alias("doc_id"), "n_grams", "log_weight", "key",
        (F.col("key") >= F.lit(least)).alias("selected") if least is not None else F.lit(False).alias("selected"),
    )
