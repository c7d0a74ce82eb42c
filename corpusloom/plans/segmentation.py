"""Segmentation queries: white space is taken out of texts, and terms are found again."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import share_of
from corpusloom.operators import evaluation, retrieval, segmentation as seg
from corpusloom.operators.sparse_index import SparseIndex
from corpusloom.plans.tables import read
from corpusloom.sources import shared

LETTERS, DIGITS = r"[^\W\d_]+", r"\d+"
#: Tasks a core for cutting texts.
PER_CORE = 4


def _spaced(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def _unspaced(text):
    return F.regexp_replace(text, r"\s+", "")


def _model(spark, sf_dir):
    """Words that occur at least three times in documents; others are left to the hidden model."""
    return seg.segmenter(_spread(spark, sf_dir).select(_spaced(F.col("text")).alias("words")), 3, LETTERS, DIGITS)


def _cut(table, model, key, *more):
    rows = table.select(F.col(key).alias("id"), _unspaced(F.col("text")).alias("run_on"), "text", *more)
    return rows.withColumn("terms", seg.terms(model, rows, "run_on"))


def _spread(spark, sf_dir):
    """Documents dealt over tasks, however few files they lie in: cutting costs more than moving them."""
    d = read(spark, sf_dir, "documents")
    return d.repartition(max(d.rdd.getNumPartitions(), PER_CORE * spark.sparkContext.defaultParallelism), "doc_id")


def segmented_terms(spark, sf_dir):
    """The terms of every document, and the share of its different words among them."""
    d = _cut(_spread(spark, sf_dir), _model(spark, sf_dir), "doc_id")
    recall = F.round(share_of(F.col("terms"), _spaced(F.col("text"))), 6)
    return d.select(F.col("id").alias("doc_id"), F.size("terms").alias("n_terms"), recall.alias("recall"), F.md5(F.array_join("terms", " ")).alias("terms_md5"))


def _kept(spark, sf_dir, model):
    """The terms of all documents, cut once for index and metrics."""

    def make(path):
        d = _cut(_spread(spark, sf_dir), model, "doc_id", "source")
        d.select(F.col("id").alias("chunk_id"), "source", "terms").write.parquet(path)

    path = shared.held(read(spark, sf_dir, "documents"), "segmented-terms", make)
    return spark.read.schema("chunk_id long, source string, terms array<string>").parquet(path)


def _hits(spark, sf_dir, model, k):
    build = lambda path: SparseIndex(spark, path).build(_kept(spark, sf_dir, model))
    index = SparseIndex(spark, shared.held(read(spark, sf_dir, "documents"), "segmented-index", build))
    asked = _cut(read(spark, sf_dir, "benchmark"), model, "item_id").select(F.col("id").alias("query_id"), "terms")
    return index.search(retrieval.term_counts(asked, "query_id", F.col("terms")), k)


def bm25_segmented(spark, sf_dir):
    return _hits(spark, sf_dir, _model(spark, sf_dir), 10).select("query_id", "chunk_id", "rank")


def segmented_metrics(spark, sf_dir):
    """The overlap metrics on terms of two characters or more: an item, its best hit as answer, the next three as contexts."""
    model = _model(spark, sf_dir)
    hits = _hits(spark, sf_dir, model, 4)
    d = _kept(spark, sf_dir, model).join(hits, "chunk_id")
    d = d.select(F.col("query_id").alias("id"), "rank", seg.telling(F.col("terms")).alias("t"))
    rest = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "t"))))
    per = d.groupBy("id").agg(F.max(F.when(F.col("rank") == 1, F.col("t"))).alias("answer"), F.transform(rest, lambda v: v["t"]).alias("contexts"))
    q = _cut(read(spark, sf_dir, "benchmark"), model, "item_id").select("id", seg.telling(F.col("terms")).alias("question"))
    return evaluation.overlap_metrics(q.join(per, "id"))


QUERIES = {f.__name__: f for f in (segmented_terms, bm25_segmented, segmented_metrics)}
ORACLES: dict[str, str] = {}  # best paths are beyond SQL on whole tables; tests hold them against brute force
