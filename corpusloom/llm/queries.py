"""Thin queries over the operators, one per operator, named as they are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    annulus, bpe, fingerprint, hard_negatives, language, line_dedup, link_graph, mixing, ngram_join, quality, suffix_dedup, token_output, topk,
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), min_lines=2, detail=True)
    return docs.select(
        "doc_id",
        F.col("n_lines").cast("long"),
        F.col("n_deleted").cast("long"),
        F.col("longest_run").cast("long"),
        F.md5("text").alias("text_md5"),
    )


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_output.write_tokens(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_output.digest_tokens(shards)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_read(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = ngram_join.link_documents(_read(spark, sf_dir, "documents"))
    return linked.select("doc_id", "n_shingles", "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_read(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


#: Verdict, host and path of the rules that op11 judges by.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op11_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(_read(spark, sf_dir, "pages"), RULES)


def op12_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(_read(spark, sf_dir, "embeddings"), k=40, rounds=5, scale=256, dim=64, salt="2:")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _read(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_output": op2_token_output,
    "op3_fingerprint": op3_fingerprint,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_language": op6_language,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_topk": op9_topk,
    "op10_mixing": op10_mixing,
    "op11_links": op11_links,
    "op12_annulus": op12_annulus,
    "op13_hard_negatives": op13_hard_negatives,
}
