"""A training-data pipeline over ``documents``: five stages, each an operator of corpusloom.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared scratch folder and rereads it as the next one's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, language, line_dedup, mixing, ngram_join
from corpusloom.llm.queries import vocabulary
from corpusloom.llm.scratch import Scratch


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; those without text, letters or a clear language go."""
    return language.keep_identified(docs)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of two or more lines, and of single lines of 50 words or more, are deleted.

    Every document stays, also with null or empty text; null ids come first in the order of documents.
    """
    return line_dedup.dedup_lines(docs)


def keep_one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word shingle similarity of 0.75 or more, one stays."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every copy, encoded and decoded again."""
    return bpe.digest_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language ID", recognise_language),
    ("line dedup", delete_repeated_lines),
    ("n-gram Jaccard join", keep_one_near_duplicate),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode_and_decode),
]

#: Training and tokenizing are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return docs
