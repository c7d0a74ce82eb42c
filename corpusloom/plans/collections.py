"""Vector collection queries: ``embeddings`` in two batches, some deleted and some replaced."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators.vector_collection import VectorCollection
from corpusloom.plans.tables import read
from corpusloom.sources import shared
from corpusloom.sources.shadow import Shadow

K, LISTS, WANTED = 10, 32, 0.95


def _collection(spark, sf_dir):
    """Label 0 to 4 first, the others added, label 3 deleted, label 4 replaced by vectors turned round."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"), "label")

    def build(path):
        c = VectorCollection(spark, path)
        c.create(e.filter("label < 5"), LISTS)
        c.add(e.filter("label >= 5"))
        c.delete(e.filter("label = 3"))
        c.add(e.filter("label = 4").withColumn("v", F.reverse("v")), replace=True)

    return VectorCollection(spark, shared.held(read(spark, sf_dir, "embeddings"), "collection", build))


def _asked(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def collection_rows(spark, sf_dir):
    return _collection(spark, sf_dir).rows().select("chunk_id", F.round(F.element_at("v", 1), 6).alias("first"))


def collection_exact(spark, sf_dir):
    return _collection(spark, sf_dir).search(_asked(spark, sf_dir), K).select("query_id", "chunk_id", "rank")


def collection_recall(spark, sf_dir):
    """Recall of every query with the fewest probes that reach WANTED on a sample."""
    return _collection(spark, sf_dir).recall_at(_asked(spark, sf_dir), K, WANTED)


def collection_info(spark, sf_dir):
    return _collection(spark, sf_dir).info().agg(F.sum("n").alias("n"), (F.count("*") <= LISTS).alias("listed"))


def shadow_switched(spark, sf_dir):
    """Documents of a language go live, all documents are built beside them, checked and switched to; a third one is turned down."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    s = Shadow(spark, shared.fresh_dir(spark, "shadow"))
    s.switch(s.create(read(spark, sf_dir, "documents").filter("lang is not null").select("doc_id", "source")))
    for rows in (d, d.filter("doc_id % 2 = 0"), d.select("doc_id")):
        name = s.create(rows)
        if s.validate(name)[0]:
            s.switch(name)
    s.clean_up(delay=0)
    return s.read().groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (shadow_switched, collection_rows, collection_exact, collection_recall, collection_info)}

_LIVE = """WITH e AS (SELECT vec_id AS chunk_id, list_transform(CASE WHEN label = 4 THEN list_reverse(embedding) ELSE embedding END, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label <> 3),
u AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e WHERE list_dot_product(v, v) > 0)"""
ORACLES = {
    "shadow_switched": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "collection_rows": f"{_LIVE} SELECT chunk_id, round(v[1], 6) AS first FROM u",
    "collection_exact": f"""{_LIVE}, q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id % 50 = 0),
n AS (SELECT query_id, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS q FROM q),
s AS (SELECT query_id, chunk_id, round(list_dot_product(q, v), 6) AS score FROM n JOIN u ON query_id <> chunk_id)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= {K}""",
    "collection_info": f"{_LIVE} SELECT count(*) AS n, true AS listed FROM u",
}
