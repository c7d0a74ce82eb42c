"""Retrieval: dense and sparse top-k, fusion, reranking, diversity, parents, grading.

Ranked lists are tables (query_id, chunk_id, rank, score). Queries are a stated set against
all rows; each of them keeps a bounded number of results, so results stay small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import clean, head_and_tail, overlaps
from corpusloom.operators.vector_collection import best_of_lists, units


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first of each query in the order given, with their rank."""
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return scored.withColumn("rank", nth).filter(F.col("rank") <= k)


def dense_top_k(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Most similar chunks by cosine. queries: (query_id, q), chunks: (chunk_id, v).

    Chunks of queries meet stripes of rows as matrix products, vectors of a length with each
    other; the k best of each leave a task. A chunk isn't compared with itself.
    """
    asked = units(queries, "query_id", "q").withColumn("list", F.size("v"))
    known = units(chunks, "chunk_id", "v").withColumn("list", F.size("v"))
    return best_of_lists(asked, known, k)


def term_counts(texts: DataFrame, key: str, terms: Column) -> DataFrame:
    return texts.select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25_top_k(queries: DataFrame, postings: DataFrame, lengths: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, eps: float = 0.25) -> DataFrame:
    """Okapi BM25. queries: (query_id, term, tf), postings: (chunk_id, term, tf), lengths: (chunk_id, length).

    A term that more than half of the chunks hold gets ``eps`` times the mean idf of all terms.
    Terms repeated in a query count as often. Only postings of query terms are joined.
    """
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(corpus), F.lit(True)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    idf = idf.join(F.broadcast(mean), F.lit(True)).select("term", F.when(F.col("raw") < 0, eps * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    asked = queries.withColumnRenamed("tf", "q_tf").join(idf, "term")
    hits = asked.join(postings, "term").join(lengths, "chunk_id").join(F.broadcast(corpus), F.lit(True))
    part = F.col("q_tf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score"))
    return top(scored, k, F.col("score").desc(), F.col("chunk_id"))


def fuse(dense: DataFrame, sparse: DataFrame, alpha: float, k: int, c: int = 60) -> DataFrame:
    """Weighted reciprocal rank fusion; ties in dense order, then sparse order."""
    legs = dense.select("query_id", "chunk_id", F.lit(0).alias("leg"), "rank").unionByName(sparse.select("query_id", "chunk_id", F.lit(1).alias("leg"), "rank"))
    weight = F.when(F.col("leg") == 0, alpha).otherwise(1 - alpha)
    whole = legs.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (c + F.col("rank"))), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    return top(whole, k, F.col("score").desc(), F.col("first"), F.col("chunk_id")).select("query_id", "chunk_id", "rank", "score")


def diverse(ranked: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of each source in rank order, ranked anew."""
    nth = F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))
    kept = ranked.withColumn("of_source", nth).filter(F.col("of_source") <= most)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).drop("of_source")


def rerank(candidates: DataFrame, score: Column, k: int, least: float, most_chars: int = 200) -> DataFrame:
    """Top k by the sigmoid of ``score`` of those at or above ``least``; if none is, the top k anyway, marked.

    candidates: (query_id, chunk_id, question, text). ``score`` may use ``question`` and
    ``passage``, the cleaned and shortened text; texts that clean to nothing are dropped.
    """
    short = candidates.withColumn("passage", head_and_tail(clean(F.col("text")), most_chars)).filter("passage <> ''")
    scored = short.withColumn("score", F.round(1 / (1 + F.exp(-score)), 6))
    some = F.max("score").over(W.partitionBy("query_id")) >= least
    kept = scored.withColumn("fallback", ~some).filter((F.col("score") >= least) | F.col("fallback"))
    return top(kept, k, F.col("score").desc(), F.col("chunk_id")).select("query_id", "chunk_id", "rank", "score", "fallback")


def parents_of(ranked: DataFrame, children: DataFrame) -> DataFrame:
    """Distinct parents of the ranked children in first-hit order with the score of the first."""
    hit = ranked.join(children.select("chunk_id", "parent_id"), "chunk_id")
    first = hit.groupBy("query_id", "parent_id").agg(F.min(F.struct("rank", "score")).alias("first"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("first.rank", "parent_id"))
    return first.select("query_id", "parent_id", nth.alias("rank"), F.col("first.score").alias("score"))


def with_siblings(parents: DataFrame, sections: DataFrame, window: int, most_chars: int) -> DataFrame:
    """Parents, then neighbouring sections of their documents, until the first that would pass ``most_chars``.

    sections: (parent_id, doc_id, section, chars). Adds origin: hit or sibling.
    """
    hits = parents.join(sections, "parent_id").select("query_id", "rank", "parent_id", "doc_id", "section", "chars")
    near = hits.select("query_id", "rank", "doc_id", F.col("section").alias("of"), F.explode(F.sequence(F.col("section") - window, F.col("section") + window)).alias("section"))
    near = near.filter("section <> of").join(sections, ["doc_id", "section"])
    near = near.groupBy("query_id", "parent_id", "chars").agg(F.min(F.struct("rank", "section")).alias("order"))
    near = near.join(hits.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
    every = hits.select("query_id", "parent_id", "chars", F.lit(0).alias("part"), F.struct("rank", "section").alias("order")).unionByName(
        near.select("query_id", "parent_id", "chars", F.lit(1).alias("part"), "order")
    )
    in_order = W.partitionBy("query_id").orderBy("part", "order", "parent_id")
    total = F.sum("chars").over(in_order.rowsBetween(W.unboundedPreceding, 0))
    every = every.withColumns({"total": total, "place": F.row_number().over(in_order)})
    over = F.min(F.when((F.col("part") == 1) & (F.col("total") > most_chars), F.col("place"))).over(W.partitionBy("query_id"))
    kept = every.withColumn("over", over).filter((F.col("part") == 0) | F.col("over").isNull() | (F.col("place") < F.col("over")))
    return kept.select("query_id", "parent_id", "place", F.when(F.col("part") == 0, "hit").otherwise("sibling").alias("origin"))


#: Fixed values of the reference's scores: (least, share), highest first.
SCORE_BANDS = ((0.10, 0.3), (0.03, 0.2), (0.01, 0.1))
GAP_BANDS = ((0.05, 0.2), (0.02, 0.1))
COUNT_BANDS = ((3, 0.3), (2, 0.2), (1, 0.1))
OVERLAP_BANDS = ((0.8, 0.2), (0.5, 0.1))
AGE_BANDS = ((1095, 0.6), (730, 0.75), (365, 0.85))
AUTHORITY = {
    "national_guideline": 1.0, "society_consensus": 0.95, "textbook": 0.90, "institutional_protocol": 0.85,
    "expert_opinion": 0.75, "training_material": 0.65, "faq": 0.55, "unknown": 0.60,
}


def banded(value: Column, bands: Sequence[tuple[float, float]], above: bool = False, default: float = 0.0) -> Column:
    """The share of the first band that the value reaches, or lies above."""
    out = F.when(F.lit(False), F.lit(default))
    for least, share in bands:
        out = out.when(value > least if above else value >= least, F.lit(share))
    return out.otherwise(F.lit(default))


def timeliness(effective: Column, expires: Column, now: Column, modified: Column | None = None) -> Column:
    """0 once expired, else by the age of the effective date, else of the file, else 0.8."""
    by_age = lambda day: banded(F.date_diff(now, day), AGE_BANDS, above=True, default=1.0)
    out = F.when(expires < now, 0.0).when(effective.isNotNull(), by_age(effective))
    if modified is not None:
        out = out.when(modified.isNotNull(), by_age(modified))
    return out.otherwise(0.8)


def authority(level: Column, weights: dict[str, float] = AUTHORITY, unknown: float = 0.60) -> Column:
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.coalesce(level, F.lit("unknown"))), F.lit(unknown))


def confidence(
    best: Column, gap: Column, relevant: Column, overlap: Column, timely: Column, authority: Column,
    bands: Sequence[Sequence[tuple[float, float]]] = (SCORE_BANDS, GAP_BANDS, COUNT_BANDS, OVERLAP_BANDS),
) -> Column:
    """Shares of best score, gap, count and overlap by band, times timeliness and authority."""
    by_score, by_gap, by_count, by_overlap = (banded(v, b) for v, b in zip((best, gap, relevant, overlap), bands, strict=True))
    return F.round((by_score + by_gap + by_count + by_overlap) * timely * authority, 4)


def skips_rerank(query: Column, candidates: Column, distance: Column, greetings: Sequence[str], near: float = 0.08, short: int = 4) -> Column:
    """Whether ranking anew can't change the answer: nothing found, small talk, or a first hit that is very near."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(query, F.lit("")))), r"[，。！？,.!?\s]", "")
    return (candidates == 0) | plain.isin(list(greetings)) | (F.length(plain) <= short) | F.coalesce((distance >= 0) & (distance < near), F.lit(False))


def cited_sources(hits: DataFrame, chars: int = 200) -> DataFrame:
    """One row a source of each query, its first hit: (query_id, nth, source, content). hits: (query_id, rank, source, text)."""
    first = hits.groupBy("query_id", "source").agg(F.min_by("text", "rank").alias("text"), F.min("rank").alias("rank"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "source"))
    return first.select("query_id", nth.alias("nth"), "source", F.substring("text", 1, chars).alias("content"))


def answer_overlap(left: DataFrame, right: DataFrame, chars: int = 80) -> DataFrame:
    """Jaccard of two lists of hits by the first characters of their texts: (query_id, overlap). Both: (query_id, text)."""
    cut = lambda df, side: df.select("query_id", F.substring("text", 1, chars).alias("head"), F.lit(side).alias("side")).distinct()
    per = cut(left, 1).unionByName(cut(right, 2)).groupBy("query_id", "head").agg(F.sum("side").alias("sides"))
    return per.groupBy("query_id").agg((F.count_if(F.col("sides") == 3) / F.count("*")).alias("overlap"))


def relevant(candidates: DataFrame, fillers: Sequence[str], always: int = 2) -> DataFrame:
    """The first ``always`` of each query, and others that share a telling token with the question."""
    return candidates.filter((F.col("rank") <= always) | overlaps(F.col("question"), F.col("text"), fillers))


def keyword_recall(pairs: DataFrame) -> DataFrame:
    """Share of expected keywords that occur in a query's texts together. pairs: (query_id, keyword, text)."""
    hit = pairs.groupBy("query_id", "keyword").agg(F.max(F.contains(F.lower("text"), F.lower("keyword")).cast("int")).alias("hit"))
    return hit.groupBy("query_id").agg(F.avg("hit").alias("recall"))
