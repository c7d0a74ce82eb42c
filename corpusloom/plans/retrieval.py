"""Retrieval queries: ``benchmark`` asks, ``documents`` and ``embeddings`` are searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.functions.vectors import hashed_vectors
from corpusloom.operators import chunking, retrieval as r
from corpusloom.operators.sparse_index import SparseIndex
from corpusloom.plans.tables import read
from corpusloom.sources import shared

K = 10
FILLERS = ("the", "and", "of", "to")


def _queries(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "text")


def _terms():
    return tokens(F.col("text"))


def _asked(spark, sf_dir):
    return r.term_counts(_queries(spark, sf_dir), "query_id", tokens(F.col("question")))


def _index(spark, sf_dir):
    """The index of all documents, built by the first query of a session that needs it."""
    build = lambda path: SparseIndex(spark, path).build(_docs(spark, sf_dir), _terms())
    return SparseIndex(spark, shared.held(read(spark, sf_dir, "documents"), "documents-index", build))


def _bm25(spark, sf_dir, k=K):
    """The k best documents of each item: searched once however often a query reads them, and small enough to meet texts without moving these."""
    return shared.kept(_index(spark, sf_dir).search(_asked(spark, sf_dir), k), "bm25-hits")


def index_update(spark, sf_dir):
    """An index of half texts for half of the sources, brought up to date; the last source is deleted."""
    d = _docs(spark, sf_dir)
    changed, last = F.coalesce(F.md5("source") < "8", F.lit(True)), d.agg(F.max("source")).first()[0]
    index = SparseIndex(spark, shared.fresh_dir(spark, "index-update"))
    half = F.when(changed, F.expr("left(text, length(text) div 2)")).otherwise(F.col("text"))
    index.build(d.withColumn("text", half), _terms())
    index.update(d.filter(changed & F.coalesce(F.col("source") != last, F.lit(True))), d.filter(changed | (F.col("source") == last)).select("source"), _terms())
    return index.search(_asked(spark, sf_dir), K).select("query_id", "chunk_id", "rank")


def index_merged(spark, sf_dir):
    """An index grown source by source group and merged into one segment."""
    d = _docs(spark, sf_dir)
    part = F.when(F.md5("source") < "5", 0).when(F.md5("source") < "a", 1).otherwise(2)
    index = SparseIndex(spark, shared.fresh_dir(spark, "index-merged"))
    index.build(d.filter(part == 0), _terms())
    for k in (1, 2):
        index.update(d.filter(part == k), d.filter(part == k).select("source"), _terms())
    index.merge()
    return index.search(_asked(spark, sf_dir), K).select("query_id", "chunk_id", "rank")


def index_skips(spark, sf_dir):
    """Blocks that hold a query's terms, and those that block maxima left unread."""
    return _index(spark, sf_dir).skips(_asked(spark, sf_dir), 3)


def bm25_hits(spark, sf_dir, k):
    """(query_id, chunk_id, rank) of the k best documents of every benchmark item."""
    return _bm25(spark, sf_dir, k)


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "chunk_id", "rank")


def _dense(spark, sf_dir, k=K):
    e = read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return r.dense_top_k(asked, e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v")), k)


def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "chunk_id", "rank")


def dense_topk_filtered(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    asked = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    live = e.filter("label <> 3 and label is not null").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))
    return r.dense_top_k(asked, live, K).select("query_id", "chunk_id", "rank")


def _text_dense(spark, sf_dir, k):
    """The dense leg of every benchmark item: vectors of its words against those of all documents."""
    asked = hashed_vectors(_queries(spark, sf_dir), "query_id", tokens(F.col("question"))).withColumnRenamed("v", "q")
    make = lambda path: hashed_vectors(_docs(spark, sf_dir), "chunk_id", _terms()).write.parquet(path)
    known = spark.read.parquet(shared.held(read(spark, sf_dir, "documents"), "documents-vectors", make))
    # numbers of items and documents overlap, and a row of a query's own number would be left out
    best = r.dense_top_k(asked.withColumn("query_id", -1 - F.col("query_id")), known, k)
    return best.withColumn("query_id", -1 - F.col("query_id"))


def rrf_fusion(spark, sf_dir):
    """The sparse leg of every benchmark item fused with its dense leg."""
    dense = _text_dense(spark, sf_dir, 20)
    return r.fuse(dense, _bm25(spark, sf_dir, 20), 0.6, K).select("query_id", "chunk_id", "rank")


def source_diversity(spark, sf_dir):
    ranked = _bm25(spark, sf_dir, 20).join(_docs(spark, sf_dir).select("chunk_id", "source"), "chunk_id")
    return r.diverse(ranked, 1).select("query_id", "chunk_id", "rank")


def hybrid_retrieval(spark, sf_dir):
    """Sparse and dense legs, fusion, at most three of a source, top five."""
    dense = _text_dense(spark, sf_dir, 20)
    fused = r.fuse(dense, _bm25(spark, sf_dir, 20), 0.5, 20)
    kept = r.diverse(fused.join(_docs(spark, sf_dir).select("chunk_id", "source"), "chunk_id"), 3)
    return kept.filter("rank <= 5").select("query_id", "chunk_id", "rank")


def rerank_threshold_fallback(spark, sf_dir):
    c = _bm25(spark, sf_dir).join(_queries(spark, sf_dir), "query_id").join(_docs(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    shared = F.size(F.array_intersect(tokens(F.col("question")), tokens(F.col("passage"))))
    return r.rerank(c.select("query_id", "chunk_id", "question", "text"), (shared - 12) / 2.0, 5, 0.5).select("query_id", "chunk_id", "rank", "fallback")


def query_overlap_filter(spark, sf_dir):
    c = _bm25(spark, sf_dir).join(_queries(spark, sf_dir), "query_id").join(_docs(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    return r.relevant(c, FILLERS).select("query_id", "chunk_id")


def keyword_recall(spark, sf_dir):
    words = _queries(spark, sf_dir).select("query_id", F.explode(F.array_distinct(tokens(F.col("question"), 4))).alias("keyword"))
    hits = _bm25(spark, sf_dir, 3).join(_docs(spark, sf_dir), "chunk_id").select("query_id", "text")
    return r.keyword_recall(words.join(hits, "query_id"))


def rerank_skips(spark, sf_dir):
    """Questions, turns of conversations and greetings, with made-up distances of their first hit."""
    c = read(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 5 == 0, "Hello!").when(F.col("turn") % 7 == 0, " ok? ").otherwise(F.col("text"))
    skip = r.skips_rerank(said, F.col("conv_id") % 6, F.when(F.col("turn") % 3 != 0, (F.col("conv_id") % 40 - 2) / 100.0), ["hello", "hi", "thanks"])
    return c.select("conv_id", "turn", skip.alias("skip"))


def cited_sources(spark, sf_dir):
    hits = _bm25(spark, sf_dir).join(_docs(spark, sf_dir), "chunk_id").select("query_id", "rank", F.coalesce("source", F.lit("unknown")).alias("source"), "text")
    return r.cited_sources(hits).select("query_id", "nth", "source", F.md5("content").alias("content_md5"))


def answer_overlap(spark, sf_dir):
    """The five best hits against hits three to eight."""
    hits = _bm25(spark, sf_dir).join(_docs(spark, sf_dir), "chunk_id").select("query_id", "rank", F.coalesce("text", F.lit("")).alias("text"))
    return r.answer_overlap(hits.filter("rank <= 5"), hits.filter("rank between 3 and 8"))


def authority_weights(spark, sf_dir):
    levels = F.array(*map(F.lit, ["faq", "textbook", "national_guideline", "rumour", "society_consensus", "expert_opinion"]), F.lit(None).cast("string"))
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", r.authority(F.element_at(levels, (F.col("o_orderkey") % 7 + 1).cast("int"))).alias("weight"))


def _sections(spark, sf_dir):
    """Documents of a source as sections of one file, in order of doc_id."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("parent_id"), F.col("source").alias("doc_id"), F.floor(F.col("doc_id") / 20).cast("int").alias("section"), (F.length("text") % 700).alias("chars"))


def parent_lookup(spark, sf_dir):
    kids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 4).alias("parent_id"))
    return r.parents_of(_bm25(spark, sf_dir), kids).select("query_id", "parent_id", "rank")


def sibling_expand(spark, sf_dir):
    hits = _bm25(spark, sf_dir, 3).select("query_id", F.col("chunk_id").alias("parent_id"), "rank")
    s = _sections(spark, sf_dir)
    return r.with_siblings(hits, s, 1, 1500)


def timeliness_weights(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    effective, expires = F.when(F.col("o_orderkey") % 3 != 0, day), F.when(F.col("o_orderkey") % 7 == 0, F.date_add(day, 300))
    w = r.timeliness(effective, expires, F.lit("1998-01-01").cast("date"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, 100)))
    return o.select("o_orderkey", w.alias("weight"))


def retrieval_confidence(spark, sf_dir):
    c = _bm25(spark, sf_dir, 5).join(_queries(spark, sf_dir), "query_id").join(_docs(spark, sf_dir).select("chunk_id", "text"), "chunk_id")
    share = F.size(F.array_intersect(tokens(F.col("question")), tokens(F.col("text")))) / F.size(F.array_distinct(tokens(F.col("question"))))
    per = c.groupBy("query_id").agg(F.max(share).alias("best"), F.min(share).alias("least"), F.count_if(share >= 0.3).alias("n"), F.avg(share).alias("mean"))
    score = r.confidence(F.col("best"), F.col("best") - F.col("least"), F.col("n"), F.round("mean", 6), F.lit(0.85), F.lit(0.9))
    return per.select("query_id", score.alias("confidence"))


def markdown_sections(spark, sf_dir):
    return chunking.sections(read(spark, sf_dir, "documents"), r"^The ").select("doc_id", "section", F.md5("text").alias("text_md5"), "title")


def table_detect(spark, sf_dir):
    t = chunking.tables(read(spark, sf_dir, "documents"))
    return t.select("doc_id", "first_line", "last_line", F.array_join("headers", ";").alias("headers"))


def child_packing(spark, sf_dir):
    return chunking.children(read(spark, sf_dir, "documents")).select("doc_id", "child", F.md5("text").alias("text_md5"))


def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(read(spark, sf_dir, "documents")).select("doc_id", "chunk", F.md5("text").alias("text_md5"))


def row_summaries(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("title"), F.array(F.lit("name"), F.lit("type"), F.lit("size")).alias("headers"), F.array("p_name", F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")), F.col("p_size").cast("string")).alias("cells"))
    return chunking.row_summaries(rows)


def fill_down(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("kind"))
    return chunking.fill_down(e, "user_id", "event_id", "kind").select("event_id", "kind")


QUERIES = {f.__name__: f for f in (
    bm25_topk, dense_topk, dense_topk_filtered, rrf_fusion, source_diversity, hybrid_retrieval, rerank_threshold_fallback, query_overlap_filter,
    keyword_recall, rerank_skips, cited_sources, answer_overlap, authority_weights, parent_lookup, sibling_expand, timeliness_weights, retrieval_confidence, markdown_sections, table_detect, child_packing,
    recursive_chunks, row_summaries, fill_down, index_update, index_merged, index_skips,
)}

_TOK = "regexp_extract_all(lower({0}), '[一-鿿a-z0-9]+')"
_BM25 = f"""q AS (SELECT item_id AS query_id, text AS question FROM benchmark), d AS (SELECT doc_id AS chunk_id, source, text FROM documents),
qt AS (SELECT query_id, term, count(*) AS q_tf FROM (SELECT query_id, unnest({_TOK.format('question')}) AS term FROM q) GROUP BY ALL),
p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TOK.format('text')}) AS term FROM d) GROUP BY ALL),
l AS (SELECT chunk_id, len({_TOK.format('text')}) AS length FROM d), c AS (SELECT count(*) AS n, avg(length) AS m FROM l),
f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, c GROUP BY term, n), mi AS (SELECT avg(raw) AS m FROM f),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * mi.m ELSE raw END AS idf FROM f, mi),
s AS (SELECT query_id, chunk_id, round(sum(q_tf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / c.m))), 6) AS score
      FROM qt JOIN idf USING (term) JOIN p USING (term) JOIN l USING (chunk_id), c GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s)"""
BM25_SQL = _BM25
_DENSE = """e AS (SELECT vec_id AS chunk_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT chunk_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e WHERE list_dot_product(v, v) > 0),
dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT a.chunk_id AS query_id, b.chunk_id, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.chunk_id <> b.chunk_id WHERE a.chunk_id % 50 = 0 {0}))"""
# vectors of texts: a word adds its count to one of 64 places, by its digest, or takes it away
_HASHED = f"""tw AS (SELECT side, id, term, count(*) AS n FROM (SELECT 0 AS side, query_id AS id, unnest({_TOK.format('question')}) AS term FROM q UNION ALL SELECT 1, chunk_id, unnest({_TOK.format('text')}) FROM d) GROUP BY ALL),
tv AS (SELECT side, id, (('0x' || left(md5(term), 2))::INT % 64) AS place, sum(CASE WHEN substr(md5(term), 3, 1) < '8' THEN n ELSE -n END)::DOUBLE AS x FROM tw GROUP BY ALL),
tl AS (SELECT side, id, sqrt(sum(x * x)) AS l FROM tv GROUP BY ALL HAVING l > 0), tu AS (SELECT side, id, place, x / l AS x FROM tv JOIN tl USING (side, id)),
tg AS (SELECT side, id, list_transform(range(64), lambda p: coalesce(map_from_entries(list((place, x)))[p], 0.0)) AS v FROM tu GROUP BY ALL),
dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT a.id AS query_id, b.id AS chunk_id, round(list_dot_product(a.v, b.v), 6) AS score FROM tg a JOIN tg b ON a.side = 0 AND b.side = 1))"""
_FUSED = """legs AS (SELECT query_id, chunk_id, 0 AS leg, rank FROM dense WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 1, rank FROM ranked WHERE rank <= 20),
fz AS (SELECT query_id, chunk_id, round(sum((CASE WHEN leg = 0 THEN {0} ELSE 1 - {0} END)::DOUBLE / (60 + rank)), 9) AS score, min({{'leg': leg, 'rank': rank}}) AS first FROM legs GROUP BY ALL),
fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM fz)"""
_JOINED = "ranked r JOIN q USING (query_id) JOIN d USING (chunk_id)"
_PASS = """CASE WHEN length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) < 5 THEN '' ELSE trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) END"""

ORACLES = {
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= {K}",
    "index_update": f"WITH {_BM25.replace('FROM documents)', 'FROM documents WHERE source IS NULL OR source <> (SELECT max(source) FROM documents))')} SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= {K}",
    "index_merged": f"WITH {_BM25} SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= {K}",
    "dense_topk": f"WITH {_DENSE.format('')} SELECT query_id, chunk_id, rank FROM dense WHERE rank <= {K}",
    "dense_topk_filtered": f"WITH {_DENSE.format('AND b.label <> 3')} SELECT query_id, chunk_id, rank FROM dense WHERE rank <= {K}",
    "rrf_fusion": f"WITH {_BM25}, {_HASHED}, {_FUSED.format('0.6')} SELECT query_id, chunk_id, rank FROM fused WHERE rank <= {K}",
    "source_diversity": f"""WITH {_BM25}, o AS (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM ranked JOIN d USING (chunk_id) WHERE rank <= 20)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM o WHERE k = 1""",
    "hybrid_retrieval": f"""WITH {_BM25}, {_HASHED}, {_FUSED.format('0.5')}, o AS (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM fused JOIN d USING (chunk_id) WHERE rank <= 20)
SELECT query_id, chunk_id, n AS rank FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM o WHERE k <= 3) WHERE n <= 5""",
    "rerank_threshold_fallback": f"""WITH {_BM25}, cj AS (SELECT query_id, chunk_id, question, {_PASS} AS t FROM {_JOINED} WHERE rank <= {K}),
pp AS (SELECT *, CASE WHEN length(t) <= 200 THEN t ELSE substr(t, 1, 133) || right(t, 67) END AS passage FROM cj WHERE t <> ''),
z AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-((len(list_intersect({_TOK.format('question')}, {_TOK.format('passage')})) - 12) / 2.0::DOUBLE))), 6) AS score FROM pp),
m AS (SELECT *, max(score) OVER (PARTITION BY query_id) < 0.5 AS fallback FROM z)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, fallback FROM m WHERE score >= 0.5 OR fallback QUALIFY rank <= 5""",
    "query_overlap_filter": f"""WITH {_BM25}, cj AS (SELECT query_id, chunk_id, rank, text, list_filter({_TOK.format('question')}, lambda t: length(t) >= 2) AS every FROM {_JOINED} WHERE rank <= {K}),
t AS (SELECT *, list_filter(every, lambda x: x NOT IN {FILLERS}) AS telling FROM cj)
SELECT query_id, chunk_id FROM t WHERE rank <= 2 OR len(list_filter(CASE WHEN len(telling) > 0 THEN telling ELSE every END, lambda x: contains(lower(text), x))) > 0""",
    "keyword_recall": f"""WITH {_BM25}, w AS (SELECT query_id, unnest(list_distinct(list_filter({_TOK.format('question')}, lambda t: length(t) >= 4))) AS keyword FROM q),
h AS (SELECT query_id, keyword, max(contains(lower(text), keyword)::INT) AS hit FROM w JOIN ranked USING (query_id) JOIN d USING (chunk_id) WHERE rank <= 3 GROUP BY ALL)
SELECT query_id, avg(hit) AS recall FROM h GROUP BY query_id""",
    "rerank_skips": r"""WITH c AS (SELECT conv_id, turn, regexp_replace(lower(trim(CASE WHEN turn % 5 = 0 THEN 'Hello!' WHEN turn % 7 = 0 THEN ' ok? ' ELSE coalesce(text, '') END)), '[，。！？,.!?\s]', '', 'g') AS q,
  CASE WHEN turn % 3 <> 0 THEN (conv_id % 40 - 2) / 100.0::DOUBLE END AS far FROM conversations)
SELECT conv_id, turn, conv_id % 6 = 0 OR q IN ('hello', 'hi', 'thanks') OR length(q) <= 4 OR coalesce(far >= 0 AND far < 0.08::DOUBLE, false) AS skip FROM c""",
    "cited_sources": f"""WITH {_BM25}, h AS (SELECT query_id, coalesce(source, 'unknown') AS source, arg_min(text, rank) AS text, min(rank) AS rank FROM ranked JOIN d USING (chunk_id) WHERE rank <= {K} GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, source) AS nth, source, md5(substr(text, 1, 200)) AS content_md5 FROM h""",
    "answer_overlap": f"""WITH {_BM25}, h AS (SELECT query_id, rank, substr(coalesce(text, ''), 1, 80) AS head FROM ranked JOIN d USING (chunk_id)),
g AS (SELECT query_id, list(DISTINCT head) FILTER (rank <= 5) AS a, list(DISTINCT head) FILTER (rank BETWEEN 3 AND 8) AS b FROM h WHERE rank <= 8 GROUP BY query_id)
SELECT query_id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS overlap FROM g""",
    "authority_weights": """SELECT o_orderkey, [0.55, 0.9, 1.0, 0.6, 0.95, 0.75, 0.6][o_orderkey % 7 + 1]::DOUBLE AS weight FROM orders""",
    "parent_lookup": f"""WITH {_BM25}, h AS (SELECT query_id, chunk_id // 4 AS parent_id, min(rank) AS first FROM ranked WHERE rank <= {K} GROUP BY ALL)
SELECT query_id, parent_id, row_number() OVER (PARTITION BY query_id ORDER BY first, parent_id) AS rank FROM h""",
    "sibling_expand": f"""WITH {_BM25}, sx AS (SELECT doc_id AS parent_id, source AS doc_id, (doc_id // 20)::INT AS section, length(text) % 700 AS chars FROM documents),
h AS (SELECT query_id, rank, sx.* FROM ranked JOIN sx ON chunk_id = parent_id WHERE rank <= 3),
n AS (SELECT h.query_id, s.parent_id, s.chars, min({{'rank': h.rank, 'section': s.section}}) AS ord FROM h JOIN sx s ON s.doc_id = h.doc_id AND s.section <> h.section AND abs(s.section - h.section) <= 1
  WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.query_id = h.query_id AND g.parent_id = s.parent_id) GROUP BY ALL),
x AS (SELECT query_id, parent_id, chars, 0 AS part, {{'rank': rank, 'section': section}} AS ord FROM h UNION ALL SELECT query_id, parent_id, chars, 1, ord FROM n),
y AS (SELECT *, sum(chars) OVER w AS total, row_number() OVER w AS place FROM x WINDOW w AS (PARTITION BY query_id ORDER BY part, ord, parent_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, min(CASE WHEN part = 1 AND total > 1500 THEN place END) OVER (PARTITION BY query_id) AS over_at FROM y)
SELECT query_id, parent_id, place, CASE WHEN part = 0 THEN 'hit' ELSE 'sibling' END AS origin FROM z WHERE part = 0 OR over_at IS NULL OR place < over_at""",
    "timeliness_weights": """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN d + 300 END AS ends,
  DATE '1998-01-01' - CASE WHEN o_orderkey % 3 <> 0 THEN d WHEN o_orderkey % 5 <> 0 THEN d + 100 END AS age FROM o)
SELECT o_orderkey, CASE WHEN ends < DATE '1998-01-01' THEN 0 WHEN age IS NULL THEN 0.8 WHEN age > 1095 THEN 0.6 WHEN age > 730 THEN 0.75 WHEN age > 365 THEN 0.85 ELSE 1 END::DOUBLE AS weight FROM x""",
    "retrieval_confidence": f"""WITH {_BM25}, cj AS (SELECT query_id, len(list_intersect({_TOK.format('question')}, {_TOK.format('text')})) / len(list_distinct({_TOK.format('question')}))::DOUBLE AS share FROM {_JOINED} WHERE rank <= 5),
g AS (SELECT query_id, max(share) AS best, max(share) - min(share) AS gap, count(*) FILTER (share >= 0.3) AS n, round(avg(share), 6) AS mean FROM cj GROUP BY query_id)
SELECT query_id, round((CASE WHEN best >= 0.1 THEN 3 WHEN best >= 0.03 THEN 2 WHEN best >= 0.01 THEN 1 ELSE 0 END + CASE WHEN gap >= 0.05 THEN 2 WHEN gap >= 0.02 THEN 1 ELSE 0 END
  + least(n, 3) + CASE WHEN mean >= 0.8 THEN 2 WHEN mean >= 0.5 THEN 1 ELSE 0 END)::DOUBLE / 10 * 0.85::DOUBLE * 0.9::DOUBLE, 4) AS confidence FROM g""",
    "markdown_sections": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT *, line LIKE 'The %' AS h, sum((line LIKE 'The %')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
SELECT doc_id, section, md5(string_agg(line, chr(10) ORDER BY n)) AS text_md5, max(CASE WHEN h THEN line END) AS title FROM s GROUP BY doc_id, section""",
    "table_detect": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM l WHERE contains(line, '|'))
SELECT doc_id, min(n) AS first_line, max(n) AS last_line, array_to_string(list_filter(list_transform(string_split(arg_min(line, n), '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS headers
FROM t GROUP BY doc_id, run HAVING count(*) > 1""",
    "row_summaries": """SELECT p_partkey AS row_id, p_brand || ': name=' || p_name || CASE WHEN p_partkey % 3 <> 0 THEN ', type=' || p_type ELSE '' END || ', size=' || p_size AS summary FROM part""",
    "fill_down": """SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS kind FROM events""",
}
