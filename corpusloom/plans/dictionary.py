"""Dictionary queries: rules made of the words of ``benchmark``, found in documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import dictionary as d
from corpusloom.plans.retrieval import BM25_SQL, bm25_hits
from corpusloom.plans.tables import read

ORDER = ["emergency", "symptom", "drug"]


def _words(spark, sf_dir):
    """Words of three characters or more; those that begin alike are one rule."""
    w = read(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"), 3)).alias("w")).distinct()
    digest = F.md5("head")
    kind = F.when(digest < "4", "emergency").when(digest < "8", "symptom").otherwise("drug")
    rules = w.groupBy(F.expr("left(w, 4)").alias("head")).agg(F.min("w").alias("name"), F.collect_set("w").alias("synonyms"))
    return d.from_rules(rules.select(kind.alias("kind"), "name", "synonyms"))


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")


def dictionary_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return d.find(docs, _words(spark, sf_dir))


def dictionary_originals(spark, sf_dir):
    found = d.in_order(d.find(_turns(spark, sf_dir), _words(spark, sf_dir)), "keyword")
    return found.select("id.conv_id", "id.turn", "kind", F.array_join("names", ",").alias("names"))


def dictionary_routes(spark, sf_dir):
    turns = _turns(spark, sf_dir).withColumn("text", F.lower("text"))
    routed = d.route(turns, _words(spark, sf_dir), ORDER, F.length(F.trim(F.coalesce("text", F.lit("")))) <= 4)
    return routed.select("id.conv_id", "id.turn", "route")


def unsupported_names(spark, sf_dir):
    """Words of an item that none of its two best documents has; a text here is its own answer."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    hits = bm25_hits(spark, sf_dir, 2).select(F.col("query_id").alias("id"), F.col("chunk_id").alias("doc_id"))
    answers = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    words = _words(spark, sf_dir).filter("kind = 'drug'")
    return d.unsupported(answers, hits.join(docs, "doc_id"), words)


QUERIES = {f.__name__: f for f in (dictionary_scan, dictionary_originals, dictionary_routes, unsupported_names)}

_W = """w AS (SELECT keyword, min(keyword) OVER (PARTITION BY head) AS canonical, CASE WHEN md5(head) < '4' THEN 'emergency' WHEN md5(head) < '8' THEN 'symptom' ELSE 'drug' END AS kind
  FROM (SELECT DISTINCT keyword, left(keyword, 4) AS head FROM (SELECT unnest(regexp_extract_all(lower(text), '[一-鿿a-z0-9]+')) AS keyword FROM benchmark) WHERE length(keyword) >= 3))"""
# a row a place in a text, by words between spaces, which no keyword crosses: the character before it, what follows in the word and the space behind it
_PLACES = """(SELECT * EXCLUDE (word, nth, first, q, behind), first + q AS p, CASE WHEN q > 1 THEN substr(word, q - 1, 1) WHEN before IS NOT NULL THEN ' ' END AS lc,
  CASE WHEN q = 1 THEN before END AS word_before, substr(word || CASE WHEN behind IS NULL THEN '' ELSE ' ' END, q, (SELECT max(length(keyword)) + 1 FROM w)) AS ahead
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS q FROM (
    SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY {1} ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
      lag(word) OVER (PARTITION BY {1} ORDER BY nth) AS before, lead(word) OVER (PARTITION BY {1} ORDER BY nth) AS behind
    FROM (SELECT * EXCLUDE (text), unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS nth FROM ({0})))))"""
_HITS = f"""(SELECT t.* EXCLUDE (p, ahead, before, word_before), kind, keyword, canonical, p - 1 AS start, p - 1 + length(keyword) AS stop, nullif(substr(ahead, length(keyword) + 1, 1), '') AS rc
  FROM {_PLACES} t JOIN w ON left(ahead, 3) = left(keyword, 3) AND starts_with(ahead, keyword))"""
_EDGES = d.EDGES.replace("'", "''")
_ALONE = f"""coalesce(NOT contains('{d.NEGATORS}', lc), true)
  AND coalesce(contains('{_EDGES}', lc) OR regexp_matches(lc, '[㐀-䶿一-鿿\\x{{20000}}-\\x{{2A6DF}}]') AND kind || lc || keyword NOT IN (SELECT kind || keyword FROM w), true)
  AND coalesce(contains('{_EDGES}', rc) OR regexp_matches(rc, '[㐀-䶿一-鿿\\x{{20000}}-\\x{{2A6DF}}]') AND kind || keyword || rc NOT IN (SELECT kind || keyword FROM w), true)"""
_OF_DICT = f"""h AS (SELECT id, keyword, p - 1 AS s, p - 1 + length(keyword) AS e, coalesce(lc, '') AS lc, substr(ahead, length(keyword) + 1, 1) AS rc, word_before
  FROM {_PLACES.format('SELECT doc_id AS id, text FROM documents', 'id')} JOIN w ON left(ahead, 3) = left(keyword, 3) AND starts_with(ahead, keyword)),
g AS (SELECT * FROM h WHERE NOT (regexp_matches(lc, '[a-zA-Z0-9]') AND regexp_matches(keyword, '^[a-zA-Z0-9]')) AND NOT (regexp_matches(rc, '[a-zA-Z0-9]') AND regexp_matches(keyword, '[a-zA-Z0-9]$')) {{0}}),
k AS (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g)"""
_SMALL = "w(keyword, canonical) AS (VALUES ('then', 'when'), ('thenth', 'when'), ('and', 'both'), ('the', 'article'), ('from', 'source'), ('und', 'both'), ('avec', 'with'), ('pour', 'for'))"

ORACLES = {
    "dictionary_scan": f"WITH {_W} SELECT id, kind, keyword, canonical, start, stop FROM {_HITS.format('SELECT doc_id AS id, text FROM documents', 'id')} WHERE {_ALONE}",
    "dictionary_originals": f"""WITH {_W}, f AS (SELECT conv_id, turn, kind, keyword, min({{'e': stop, 's': start}}) AS place FROM {_HITS.format('SELECT conv_id, turn, text FROM conversations', 'conv_id, turn')} WHERE {_ALONE} GROUP BY ALL)
SELECT conv_id, turn, kind, string_agg(keyword, ',' ORDER BY place, keyword) AS names FROM f GROUP BY ALL""",
    "dictionary_routes": f"""WITH {_W}, c AS (SELECT conv_id, turn, lower(text) AS text FROM conversations),
f AS (SELECT conv_id, turn, min(CASE kind WHEN 'emergency' THEN 0 WHEN 'symptom' THEN 1 ELSE 2 END) AS k FROM {_HITS.format('SELECT * FROM c', 'conv_id, turn')} GROUP BY ALL)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'emergency' WHEN 1 THEN 'symptom' WHEN 2 THEN 'drug' ELSE CASE WHEN length(trim(coalesce(text, ''))) <= 4 THEN 'general' END END AS route FROM c LEFT JOIN f USING (conv_id, turn)""",
    "unsupported_names": f"""WITH {BM25_SQL}, {_W}, r AS (SELECT query_id AS id, text FROM ranked JOIN d USING (chunk_id) WHERE rank <= 2),
x AS (SELECT r.id, keyword FROM r JOIN w ON contains(r.text, keyword) WHERE kind = 'drug' GROUP BY ALL)
SELECT item_id AS id, keyword FROM benchmark b JOIN w ON kind = 'drug' AND contains(b.text, keyword) WHERE item_id IN (SELECT id FROM r) AND NOT EXISTS (SELECT 1 FROM x WHERE x.id = b.item_id AND x.keyword = w.keyword)""",
    "dictionary_match": f"WITH {_SMALL}, {_OF_DICT.format("AND coalesce(NOT suffix(word_before, 'not'), true)")} SELECT id, keyword, canonical, s::INT AS start, e::INT AS stop FROM k JOIN w USING (keyword) WHERE reach IS NULL OR e > reach",
    "dictionary_names": f"""WITH {_SMALL}, {_OF_DICT.format('')}, f AS (SELECT id, canonical, min(s) AS s FROM k JOIN w USING (keyword) WHERE reach IS NULL OR e > reach GROUP BY ALL)
SELECT id, string_agg(canonical, ',' ORDER BY s, canonical) AS names FROM f GROUP BY id""",
}
