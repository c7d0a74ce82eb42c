"""The sparse index against brute-force BM25, through updates, deletes, a crash and a merge."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval, sparse_index
from corpusloom.operators.sparse_index import SparseIndex


@pytest.fixture
def small(monkeypatch):
    for name, value in (("SHARD", 40), ("BLOCK", 4), ("CHUNK", 3)):
        monkeypatch.setattr(sparse_index, name, value)


def corpus(n=130, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    docs = {k: (f"s{k % 7}" if k % 9 else None, rng.choices(vocab, weights, k=rng.randrange(1, 30))) for k in range(n)}
    docs[500], docs[501] = ("s1", []), ("s2", ["only"])
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in docs.items()], "chunk_id long, source string, terms array<string>")


def asked(spark, queries):
    return spark.createDataFrame([(q, t, n) for q, terms in queries.items() for t, n in Counter(terms).items()], "query_id long, term string, tf long")


def brute(docs, queries, k):
    n, mean = len(docs), sum(len(t) for _, t in docs.values()) / len(docs)
    df = Counter(t for _, terms in docs.values() for t in set(terms))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if r < 0 else r for t, r in raw.items()}
    out = []
    for q, terms in queries.items():
        scores = {}
        for t in terms:
            for i, (_, words) in docs.items():
                if tf := words.count(t):
                    scores[i] = scores.get(i, 0.0) + idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
        best = sorted(scores, key=lambda i: (-round(scores[i], 6), i))[:k]
        out += [(q, i, nth, round(round(scores[i], 6), 5)) for nth, i in enumerate(best, 1)]
    return sorted(out)


def hits(frame):
    return sorted((r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 5)) for r in frame.collect())


def questions(seed=2):
    rng = random.Random(seed)
    q = {k: rng.choices([f"w{j}" for j in range(60)], k=rng.randrange(1, 12)) for k in range(10)}
    return q | {90: ["unknown"], 91: ["only", "only"], 92: ["w0"], 93: ["w59", "unknown", "w0", "w0"]}


@pytest.mark.parametrize("k", [1, 5, 200])
def test_search(spark, small, tmp_path, k):
    docs, queries = corpus(), questions()
    index = SparseIndex(spark, f"file://{tmp_path}")
    index.build(frame(spark, docs))
    assert hits(index.search(asked(spark, queries), k)) == brute(docs, queries, k)
    # the same as without an index
    one = frame(spark, docs)
    postings, lengths = retrieval.term_counts(one, "chunk_id", one.terms), one.selectExpr("chunk_id", "size(terms) AS length")
    plain = retrieval.bm25_top_k(asked(spark, queries), postings, lengths, k)
    assert hits(plain) == brute(docs, queries, k)


def test_most_blocks_of_frequent_terms_stay_unread(spark, small, tmp_path):
    rng = random.Random(5)
    docs = {k: ("s", ["the", *rng.choices([f"v{j}" for j in range(400)], k=8)]) for k in range(400)}
    for k in range(0, 40):
        docs[k][1].append("rare")
    index = SparseIndex(spark, f"file://{tmp_path}")
    index.build(frame(spark, docs))
    queries = {1: ["the", "rare"], 2: ["v3", "v4", "the"]}
    assert hits(index.search(asked(spark, queries), 2)) == brute(docs, queries, 2)
    told = {r["query_id"]: r for r in index.skips(asked(spark, queries), 2).collect()}
    assert told[1]["blocks"] >= 100 and told[1]["skipped"] > 0.5 * told[1]["blocks"]


def test_negative_weights(spark, small, tmp_path):
    docs = {k: ("s", ["a", "b", f"x{k % 2}"]) for k in range(30)}
    queries = {1: ["a"], 2: ["a", "x1"], 3: ["b", "x0"]}
    index = SparseIndex(spark, f"file://{tmp_path}")
    index.build(frame(spark, docs))
    assert hits(index.search(asked(spark, queries), 4)) == brute(docs, queries, 4)


def test_updates(spark, small, tmp_path, monkeypatch):
    docs, queries = corpus(), questions()
    index = SparseIndex(spark, f"file://{tmp_path}")
    index.build(frame(spark, docs))

    def update(new, sources):
        held = set(sources)
        for i in [i for i, (s, _) in docs.items() if s in held]:
            del docs[i]
        docs.update(new)
        index.update(frame(spark, new), spark.createDataFrame([(s,) for s in sources], "source string"))

    def files():
        return {p for p in tmp_path.rglob("*.parquet") if "/log/" not in str(p)}

    before = files()
    update({i + 1000: (s, t[::-1] + ["new"]) for i, (s, t) in corpus(60, 8).items() if s in ("s1", None)}, ["s1", None])
    assert before <= files()  # what was written stays as it is
    assert hits(index.search(asked(spark, queries), 5)) == brute(docs, queries, 5)
    update({i: (s, t) for i, (s, t) in corpus(80, 9).items() if s == "s3"}, ["s3", "s4", "s5", "never seen"])  # ids used again, sources deleted
    assert hits(index.search(asked(spark, queries), 5)) == brute(docs, queries, 5)
    # a writer that dies before the log changes nothing
    commit = SparseIndex._commit
    monkeypatch.setattr(SparseIndex, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        index.update(frame(spark, {7000: ("s2", ["w0"] * 9)}), spark.createDataFrame([("s2",)], "source string"))
    monkeypatch.setattr(SparseIndex, "_commit", commit)
    assert hits(SparseIndex(spark, f"file://{tmp_path}").search(asked(spark, queries), 5)) == brute(docs, queries, 5)
    index.merge()
    assert len(index.log()) == 1 and hits(index.search(asked(spark, queries), 5)) == brute(docs, queries, 5)
    update({8000: ("s6", ["w1", "w2"])}, ["s6"])
    assert hits(index.search(asked(spark, queries), 5)) == brute(docs, queries, 5)
    docs.clear()
    docs.update(corpus(20, 3))
    index.build(frame(spark, docs))
    assert hits(index.search(asked(spark, queries), 5)) == brute(docs, queries, 5)


def test_index_of_nothing(spark, tmp_path):
    index = SparseIndex(spark, f"file://{tmp_path}")
    index.build(spark.createDataFrame([], "chunk_id long, source string, terms array<string>"))
    assert index.search(asked(spark, {1: ["a"]}), 3).collect() == []
    index.update(frame(spark, {1: (None, ["a", "b"]), 2: ("x", [])}), spark.createDataFrame([(None,), ("x",)], "source string"))
    assert [r["chunk_id"] for r in index.search(asked(spark, {1: ["a"]}), 3).collect()] == [1]


def test_shards_stay_small():
    assert sparse_index.SHARD <= 1 << 14  # a task holds the postings of a shard for a chunk of queries


def records_moved(spark):
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_a_build_moves_documents_not_their_words(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    docs = {k: ("s", rng.choices([f"w{j}" for j in range(60)], k=1000)) for k in range(40)}
    # parts end within a task's documents, too
    monkeypatch.setattr(sparse_index, "PACK", 1500)
    index, before = SparseIndex(spark, f"file://{tmp_path}"), records_moved(spark)
    index.build(frame(spark, docs))
    assert records_moved(spark) - before < 10_000
    assert hits(index.search(asked(spark, questions()), 5)) == brute(docs, questions(), 5)
    # terms made where a document was dealt to
    texts = spark.createDataFrame([(i, s, " ".join(t)) for i, (s, t) in docs.items()], "chunk_id long, source string, text string")
    again = SparseIndex(spark, f"file://{tmp_path}/again")
    again.build(texts, F.split("text", " "))
    assert hits(again.search(asked(spark, questions()), 5)) == brute(docs, questions(), 5)


def test_postings_of_null_and_empty_lists(spark, tmp_path):
    rows = [(1, "s", ["a", None, "a"]), (2, None, None), (3, "s", []), (4, "t", ["b"])]
    index = SparseIndex(spark, f"file://{tmp_path}")
    index.build(spark.createDataFrame(rows, "chunk_id long, source string, terms array<string>"))
    found = index._postings([index.log()[0]["segment"]]).select("term", "chunk_id", "tf", "length").collect()
    assert sorted(map(tuple, found)) == [("a", 1, 2, 3), ("b", 4, 1, 1)]
    assert (index.log()[0]["docs"], index.log()[0]["words"]) == (4, 4)


def test_a_query_that_reads_hits_twice_searches_once(spark, monkeypatch):
    from corpusloom.plans import retrieval as plans

    plan = plans.answer_overlap(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan
