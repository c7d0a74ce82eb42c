"""Dictionary hits against a plain reading of every position."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corpusloom.operators import dictionary as d


def plain_hits(text, words, boundaries):
    """(keyword, start, stop) of one kind's words, rule by rule."""
    cjk = lambda c: any(a <= ord(c) <= b for a, b in d.IDEOGRAPHS)
    out = []
    for a in range(len(text)):
        for w in words:
            if not text.startswith(w, a):
                continue
            before, after = text[a - 1 : a] if a else "", text[a + len(w) : a + len(w) + 1]
            bad = bool(before) and before in d.NEGATORS
            bad = bad or bool(before) and before not in d.EDGES and (before + w in words or not cjk(before))
            bad = bad or bool(after) and after not in d.EDGES and (w + after in words or not cjk(after))
            if not (boundaries and bad):
                out.append((w, a, a + len(w)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("boundaries", [True, False])
def test_every_hit_of_random_texts(spark, monkeypatch, seed, boundaries):
    rng = random.Random(seed)
    letters = "ab头疼不痛, 𠀀😀."
    make = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(1, most)))
    kinds = {k: {make(4) for _ in range(25)} for k in ("x", "y")}
    texts = [(n, make(60)) for n in range(40)] + [(40, None), (41, ""), (7, make(60)), (None, "a头疼")]
    table = spark.createDataFrame([(k, w, f"{w}!") for k, ws in kinds.items() for w in ws] + [("x", "", "e"), ("x", None, "n")], "kind string, keyword string, canonical string")
    got = d.find(spark.createDataFrame(texts, "id long, text string"), table, boundaries)
    want = [(i, k, w, f"{w}!", a, b) for i, t in texts for k, ws in kinds.items() for w, a, b in plain_hits(t or "", ws, boundaries)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_hits_across_slices_and_parts(spark, monkeypatch):
    words = {"aba", "bab", "ab", "头疼头"}
    text = "abab头疼头疼头ba" * 50
    table = spark.createDataFrame([("k", w, None) for w in words], "kind string, keyword string, canonical string")
    texts = spark.createDataFrame([(1, text), (2, text[3:])], "id long, text string")
    whole = {tuple(r) for r in d.find(texts, table, False).collect()}
    assert whole == {(i, "k", w, w, a, b) for i, t in ((1, text), (2, text[3:])) for w, a, b in plain_hits(t, words, False)}
    monkeypatch.setattr(d, "PART_CHARS", 4)
    parted = d.find(texts, table, False).collect()
    assert len(parted) == len(whole) and {tuple(r) for r in parted} == whole
    monkeypatch.setattr(d, "SLICE", 7)
    held = d.Words([("k", w, w, "", "") for w in sorted(words)])
    points = d._points(text)
    cut = [(int(a), int(b), held.words[w]) for s, e, n in held.hits(points, np.full(len(points), len(points))) for a, b, w in zip(s, e, n, strict=True)]
    assert sorted(cut) == sorted((a, b, w) for w, a, b in plain_hits(text, words, False))


def test_no_words_no_texts(spark):
    none = spark.createDataFrame([], "kind string, keyword string, canonical string")
    texts = spark.createDataFrame([(1, "a")], "id long, text string")
    assert d.find(texts, none).count() == 0
    assert d.find(texts.limit(0), spark.createDataFrame([("k", "a", "b")], none.schema)).count() == 0


def test_names_routes_and_rules(spark):
    rules = spark.createDataFrame([("pain", "头痛", ["头疼", "头痛"]), ("drug", "aspirin", None)], "kind string, name string, synonyms array<string>")
    words = d.from_rules(rules)
    texts = spark.createDataFrame([(1, "aspirin 头疼 头痛"), (2, "hi"), (3, "something else"), (4, None)], "id long, text string")
    names = {(r["id"], r["kind"]): r["names"] for r in d.in_order(d.find(texts, words)).collect()}
    assert names == {(1, "drug"): ["aspirin"], (1, "pain"): ["头痛"]}
    originals = {(r["id"], r["kind"]): r["names"] for r in d.in_order(d.find(texts, words), "keyword").collect()}
    assert originals[(1, "pain")] == ["头疼", "头痛"]
    from pyspark.sql import functions as F

    routed = d.route(texts, words, ["pain", "drug"], F.length(F.coalesce("text", F.lit(""))) <= 4)
    assert dict(map(tuple, routed.collect())) == {1: "pain", 2: "general", 3: None, 4: "general"}


def test_unsupported_words(spark):
    words = spark.createDataFrame([("drug", w, w) for w in ("aspirin", "ibuprofen")], "kind string, keyword string, canonical string")
    answers = spark.createDataFrame([(1, "aspirin or ibuprofen"), (2, "aspirin")], "id long, text string")
    sources = spark.createDataFrame([(1, 10, "about aspirin"), (1, 11, None)], "id long, doc_id long, text string")
    assert [tuple(r) for r in d.unsupported(answers, sources, words).collect()] == [(1, "ibuprofen")]


def test_a_batch_is_taken_apart_in_runs(spark, monkeypatch):
    sizes, inner = [], d._batch_hits
    texts = pa.array(["then and " * 20, None, "", "then " * 200, *["and then"] * 50])
    monkeypatch.setattr(d, "RUN_CHARS", 200)
    for first, stop in d._runs(texts):
        sizes.append(sum(len(t or "") for t in texts.slice(first, stop - first).to_pylist()))
    assert sum(sizes) == sum(len(t or "") for t in texts.to_pylist())
    assert sorted(sizes)[-1] == 1000 and sorted(sizes)[-2] <= 200
    # runs give what the batch gives whole, also where a longer hit of one text must not cover the next text
    words = d.Words([("", w, w, "", "") for w in ("then", "and", "and then")])
    ids, rule = pa.array(range(len(texts))), d.Longest()
    rows = lambda parts: sorted(tuple(r.values()) for p in parts for r in p.to_pylist())
    rule.start(words)
    whole = rows(inner(words, rule, ids, texts))
    got = []
    for a, b in d._runs(texts):
        rule.start(words)
        got += list(inner(words, rule, ids.slice(a, b - a), texts.slice(a, b - a)))
    assert rows(got) == whole and whole
