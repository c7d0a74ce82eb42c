"""Best paths and states against brute force over all segmentations, and the queries' own model on a small corpus."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import segmentation as seg


def cuts(run):
    for gaps in itertools.product((False, True), repeat=len(run) - 1):
        ends = [k + 1 for k, g in enumerate(gaps) if g] + [len(run)]
        yield [run[a:b] for a, b in zip([0, *ends], ends)]


def score(lexicon, words):
    parts = [lexicon.words.get(w, lexicon.unknown if len(w) == 1 else -math.inf) for w in words]
    return sum(parts)


@pytest.mark.parametrize("seed", range(6))
def test_best_path(seed):
    rng = random.Random(seed)
    lexicon = seg.Lexicon({"".join(rng.choices("abc", k=rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(12)})
    for _ in range(40):
        run = "".join(rng.choices("abcd", k=rng.randrange(1, 10)))
        found = lexicon.path(run)
        assert "".join(found) == run
        assert math.isclose(score(lexicon, found), max(score(lexicon, c) for c in cuts(run)))


def states_of(words):
    return [s for w in words for s in ([3] if len(w) == 1 else [0, *[1] * (len(w) - 2), 2])]


@pytest.mark.parametrize("seed", range(4))
def test_likeliest_states(seed):
    rng = random.Random(seed)
    p = lambda n: [x / sum(v) for v in [[rng.random() for _ in range(n)]] for x in v]
    first, follow = p(2), [[0.0] * 4 for _ in range(4)]
    for s in range(4):
        follow[s] = [0.0, *p(2), 0.0] if s in (0, 1) else [(q := p(2))[0], 0.0, 0.0, q[1]]
    hidden = seg.Hidden([first[0], 0, 0, first[1]], follow, {(s, c): rng.randrange(1, 9) for s in range(4) for c in "abc"})

    def value(run, states):
        emit = [hidden.chars.get((s, c), hidden.rare[s]) for s, c in zip(states, run)]
        return hidden.start[states[0]] + sum(hidden.follow[a][b] for a, b in zip(states, states[1:])) + sum(emit)

    for _ in range(40):
        run = "".join(rng.choices("abcd", k=rng.randrange(1, 9)))
        found = hidden.cut(run)
        assert "".join(found) == run
        assert math.isclose(value(run, states_of(found)), max(value(run, states_of(c)) for c in cuts(run)))


def brute_model(rows):
    """Counts of the corpus, one word after the other."""
    counts, start, follow, chars = {}, [1.0, 0, 0, 1.0], [[0.0] * 4 for _ in range(4)], {}
    for words in rows:
        states = [states_of([w]) for w in words]
        if words:
            start[states[0][0]] += 1
        for w, s in zip(words, states):
            counts[w] = counts.get(w, 0) + 1
            for c, x in zip(w, s):
                chars[x, c] = chars.get((x, c), 0) + 1
        flat = [x for s in states for x in s]
        for a, b in zip(flat, flat[1:]):
            follow[a][b] += 1
    for s, before in {0: (2, 3), 1: (0, 1), 2: (0, 1), 3: (2, 3)}.items():
        for b in before:
            follow[b][s] += 1
    return counts, seg.Hidden([x / sum(start) for x in start], [[x / sum(r) for x in r] for r in follow], chars)


def test_model_of_a_corpus(spark):
    rng = random.Random(3)
    vocab = ["头痛", "发热", "三天", "高血压", "的", "了", "患者", "服用", "阿司匹林", "a", "伴", "咳嗽"]
    rows = [rng.choices(vocab, k=rng.randrange(0, 12)) for _ in range(60)]
    words = spark.createDataFrame([(r,) for r in rows] + [(None,)], "words array<string>")
    model = seg.segmenter(words, 1)
    counts, hidden = brute_model(rows)
    assert model.lexicon.words == seg.Lexicon(counts).words and model.hidden.chars == hidden.chars
    assert all(math.isclose(a, b) for x, y in zip(model.hidden.follow, hidden.follow) for a, b in zip(x, y) if b > -math.inf)
    assert all(math.isclose(a, b) for a, b in zip(model.hidden.start, hidden.start) if b > -math.inf)
    texts = spark.createDataFrame([(1, "患者头痛三天，Fever 38度。"), (2, ""), (3, None), (4, "龘龘龘"), (5, "服用阿司匹林" * 3000)], "id int, text string")
    got = {r["id"]: r["t"] for r in texts.select("id", seg.terms(model, texts).alias("t")).collect()}
    assert got[1] == ["患者", "头痛", "三天", "fever", "38", *model.words("度")] and got[2] == got[3] == []
    assert "".join(got[4]) == "龘龘龘" and got[5] == ["服用", "阿司匹林"] * 3000
    assert [r["t"] for r in texts.filter("id = 1").select(seg.telling(F.array(F.lit("头痛"), F.lit("的"), F.lit("三天")), ["三天"]).alias("t")).collect()] == [["头痛"]]


def test_unknown_words_by_states(spark):
    # two-character words only, so an unknown stretch of four is cut in pairs
    rows = [("".join(p),) for p in itertools.product("甲乙丙", "子丑寅")] * 5
    model = seg.segmenter(spark.createDataFrame([(list(r) * 4,) for r in rows], "words array<string>"), 10**6)
    assert not model.lexicon.words and model.words("甲子乙丑丙寅") == ["甲子", "乙丑", "丙寅"]
    nothing = seg.segmenter(spark.createDataFrame([], "words array<string>"))
    assert "".join(nothing.words("甲子")) == "甲子" and nothing.words("甲") == ["甲"]


def test_query_against_plain_python(spark):
    from corpusloom.plans import segmentation as plan

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) for r in docs]
    counts, hidden = brute_model(rows)
    plain = seg.Segmenter(seg.Lexicon({w: n for w, n in counts.items() if n >= 3}), hidden, plan.LETTERS, plan.DIGITS)
    got = {r["doc_id"]: r for r in plan.segmented_terms(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for r, words in zip(docs, rows):
        n = len(plain.terms(re.sub(r"\s+", "", r["text"] or "")))
        assert got[r["doc_id"]]["n_terms"] == n
    assert sum(r["recall"] for r in got.values()) > 0.5 * len(got)


@pytest.mark.parametrize("seed", range(4))
def test_runs_together_and_alone(seed, monkeypatch):
    rng = random.Random(seed)
    lexicon = seg.Lexicon({"".join(rng.choices("ab龘", k=rng.randrange(1, 5))): rng.randrange(1, 4) for _ in range(12)})
    runs = ["".join(rng.choices("ab龘c", k=rng.randrange(0, 12))) for _ in range(50)]
    together = lexicon.paths(runs)
    for run, found in zip(runs, together):
        assert "".join(found) == run and not run or math.isclose(score(lexicon, found), max(score(lexicon, c) for c in cuts(run)))
    monkeypatch.setattr(seg, "LONG", 0)
    assert lexicon.paths(runs) == together


def test_tasks_get_arrays_only():
    sent = seg.Lexicon({f"w{k}": 1 for k in range(1000)}).__getstate__()
    assert not any(isinstance(v, (dict, set)) for v in sent.values())


def test_documents_of_one_file_are_cut_in_many_tasks(spark):
    from corpusloom.plans import segmentation as plan

    assert plan._spread(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
