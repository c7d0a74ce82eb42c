"""Operators against brute-force versions, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import (
    bpe, fingerprint, language, line_dedup, mixing, ngram_join, quality, simple8b, suffix_dedup, token_output, topk,
)
from corpusloom.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies int, label string, range int, cls long, n int"
WORD = re.compile(r"[^ \t-\r]+")


def table(spark, rows):
    """documents with extra columns whose names clash with inner ones."""
    full = [(i, t, lang, s, None if t is None else len(t), 7, "x", 1, 5, 9) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def corpus():
    """Near copies, exact copies, shared passages, nulls, empty, tiny and long texts."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    base = [rng.choice(vocab) for _ in range(120)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(k % 9):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((k, " ".join(w), "en", "a"))
    for k in range(60, 90):
        w = [rng.choice(vocab) for _ in range(90)]
        if k % 3 == 0:
            w[20:20] = passage
        rows.append((k, "\n".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12)), "fr", "b"))
    rows += [(k, rows[k - 90][1], "en", None) for k in range(90, 100)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, "one two", "en", "a"), (103, "One  two", "en", "a"), (104, " \n\n ", "en", "b"), (105, "again " * 3000, "en", "c"), (None, "one two", "en", "a"), (106, "12345 !!", "en", "a")]
    return rows


def by_id(frame, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in frame.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


# --- line dedup


def brute_lines(rows, k, min_words=50):
    docs = sorted([(i is not None, i or 0, t) for i, t, *_ in rows if t is not None])
    filled = [[(p, x) for p, x in enumerate(t.split("\n")) if re.search(r"[^ \t-\r]", x)] for *_, t in docs]
    seen, long, out = set(), set(), []
    for lines in filled:
        dead = set()
        for j in range(len(lines) - k + 1):
            run = tuple(x for _, x in lines[j : j + k])
            if run in seen:
                dead.update(range(j, j + k))
            seen.add(run)
        for j, (_, x) in enumerate(lines):
            if len(WORD.findall(x)) >= min_words:
                if x in long:
                    dead.add(j)
                long.add(x)
        out.append(dead)
    kept = []
    for (known, i, t), lines, dead in zip(docs, filled, out):
        gone = set()
        for j in dead:
            stop = lines[j + 1][0] if j + 1 in dead else lines[j][0] + 1
            gone.update(range(lines[j][0], stop))
        kept.append((i if known else None, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)))
    return sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_line_dedup(spark, k):
    rng = random.Random(k)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " ", "dd"]) for _ in range(rng.randrange(0, 9))), "en", "a") for i in range(25)]
    rows += [(100, "x\ny\nz\nx\ny\nz\nx\ny\nz", "en", "a"), (101, "x\ny\n\nz\n", None, None), (None, "x\ny", "en", "a")]
    got = by_id(line_dedup.dedup_lines(table(spark, rows), k), "text")
    assert got == brute_lines(rows, k)


def test_line_dedup_of_long_single_lines(spark):
    passage, short = " ".join(f"p{k}" for k in range(50)), " ".join(f"p{k}" for k in range(49))
    rows = [(k, f"head {k}\n{passage}\nmid {k}\n\n{short}\ntail {k}", "en", "a") for k in range(4)] + [(9, passage, "en", "b"), (None, passage, "en", "b")]
    got = by_id(line_dedup.dedup_lines(table(spark, rows)), "text")
    assert got == brute_lines(rows, 2) and ("p49" in got[0][1]) + ("p49" in got[-1][1]) == 1 and all("p48" in t for i, t in got if i in (1, 2, 3))
    kept = by_id(line_dedup.dedup_lines(table(spark, rows), min_words=None), "text")
    assert kept == brute_lines(rows, 2, 10**9)


def test_columns_with_any_name_come_back(spark):
    rows = [(1, "a\nb\nc", "a", "x"), (2, "a\nb\nd", "a", "y"), (2, "a\nb\nd", "a", "y"), (3, None, None, "z"), (4, "", "b", "w")]
    names = ["_key", "_nth", "_dh", "_lines", "inner_0", "inner_1", "Inner_2", "copies", "label", "text_key"]
    docs = spark.createDataFrame([(*r[:3], *[r[3] + c for c in names]) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    for keep in (line_dedup.dedup_lines, ngram_join.keep_one_of_each, mixing.mix):
        out = keep(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == r["_key"][:1] + c for r in got for c in names)


def test_line_dedup_of_null_repeated_and_no_rows(spark):
    rows = [(1, None, "en", "a"), (2, "a\nb", "en", "a"), (2, "a\nb", "en", "a"), (3, "", "en", "a")]
    assert by_id(line_dedup.dedup_lines(table(spark, rows)), "text") == [(1, None), (2, "a\nb"), (2, "a\nb"), (3, "")]
    assert line_dedup.dedup_lines(table(spark, rows[:0])).count() == 0


# --- Simple-8b and token shards


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 1 << 31, 1 << 63])
def test_simple8b_round_trip(n, high):
    v = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64)
    words, offsets, escapes = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, escapes, n) == v).all()
    if n > simple8b.BLOCK:
        assert (simple8b.decode(words, offsets, escapes, n - simple8b.BLOCK, 1) == v[simple8b.BLOCK :]).all()


def test_token_shards(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    odd = [(200, "It's Über-ÉTÉ. x, y.. <|endoftext|> <|ENDOFTEXT|> İ á z !., 12.5", "en", "a"), (201, "Q" * 300 + ".", "en", "a")]
    rows = sorted(corpus + odd, key=lambda r: (r[0] is not None, r[0] or 0))
    shards = token_output.write_tokens(table(spark, rows), vocabulary("word_bpe_49k.json"))
    at, want = 0, []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_output.digest_tokens(shards).orderBy("start").collect()]
    assert got == want
    assert token_output.read_tokens(shards).filter("doc_id = 102").first()["ids"][-1] == 1
    assert token_output.digest_tokens(token_output.write_tokens(table(spark, []), vocabulary("word_bpe_49k.json"))).count() == 0


# --- fingerprints


def test_fingerprints(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for r, nxt in zip(order, order[1:] + order[:1]):
        text, after = r[1] or "", nxt[1] or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + after[:n]
        row = got[r[0]]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        for other, near in ((changed, row["near_edited"]), (after, row["near_next"])):
            a, b = shingle_set(text), shingle_set(other)
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1)) < 0.15
    assert got[102]["fingerprint"] == got[103]["fingerprint"] != "" and got[101]["fingerprint"] == got[100]["fingerprint"] == ""
    assert fingerprint.compare_with_next(table(spark, rows[:1])).first()["near_next"] == 1
    assert fingerprint.compare_with_next(table(spark, [])).count() == 0


# --- repeated passages


def brute_passages(rows, k=50):
    docs = sorted({(i is None, i or 0, tuple(words_of(t))) for i, t, *_ in rows})
    places = {}
    for d, (*_, w) in enumerate(docs):
        for p in range(len(w) - k + 1):
            places.setdefault(w[p : p + k], []).append((d, p))
    cover, late = {}, {}
    for found in places.values():
        if len(found) > 1:
            for j, (d, p) in enumerate(found):
                cover.setdefault(d, set()).update(range(p, p + k))
                if j:
                    late.setdefault(d, set()).update(range(p, p + k))
    out = []
    for d, covered in cover.items():
        start = None
        for p in [*sorted(covered), None]:
            if start is None:
                start = last = p
            elif p is not None and p == last + 1:
                last = p
            else:
                stretch = set(range(start, last + 1))
                out.append((None if docs[d][0] else docs[d][1], start, last + 1, len(stretch & late.get(d, set()))))
                start = last = p
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_rows", [10, 100_000])
def test_repeated_passages(spark, corpus, slice_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_rows)
    got = suffix_dedup.repeated_passages(table(spark, corpus))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_passages(corpus)
    assert suffix_dedup.repeated_passages(table(spark, [])).count() == 0


def test_passages_that_many_documents_share(spark):
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, line = text(58), text(9)
    rows = [(k, " ".join(text(rng.randrange(5, 60)) + shared * (k % 3 == 0) + text(rng.randrange(5, 60))), "en", "a") for k in range(240)]
    rows += [(k, " ".join(line * rng.randrange(3, 40)), "en", "a") for k in range(240, 250)]  # period shorter than a gram
    rows += [(None, rows[0][1], "en", "a"), (-1, rows[0][1], "en", "a"), (251, rows[3][1], "en", None), (251, rows[3][1], "en", None)]
    for parts in (1, 7):
        got = suffix_dedup.repeated_passages(table(spark, rows).repartition(parts))
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_passages(rows)


# --- n-gram Jaccard join


def brute_components(rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                label[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, *_) in enumerate(rows)), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.mark.parametrize("piece", [500_000, 2000, 300])
def test_ngram_components(spark, corpus, piece, monkeypatch):
    monkeypatch.setattr(ngram_join, "PIECE", piece)
    assert by_id(ngram_join.link_documents(table(spark, corpus)), "n_shingles", "component_id") == brute_components(corpus)


def test_keep_one_of_each(spark, corpus):
    kept = ngram_join.keep_one_of_each(table(spark, corpus + [corpus[3]]))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    ids = [r["doc_id"] for r in kept.collect()]
    parts = {(c if c is not None else i) if n else ("empty", i) for i, n, c in brute_components(corpus)}
    assert len(ids) == len(parts) and {100, 101, 104} <= set(ids)
    assert ngram_join.keep_one_of_each(table(spark, [])).count() == 0


def test_keep_one_of_each_tells_components_without_doc_id_apart(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(None, one, "en", "a"), (None, one + " more", "en", "a"), (None, two, "en", "a"), (None, three, "en", "a"), (None, three, "en", "a"), (7, three + " more", "en", "a"), (None, "", "en", "a")]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one_of_each(table(spark, rows)).collect()]
    parts = sorted("".join(sorted({w[0] for w in words_of(t)} & set("abc"))) for _, t in kept)
    assert parts == ["", "a", "b", "c"]


@pytest.mark.parametrize("shared", [0, 7])
def test_ngram_components_of_sparse_tables(spark, shared):
    rng = random.Random(shared)
    text = lambda: " ".join(f"v{rng.randrange(10_000)}" for _ in range(60))
    common = " ".join(f"c{k}" for k in range(shared))
    rows = [(k, f"{common} {text()}", "en", "a") for k in range(6)]
    if not shared:
        near = text()
        rows += [(10, near, "en", "a"), (11, near + " more", "en", "a")]
    docs = table(spark, rows).repartition(4, "doc_id")
    assert by_id(ngram_join.link_documents(docs), "n_shingles", "component_id") == brute_components(rows)
    assert ngram_join.keep_one_of_each(docs).count() == len({c for *_, c in brute_components(rows)})


# --- language


def test_language(spark):
    rng = random.Random(2)
    kinds = {"en": ["the", "and", "thing", "with"], "de": ["und", "der", "schlüß", "ich"], "fr": ["été", "que", "où", "les"]}
    rows = [(k, " ".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(3, 60))), lang, "a") for k in range(240) for lang in [list(kinds)[k % 3]]]
    odd = [(900, None, "en", "a"), (901, "", "en", "a"), (902, "123 !!", "en", "a"), (903, "the and with thing", None, None), (None, "und der ich schlüß und", "de", "a"), (904, "the and " * 30_000, "en", "a")]
    got = language.identify(table(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    guess = {r["doc_id"]: r for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(held) == sorted(i for i, *_ in rows if guess[i]["held_out"])
    assert np.mean([guess[i]["lang_pred"] == rows[i][2] for i in held]) >= 0.95
    assert [guess[i]["lang_pred"] for i in (900, 901, 902, 903, 904, None)] == ["und", "und", "und", "en", "en", "de"]
    kept = language.keep_identified(table(spark, rows + odd))
    assert {900, 901, 902}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() >= len(rows)
    assert language.identify(table(spark, odd[:3])).filter("lang_pred <> 'und'").count() == 0
    assert language.identify(table(spark, [])).count() == 0


# --- BPE


def test_bpe_equals_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), bpe.ForcedBoundaryBPE(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = [*"abcdE'st\n\t .,!?é日 　​́😀<|>12\x1c\x85\xa0à", "<|endoftext|>", "  ", "'re", "\r\n", "word. ", "été, "]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for text in ("<|endoftext|>" * 20_000, "a<|endoftext|>" * 9000 + " <|endof"):  # in time that grows with the text
        assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    text = "ab" * 3000 + "é" * 2000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    ids = bpe.encode_documents(table(spark, corpus), vocabulary("byte_bpe_50k.json"))
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids, vocabulary("byte_bpe_50k.json")).filter("doc_id is not null").collect()}
    assert all(back[i] == (t or "") for i, t, *_ in corpus if i is not None)


# --- importance resampling


def test_resampling(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["good", "fine", "well"] if k % 2 else ["junk", "spam", "xx"]) for _ in range(20)), "en", "a") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(500, None, None, None), (501, "", "en", "a")])
    got = quality.resample(docs, labels, 0.4).collect()
    chosen = [r["doc_id"] for r in got if r["selected"]]
    assert len(got) == 202 and len(chosen) == 81 and sum(i % 2 for i in chosen) >= 79
    keys = sorted((r["key"] for r in got), reverse=True)
    assert min(r["key"] for r in got if r["selected"]) == keys[80]
    assert {r["log_weight"] for r in got if r["doc_id"] in (500, 501)} == {0.0}
    assert quality.resample(table(spark, []), labels).count() == 0
    assert quality.resample(docs, labels.limit(0)).agg(F.max(F.abs("log_weight"))).first()[0] == 0


def test_target_model_counts_every_good_document(spark):
    # ids without a document, more than 20,000 of them, take up no places
    labels = spark.range(21_000).selectExpr("id + 1000 as doc_id", "1 as quality", "0 as toxic").unionByName(spark.createDataFrame([(k, 1, 0) for k in range(100)], "doc_id long, quality int, toxic int"))
    rows = [(k, f"word{k}" if k < 100 else "junk", "en", "a") for k in range(200)] + [(None, "junk", "en", "a")]
    ratios = quality.log_ratios(table(spark, rows), labels)
    bucket, _ = quality._buckets([t.encode() for _, t, *_ in rows])
    raw, target = (1.0 + np.bincount(b, minlength=quality.BUCKETS) for b in (bucket, bucket[:100]))
    assert np.allclose(ratios, np.log(target / target.sum()) - np.log(raw / raw.sum()), rtol=0, atol=1e-12)


# --- top-k


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in rng.normal(size=6)]) for k in range(300)]
    rows += [(k, [0.5] * 6) for k in range(300, 340)] + [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, [9.0] * 6), (420, [1.0, 2.0]), (440, [3.0, 4.0]), (460, [1e9] * 6)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect()
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).count() == 0


# --- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= w[s] * level}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, corpus):
    rows = [(k, "x " * (k % 17), "en", s) for k, s in enumerate(["a", "b", "c", "d", None, "é"] * 120)] + [r for r in corpus if r[0] != 105]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    target = brute_targets(sizes)
    got = mixing.mix_plan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for s in sizes:
        of = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s]) for r in of)
        assert all(r["taken"] <= 2 * r["size"] for r in of)
        assert abs(sum(r["taken"] for r in of) - target[s]) <= max(r["size"] for r in of) + 1
    out = mixing.mix(table(spark, rows + [rows[5], rows[5]]))
    assert out.columns == table(spark, []).columns
    again = mixing.mix_plan(table(spark, rows + [rows[5], rows[5]]))
    assert out.count() == again.agg(F.sum("copies")).first()[0]
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mix_plan(table(spark, [(1, None, None, None)])).first()["taken"] == 0
