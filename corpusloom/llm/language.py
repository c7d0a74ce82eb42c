"""Language identification by sparse multinomial logistic regression on TF-IDF n-grams.

Features are the character 1- to 3-grams of a lower-cased text, hashed to BUCKETS; a
feature's value is its share of the text's n-grams times its inverse document frequency over
all training documents. Weights are learned by follow-the-regularised-leader with L1 and L2
penalties, which leaves most of them 0, from at most SAMPLE_ROWS labelled documents, as many
of each language; a quarter of those is kept to fit the temperature of the scores instead.

Since a value is linear in counts, a text's scores are the mean over its n-grams of their
weights, and prediction needs no count table.

Defined cases: null text, or text without a letter, is ``und`` with score 0; so is every
text if nothing can be learned; rows with a null id are held out; rows with a null language
are predicted but not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm.trim import frugal

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The most labelled documents that weights are learned from.
SAMPLE_ROWS = 3000
UNKNOWN = "und"
_CHUNK_CHARS = 1 << 18
_CHUNK_DOCS = 64
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _chunks(texts: Sequence[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        if held and (size + len(t) > _CHUNK_CHARS or len(held) >= _CHUNK_DOCS):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _ngrams(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (bucket at each place of the joined texts, BUCKETS where none starts; first places)."""
    parts = [np.frombuffer(f" {' '.join(t.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in parts])
    stops = np.cumsum(sizes)
    begins = stops - sizes
    code = np.concatenate(parts)
    padded = np.concatenate((code, np.zeros(max(ORDERS), np.uint32)))
    for n in ORDERS:
        h = np.full(len(code), np.uint32(n * 0x27D4EB2F))
        for j in range(n):
            h = (h ^ padded[j : j + len(code)]) * _FACTORS[j]
            h ^= h >> np.uint32(15)
        bucket = (h % np.uint32(BUCKETS)).astype(np.int64)
        for j in range(1, n):
            bucket[stops - j] = BUCKETS
        yield bucket, begins


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of one text."""
    every = np.concatenate([b[b < BUCKETS] for b, _ in _ngrams([text])])
    buckets, n = np.unique(every, return_counts=True)
    return buckets.astype(np.int32), (n / len(every)).astype(np.float32)


def _with_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS + 1, languages); the last row is 0
    bias: np.ndarray
    temperature: float

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        out = []
        for chunk in _chunks(texts):
            total, places = np.zeros((len(chunk), len(self.languages))), np.zeros(len(chunk))
            for bucket, begins in _ngrams(chunk):
                sums = np.add.reduceat(self.weights[bucket], begins, axis=0)
                total += sums
                places += np.add.reduceat((bucket < BUCKETS).astype(np.int64), begins)
            out.append(total / places[:, None] + self.bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return [self.languages[k] for k in best], p[np.arange(len(best)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for chunk in _chunks(list(batch["text"])):
            seen = np.zeros((len(chunk), BUCKETS + 1), np.uint8)
            for bucket, begins in _ngrams(chunk):
                doc = np.repeat(np.arange(len(chunk)), np.diff([*begins, len(bucket)]))
                seen.reshape(-1)[doc * (BUCKETS + 1) + bucket] = 1
            total += seen[:, :BUCKETS].sum(axis=0, dtype=np.int64)
    some = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": some, "df": total[some]})


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [_counts(t) for t in batch["text"]]
        yield pd.DataFrame({"lang": batch["lang"], "turn": batch["turn"], "buckets": [f[0] for f in found], "shares": [f[1] for f in found]})


def _learn(
    rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0,
    l1: float = 0.002, l2: float = 0.01, rounds: int = 4,
) -> np.ndarray:
    """FTRL-proximal weights (BUCKETS + 1 rows, the last the bias) from (buckets, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(rounds):
        for at, value, k in rows:
            w = weights(at)
            p = softmax((value @ w)[None, :])[0]
            p[k] -= 1
            g = value[:, None] * p
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    return weights(np.arange(BUCKETS + 1))


def _temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(classes)), classes], 1e-300)).sum()
    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the documents that aren't held out and have text and a language."""
    usable = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0)
    texts = usable.select("text").mapInPandas(frugal(_document_frequencies), "bucket int, df long")
    df = np.zeros(BUCKETS)
    for r in texts.groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1
    each = max(1, sample_rows // len(languages))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    # about twice as many of each language by their digests, then the first ``each`` of them
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2.0 * (each + 20) / n))) for k, n in sizes.items()])
    some = usable.select("lang", "text", draw.alias("draw")).filter(F.col("draw") <= share)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("draw", F.xxhash64("text")))
    some = some.withColumn("turn", nth).filter(F.col("turn") <= each).select("lang", "turn", "text")
    found = some.mapInPandas(frugal(_features), "lang string, turn int, buckets array<int>, shares array<float>").collect()
    found.sort(key=lambda r: (r["turn"], r["lang"]))
    rows = []
    for r in found:
        at = np.array([*r["buckets"], BUCKETS])
        value = np.append(np.array(r["shares"]) * idf[at[:-1]] * 100, 1.0)
        rows.append((at, value, languages.index(r["lang"])))
    fit = [x for x, r in zip(rows, found, strict=True) if r["turn"] % 4] or rows
    kept = [x for x, r in zip(rows, found, strict=True) if r["turn"] % 4 == 0] or rows
    w = _learn(fit, len(languages))
    logits = np.array([value @ w[at] for at, value, _ in kept])
    t = _temperature(logits, np.array([k for *_, k in kept]))
    weights = np.vstack((w[:BUCKETS] * idf[:, None] * 100, np.zeros((1, len(languages)))))
    return Model(languages, weights.astype(np.float32), w[BUCKETS], t)


def _predictor(model: Model, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            asked = [k for k, t in enumerate(texts) if model.languages and _with_letter(t)]
            found, scores = model.predict([texts[k] for k in asked]) if asked else ([], [])
            for k, x, s in zip(asked, found, scores, strict=True):
                lang[k], score[k] = x, float(s)
            yield pd.DataFrame({"lang_pred": lang, "score": score, **{c: batch[c] for c in columns}})

    return run


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    model = model or train(docs)
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInPandas(frugal(_predictor(model, ["id", "held_out"])), "id string, held_out boolean, lang_pred string, score double")
    return out.select(F.col("id").cast("long").alias("doc_id"), "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more."""
    model = model or train(docs)

    @F.pandas_udf("boolean")
    def recognised(text: pd.Series) -> pd.Series:
        ok = [_with_letter(t) and bool(model.languages) for t in text]
        _, scores = model.predict([t for t, k in zip(text, ok, strict=True) if k]) if any(ok) else ([], [])
        left = iter(scores)
        return pd.Series([bool(k and next(left) >= least) for k in ok], dtype=bool)

    return docs.filter(recognised("text"))
