"""Document fingerprints: one-permutation MinHash, optimally densified, packed to low bits.

A document's 5-word shingles are hashed once; the hash names a bin and a value, and a bin
keeps its least value. An empty bin takes the value of the first filled bin in a sequence of
its own that 2-universal hashing draws, alike in all documents, so two documents that agree
on what is filled borrow alike. BITS low bits of each value are stored. Two fingerprints
agree in a bin by chance with probability 2**-BITS; ``likeness`` takes that out.

Defined cases: null text is empty; a text without words has an empty fingerprint, like
itself (1) and unlike any other (0); a text of 1 to 4 words is one shingle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import shingles

BINS = 512
BITS = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _probe(bins: np.ndarray, attempt: np.ndarray) -> np.ndarray:
    """The bin that an empty bin asks at an attempt."""
    x = bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (shingles.mix64(x) % np.uint64(BINS)).astype(np.int64)


_FIRST = _probe(np.arange(BINS)[:, None], np.arange(64)[None, :])


def _densify(low: np.ndarray) -> np.ndarray:
    filled = low != _NONE
    n = filled.sum(axis=1)
    out = low.copy()
    single = n == 1  # any sequence ends at the one filled bin
    out[single] = low[single].min(axis=1)[:, None]
    row, col = np.nonzero(~filled & (n > 1)[:, None])
    attempt = 0
    while len(row):
        steps = np.arange(attempt, attempt + 8)
        ask = _FIRST[col][:, steps] if steps[-1] < 64 else _probe(col[:, None], steps[None, :])
        hit = filled[row[:, None], ask]
        got = hit.any(axis=1)
        first = hit.argmax(axis=1)
        out[row[got], col[got]] = low[row[got], ask[got, first[got]]]
        row, col = row[~got], col[~got]
        attempt += 8
    return out


def fingerprints(texts: Sequence[bytes]) -> np.ndarray:
    """A row of packed bytes for each text; all zero for a text without words."""
    out = np.zeros((len(texts), BINS * BITS // 8), np.uint8)
    for begin, end in shingles.chunks(texts):
        h, counts = shingles.shingles(texts[begin:end])
        low = np.full((end - begin) * BINS, _NONE, np.uint64)
        at = np.repeat(np.arange(end - begin), counts) * BINS + (h % np.uint64(BINS)).astype(np.int64)
        np.minimum.at(low, at, h // np.uint64(BINS))
        low = _densify(low.reshape(-1, BINS))
        low[counts == 0] = 0
        # the bin is mixed in too, so that a value that many bins share agrees by chance in each alone
        kept = (shingles.mix64(low + np.arange(BINS, dtype=np.uint64) * shingles.STEP) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
        kept[counts == 0] = 0
        bits = np.unpackbits(kept[:, :, None], axis=2)[:, :, 8 - BITS :]
        out[begin:end] = np.packbits(bits.reshape(end - begin, -1), axis=1)
    return out


def has_words(texts: Sequence[bytes]) -> np.ndarray:
    return np.array([bool(t.translate(None, b" \t\n\v\f\r")) for t in texts], bool)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the shingle sets behind rows of packed fingerprints."""
    differ = np.unpackbits(a ^ b, axis=1).reshape(len(a), -1, BITS).any(axis=2)
    agree = 1 - differ.mean(axis=1)
    chance = 2.0**-BITS
    return np.clip((agree - chance) / (1 - chance), 0, 1)


def _compare(a: np.ndarray, a_has: np.ndarray, b: np.ndarray, b_has: np.ndarray) -> np.ndarray:
    return np.where(a_has & b_has, likeness(a, b), (a_has == b_has).astype(float))


def _hex(rows: np.ndarray, has: np.ndarray) -> list[str]:
    return [r.tobytes().hex() if h else "" for r, h in zip(rows, has, strict=True)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row's text; the fingerprint is packed bytes in hex."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode() for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fingerprint": _hex(fingerprints(texts), has_words(texts))})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, fingerprint string").withColumn("doc_id", F.col("doc_id").cast("long"))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many first code points of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_ROW = (
    "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _rows(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    raw = [t.encode() for t in texts]
    changed = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
    after = [t.encode() for t in following]
    # the next row's text is mostly in this batch already
    known: dict[bytes, int] = {}
    distinct = [known.setdefault(t, len(known)) for t in [*raw, *after]]
    every = fingerprints(list(known))
    some = has_words(list(known))
    own, nxt = np.array(distinct[: len(raw)], np.int64), np.array(distinct[len(raw) :], np.int64)
    edit, edit_has = fingerprints(changed), has_words(changed)
    return pd.DataFrame({
        "doc_id": ids,
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
        "fingerprint": _hex(every[own], some[own]),
        "edited_fingerprint": _hex(edit, edit_has),
        "near_edited": _compare(every[own], some[own], edit, edit_has),
        "near_next": _compare(every[own], some[own], every[nxt], some[nxt]),
    })


_GROUP_CHARS = 1 << 20


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of sorted ranges compared with the next; a range ends with the first row of the one after it."""
    ids: list = []
    texts: list[str] = []
    size, now, ended = 0, None, False
    for batch in batches:
        for b, follows, doc, text in zip(batch["range"], batch["follows"], batch["doc_id"], batch["text"], strict=True):
            if b != now:
                ids, texts, size, now, ended = [], [], 0, b, False
            if follows:
                if not ended:
                    yield _rows(ids, texts, [*texts[1:], text])
                ended = True
                continue
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= _GROUP_CHARS and len(ids) > 1 or len(ids) > 2048:
                yield _rows(ids[:-1], texts[:-1], texts[1:])
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def _range_of(at: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts lie above; found in every step-th of them, then between two of those."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    whole, coarse = F.lit(cuts), F.lit(cuts[::step])
    block = F.size(F.filter(coarse, lambda c: c <= at)) - 1
    below = block * step + F.size(F.filter(F.slice(whole, block * step + 1, F.lit(step)), lambda c: c <= at))
    return F.lit(len(cuts)) - F.when(block < 0, 0).otherwise(below)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document with its edited text and the next document in descending doc_id.

    doc_id is cut into ranges at quantiles, and texts move once, to their range (null last,
    ties by a digest of the text); there each row's next is the row below. The first row of a
    range also goes to the range before it, and the very first one to the last.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("at"),
        F.xxhash64(text).alias("tie"), text.alias("text"),
    )
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("at", [(k + 1) / n for k in range(n - 1)], 20 * n)).first()[0] or []
    rows = rows.withColumn("range", _range_of(F.col("at"), sorted(set(cuts))))
    # a row for each range that has any
    firsts = rows.groupBy("range").agg(F.max(F.struct("at", "tie")).alias("first")).orderBy("range").collect()
    before = [(r["range"], firsts[k - 1]["range"], r["first"]["at"], r["first"]["tie"]) for k, r in enumerate(firsts)]
    heads = spark.createDataFrame(before, "of int, before int, first_at long, first_tie long")
    rows = rows.join(F.broadcast(heads), F.col("range") == F.col("of"))
    here, there = F.struct(F.col("range"), F.lit(False).alias("follows")), F.struct(F.col("before").alias("range"), F.lit(True).alias("follows"))
    is_first = (F.col("at") == F.col("first_at")) & (F.col("tie") == F.col("first_tie"))
    placed = rows.select("doc_id", "at", "tie", "text", F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("to"))
    placed = placed.select("to.*", "doc_id", "at", "tie", "text").repartition("range")
    placed = placed.sortWithinPartitions("range", "follows", F.col("at").desc(), F.col("tie").desc())
    return placed.select("range", "follows", "doc_id", "text").mapInPandas(_in_order, _ROW).withColumn("doc_id", F.col("doc_id").cast("long"))
