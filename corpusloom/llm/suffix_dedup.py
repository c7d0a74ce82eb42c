"""Repeated passages by sparse suffix arrays.

Texts are sequences of words. A suffix is retained where a KGRAM of words has the least hash
of some window of MIN_WORDS - KGRAM + 1 grams. Every stretch of MIN_WORDS words belongs to one
retained suffix, the first with the least hash in it, and equal stretches belong to suffixes
that begin alike, at the same distance from their start. So a suffix stands for the stretches
that begin ``low`` to ``high`` words before it. Suffixes whose beginning is met once only, or
that stand for no stretch, are left out.

The others are sorted by their beginning and the REACH words after it, then by the REACH words
before it; the sort is range-partitioned over all of these, so a common beginning spreads
over tasks. A task works through slices of SLICE suffixes. Neighbours in the order are compared
for the words that they share to the right, neighbours in the order of the words before for
those to the left. A stretch that begins l words before its suffix is repeated where the
suffixes with REACH - l words to the right in common and those with l words to the left in
common meet. Suffixes with all words around in common are neighbours and compared as one.

Only a beginning at the edge of a slice can go on in another one. Its stretches, one row for
all that are equal within the slice, are keyed by a digest and compared across slices.

Texts that are equal word for word are one class, searched once; every copy after the first
is a repeat as a whole. Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Words are
compared by 32-bit digests, MIN_WORDS of them for a match.

Defined cases: null text has no words; texts shorter than MIN_WORDS have no repeats; the
original is the copy with the least doc_id (null last), then the least place; rows with
equal doc_id and text count once; a passage may repeat within one document; an empty table has
no repeats; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm import keyfilter, shingles
from corpusloom.llm.scratch import Scratch
from corpusloom.llm.trim import frugal

MIN_WORDS = 50
KGRAM = 16
REACH = MIN_WORDS - KGRAM
#: Suffixes that a task compares at a time, at about 600 bytes each.
SLICE = 50_000
_P = 0xD6E8FEB86659FD93
_powers = _inverses = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        back = pow(_P, -1, 1 << 64)
        _powers = np.cumprod(np.full(n, _P, np.uint64)) * np.uint64(back)
        _inverses = np.cumprod(np.full(n, back, np.uint64)) * np.uint64(_P)


def _slide(x: np.ndarray, n: int, pick, fill) -> np.ndarray:
    """pick over x[i : i + n] for every i; what lies past the end counts as ``fill``."""
    out, have = x, 1
    while have < n:
        by = min(have, n - have)
        out = pick(out, np.concatenate((out[by:], np.full(by, fill, x.dtype))))
        have += by
    return out


def _grams(words: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the KGRAM at each word, the least of the MIN_WORDS from it on, places of retained suffixes)."""
    n = len(words)
    if n < MIN_WORDS:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers[:n], out=sums[1:])
    left = np.repeat(np.cumsum(per), per) - np.arange(n)  # words to the end of the text
    gram = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.flatnonzero(left >= KGRAM)
    gram[at] = shingles.mix64((sums[at + KGRAM] - sums[at]) * _inverses[at]) >> np.uint64(1)
    windows = REACH + 1
    least = _slide(gram, windows, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    least[left < MIN_WORDS] = 0
    # a place is retained if some window that holds it has its hash as the least
    above = _slide(np.concatenate((np.zeros(windows - 1, np.uint64), least)), windows, np.maximum, np.uint64(0))[:n]
    return gram, least, np.flatnonzero((above == gram) & (left >= KGRAM))


def _stands_for(gram: np.ndarray, least: np.ndarray, places: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): how far before each place the stretches that belong to it begin; low > high where none does."""
    low, high = np.full(len(places), REACH + 1), np.full(len(places), -1)
    order = np.lexsort((places, gram[places]))
    before = np.full(len(places), REACH + 1)  # words back to the same gram
    same = gram[places[order[1:]]] == gram[places[order[:-1]]]
    before[order[1:][same]] = places[order[1:][same]] - places[order[:-1][same]]
    for by in range(REACH + 1):
        start = places - by
        ok = (by < before) & (start >= begins) & (start + MIN_WORDS <= stops) & (least[np.maximum(start, 0)] == gram[places])
        low[ok & (high < 0)] = by
        high[ok] = by
    return low, high


def _class(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def _walk(batch: pd.DataFrame, seen: dict[int, tuple]):
    """For chunks of a batch: (begin, end, classes, new rows, words, words per row, whether the id is null, ids).

    A row is new if no earlier one of the task has its class, or those have larger ids.
    """
    texts = [t.encode() for t in batch["text"]]
    late = batch["id"].isna().to_numpy()
    ids = batch["id"].fillna(0).to_numpy(np.int64)
    for begin, end in shingles.chunks(texts):
        words, per = shingles.words(texts[begin:end])
        stops = np.cumsum(per)
        classes = np.array([_class(words[a:b]) for a, b in zip(stops - per, stops, strict=True)], np.int64)
        new = np.zeros(end - begin, bool)
        for k, (c, n) in enumerate(zip(classes.tolist(), per.tolist(), strict=True)):
            order = (bool(late[begin + k]), int(ids[begin + k]))
            if n >= MIN_WORDS and (c not in seen or order < seen[c]):
                if len(seen) < 1 << 20 or c in seen:
                    seen[c] = order
                new[k] = True
        yield begin, end, classes, new, words, per, late[begin:end], ids[begin:end]


def _survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a document, with the beginnings of its retained suffixes where it is new to the task."""
    seen: dict[int, tuple] = {}
    for batch in batches:
        for begin, end, classes, new, words, per, *_ in _walk(batch, seen):
            gram, _, places = _grams(words, per)
            of = np.searchsorted(np.cumsum(per), places, side="right")
            cuts = np.searchsorted(of, np.arange(end - begin + 1))
            grams = [gram[places[a:b]].view(np.int64) if k else None for a, b, k in zip(cuts[:-1], cuts[1:], new, strict=True)]
            yield pd.DataFrame({"id": batch["id"].iloc[begin:end], "key": batch["key"].iloc[begin:end], "cls": classes, "n": per, "grams": grams})


_SUFFIX = "gram long, cls long, place int, low int, high int, late boolean, doc long, right binary, left binary"


def _suffixes(repeated: keyfilter.Filter):
    """Suffixes that begin like another, with the words after and before them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple] = {}
        for batch in batches:
            for _begin, _end, classes, new, words, per, late, ids in _walk(batch, seen):
                gram, least, places = _grams(words, per)
                stops = np.cumsum(per)
                of = np.searchsorted(stops, places, side="right")
                begins = stops - per
                low, high = _stands_for(gram, least, places, begins[of], stops[of])
                keep = new[of] & (low <= high)
                keep[keep] = repeated.passes(gram[places[keep]])
                if not keep.any():
                    continue
                places, of = places[keep], of[keep]
                around = _around(words, places, begins[of], stops[of])
                yield pd.DataFrame({
                    "gram": gram[places].view(np.int64), "cls": classes[of], "place": (places - begins[of]).astype(np.int32),
                    "low": low[keep].astype(np.int32), "high": high[keep].astype(np.int32), "late": late[of], "doc": ids[of],
                    "right": [a.tobytes() for a in around[:, REACH:]], "left": [a.tobytes() for a in around[:, :REACH]],
                })

    return run


def _around(words: np.ndarray, places: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """REACH words before each place, nearest first, and REACH after its KGRAM; 0 outside the text."""
    short = (words >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    step = np.arange(REACH)
    before, after = places[:, None] - 1 - step, places[:, None] + KGRAM + step
    left = np.where(before >= begins[:, None], short[np.maximum(before, 0)], np.uint32(0))
    right = np.where(after < stops[:, None], short[np.minimum(after, len(short) - 1)], np.uint32(0))
    return np.concatenate((left, right), axis=1)


def _digests(gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(suffixes, l): digests of each suffix with l words to the left and REACH - l to the right, l = 0 .. REACH."""
    powers = np.cumprod(np.full(REACH, _P, np.uint64))
    none = np.zeros((len(gram), 1), np.uint64)
    lefts = np.concatenate((none, np.cumsum(left.astype(np.uint64) * powers, axis=1)), axis=1)
    rights = np.concatenate((none, np.cumsum(right.astype(np.uint64) * powers, axis=1)), axis=1)[:, ::-1]
    return shingles.mix64(lefts + shingles.mix64(rights + shingles.mix64(gram + np.uint64(1))[:, None]) + np.arange(REACH + 1, dtype=np.uint64))


def _shared(rows: np.ndarray) -> np.ndarray:
    """Words that each row has in common with the one before it, from its first word on; -1 for the first."""
    out = np.full(len(rows), -1)
    if len(rows) > 1:
        like = rows[1:] == rows[:-1]
        out[1:] = np.where(like.all(axis=1), REACH, np.argmin(like, axis=1))
    return out


def _slices(batches: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[pd.DataFrame, bool, bool]]:
    """Slices of sorted suffixes, and whether their first and last beginning may go on outside.

    A slice ends between two beginnings if ``most`` suffixes hold such a place, else between two suffixes.
    """
    held: pd.DataFrame | None = None
    first = True
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pd.concat((held, batch), ignore_index=True)
        while len(held) > most:
            gram = held["gram"].to_numpy()
            cut = int(np.searchsorted(gram, gram[most - 1], side="left"))
            inside = cut == 0
            if inside:  # one place of a class, met by several tasks, stays together
                cls, place, cut = held["cls"].to_numpy(), held["place"].to_numpy(), most
                while cut < len(held) and gram[cut] == gram[cut - 1] and cls[cut] == cls[cut - 1] and place[cut] == place[cut - 1]:
                    cut += 1
                if cut == len(held):
                    break
                inside = gram[cut] == gram[cut - 1]
            yield held.iloc[:cut], first, inside
            held, first = held.iloc[cut:].reset_index(drop=True), inside
    if held is not None and len(held):
        yield held, first, True


_MATCH = "cls long, low int, high int, later boolean, digest long, late boolean, doc long, many boolean"


def _matches(most: int):
    """Starts ``low`` to ``high`` of repeated stretches; with a digest, one start that other slices may share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, opens, goes_on in _slices(batches, most):
            yield from _matched(rows, opens, goes_on)

    return run


def _matched(rows: pd.DataFrame, opens: bool, goes_on: bool) -> Iterator[pd.DataFrame]:
    # of a place that several tasks met, the row with the least document; they are neighbours
    rows = rows.sort_values(["late", "doc"], kind="stable").drop_duplicates(["gram", "cls", "place"]).sort_index()
    words = lambda c: np.frombuffer(b"".join(rows[c]), np.uint32).reshape(len(rows), REACH)
    right, left, gram = words("right"), words("left"), rows["gram"].to_numpy()
    cls, place, low, high, late, doc = (rows[c].to_numpy() for c in ("cls", "place", "low", "high", "late", "doc"))
    to_right = _shared(right)
    to_right[1:][gram[1:] != gram[:-1]] = -1
    starts = np.flatnonzero((to_right < REACH) | (_shared(left) < REACH))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    rank = np.empty(len(rows), np.int64)
    rank[np.lexsort((cls, place, doc, late))] = np.arange(len(rows))
    least = np.minimum.reduceat(rank, starts)
    heads = np.flatnonzero(rank == least[of])
    rest = np.flatnonzero(rank != least[of])
    if len(rest):  # all words around are those of an earlier suffix
        yield _ranges(cls[rest], place[rest] - high[rest], place[rest] - low[rest], np.ones(len(rest), bool))
    several = np.bincount(of) > 1
    gram, left, right = gram[heads], left[heads], right[heads]
    cls, place, low, high, late, doc = (c[heads] for c in (cls, place, low, high, late, doc))
    n = len(heads)
    to_right = _shared(right)
    to_right[1:][gram[1:] != gram[:-1]] = -1
    # in the order of the words before; which suffixes are compared depends on the order to the right as well
    backward = np.argsort(np.ascontiguousarray(left.byteswap()).view(f"S{4 * REACH}").ravel(), kind="stable")
    to_left = _shared(left[backward])
    state = np.zeros((n, REACH + 1), np.int8)  # 0: met once, 1: the first of its copies, 2: a later one
    first = np.zeros((n, REACH + 1), bool)
    for by in range(REACH + 1):
        some = np.flatnonzero((low <= by) & (by <= high))
        if not len(some):
            continue
        block = np.cumsum(to_right < REACH - by)
        group = np.empty(n, np.int64)
        group[backward] = np.cumsum(to_left < by)
        key = block[some] * np.int64(n + 1) + group[some]
        order = np.lexsort((least[some], key))
        new = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
        size = np.diff(np.append(np.flatnonzero(new), len(some)))
        met = np.repeat(size > 1, size) | several[some[order]]
        first[some[order], by] = new
        state[some[order], by] = np.where(new, np.where(met, 1, 0), 2)
    edge = np.zeros(n, bool)
    if opens:
        edge |= gram == gram[0]
    if goes_on:
        edge |= gram == gram[-1]
    row, by = np.nonzero(first & edge[:, None])
    if len(row):
        digest = _digests(gram[edge].view(np.uint64), left[edge], right[edge])[(np.cumsum(edge) - 1)[row], by].view(np.int64)
        begin = (place[row] - by).astype(np.int32)
        yield pd.DataFrame({
            "cls": cls[row], "low": begin, "high": begin, "later": False, "digest": digest,
            "late": late[row], "doc": doc[row], "many": state[row, by] > 0,
        })
        state[row, by] = 0
    flat = np.pad(state, ((0, 0), (1, 1)))
    turns = np.diff(flat, axis=1) != 0
    row, begin = np.nonzero(turns & (flat[:, 1:] > 0))
    _, end = np.nonzero(turns & (flat[:, :-1] > 0))
    if len(row):
        yield _ranges(cls[row], place[row] - (end - 1), place[row] - begin, state[row, begin] == 2)


def _ranges(cls: np.ndarray, low: np.ndarray, high: np.ndarray, later: np.ndarray) -> pd.DataFrame:
    none = pd.array([None] * len(cls), "Int64")
    return pd.DataFrame({"cls": cls, "low": low.astype(np.int32), "high": high.astype(np.int32), "later": later, "digest": none, "late": False, "doc": none, "many": False})


def _spans(matches: DataFrame) -> DataFrame:
    """(cls, start, stop, n_later): stretches of each class merged where they touch."""
    in_cls = W.partitionBy("cls").orderBy("low", "high")
    before = in_cls.rowsBetween(W.unboundedPreceding, -1)
    far = F.max("high").over(before) + MIN_WORDS
    far_later = F.max(F.when(F.col("later"), F.col("high"))).over(before) + MIN_WORDS
    run = F.sum("new").over(in_cls.rowsBetween(W.unboundedPreceding, 0))
    end = F.col("high") + MIN_WORDS
    # words that this later stretch covers and the ones before it don't
    more = F.when(F.col("later"), F.greatest(F.lit(0), end - F.greatest("low", F.coalesce("far_later", "low")))).otherwise(0)
    rows = matches.withColumns({"far": far, "far_later": far_later})
    rows = rows.withColumns({"new": F.when(F.col("far") >= F.col("low"), 0).otherwise(1), "more": more}).withColumn("run", run)
    return rows.groupBy("cls", "run").agg(
        F.min("low").alias("start"), (F.max("high") + MIN_WORDS).alias("stop"), F.sum("more").alias("n_later")
    ).drop("run")


def repeated_passages(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, start, stop, n_later): maximal stretches of words that other places repeat.

    ``n_later`` of its words belong to copies of earlier passages; 0 marks an original.
    Documents without repeats have no row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffixes")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    survey = scratch.table(texts.mapInPandas(frugal(_survey), "id long, key long, cls long, n long, grams array<long>"))
    grams = survey.filter("grams is not null").select(F.explode("grams").alias("key"))
    counted = scratch.table(grams.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    repeated = keyfilter.build(counted)
    suffixes = scratch.table(texts.select("id", "text").mapInPandas(frugal(_suffixes(repeated)), _SUFFIX))
    scratch.drop(counted)
    # the bounds of ranges go to the driver, so they hold no more than 8 words; a beginning is whole but for the edges
    around = [F.substring("right", 1, 32), F.xxhash64("right", "left")]
    ranges = suffixes.repartitionByRange("gram", *around, "cls", "place")
    ordered = ranges.sortWithinPartitions("gram", "right", "left", "cls", "place")
    matches = scratch.table(ordered.mapInPandas(frugal(_matches(SLICE)), _MATCH))
    scratch.drop(suffixes)
    # stretches of beginnings that slices share: one row a slice, so a key has no more rows than there are slices
    open_ = matches.filter("digest is not null").withColumn("at", F.struct("late", "doc", F.col("low").alias("start"), "cls"))
    met = open_.groupBy("digest").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max("many").alias("any"))
    met = met.filter("n > 1 or any").select(F.col("digest").alias("of"), "first")
    across = open_.join(met, F.col("digest") == F.col("of")).select("cls", "low", "high", F.expr("at <> first").alias("later"))
    spans = _spans(matches.filter("digest is null").select("cls", "low", "high", "later").unionByName(across))
    rows = survey.filter(F.col("n") >= MIN_WORDS).select(F.col("id").alias("doc_id"), "key", "cls", "n").distinct()
    rows = rows.withColumn("order", F.struct(F.col("doc_id").isNull().alias("late"), F.coalesce("doc_id", F.lit(0)).alias("d"), "key"))
    heads = scratch.table(rows.groupBy(F.col("cls").alias("of")).agg(F.min("order").alias("head"), F.count("*").alias("copies")))
    # equal texts: the first by doc_id has its class's spans, the others repeat as a whole
    rows = rows.join(heads, F.col("cls") == F.col("of")).withColumn("whole", F.col("copies") > 1)
    copies = rows.filter("whole").select(
        "doc_id", F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"), F.when(F.col("order") != F.col("head"), F.col("n")).alias("late"), "cls", F.col("order") == F.col("head")
    ).toDF("doc_id", "start", "stop", "late", "cls", "is_head")
    inside = spans.withColumnRenamed("cls", "c")
    late = inside.groupBy("c").agg(F.sum("n_later").alias("later_inside"))
    copies = copies.join(late, (F.col("cls") == F.col("c")) & F.col("is_head"), "left").select(
        "doc_id", "start", "stop", F.coalesce("late", "later_inside", F.lit(0)).cast("long").alias("n_later")
    )
    single = rows.filter("not whole").select("doc_id", "cls").join(inside, F.col("cls") == F.col("c"))
    single = single.select("doc_id", "start", "stop", F.col("n_later").cast("long"))
    return copies.unionByName(single)
