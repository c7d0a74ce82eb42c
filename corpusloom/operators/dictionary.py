"""Many words in many texts: one pass, whatever the size of the dictionary.

A dictionary is a table (kind, keyword, canonical). Tasks hold it as sorted hashes of words of
each length, and compare the hashes of all windows of a batch of texts with them, then the
characters themselves. A plan doesn't grow with the words, and all kinds share a pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that negate the word behind them, characters that end a word, and the ranges of
# ideographs, which need no edge between words.
NEGATORS = "不没无未别莫毋非"
EDGES = "，。！？、；：""''（）【】《》\n\r\t ,.!?;:'\"()[]{}/"
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF))

PART_CHARS = 1 << 23  # characters of keywords that a task holds at a time; larger dictionaries take a pass for each part
SLICE = 1 << 18  # characters hashed at a time
RUN_CHARS = 1 << 20  # characters of whole texts that a task takes apart at a time, or one longer text
HIT_TYPE = "kind string, keyword string, canonical string, start long, stop long"
_BITS = 20


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class Words:
    """A part of a dictionary, ready for a task: entries (kind, keyword, canonical, left, right).

    left and right are the characters that make a longer keyword of the same kind when put in
    front of the keyword or behind it.
    """

    def __init__(self, entries: Sequence[tuple[str, str, str, str, str]]):
        entries = sorted(entries, key=lambda e: (e[1], e[0]))
        self.kinds, self.canonical = [e[0] for e in entries], [e[2] for e in entries]
        self.words = sorted({e[1] for e in entries})
        place = {w: n for n, w in enumerate(self.words)}
        of = np.array([place[e[1]] for e in entries], dtype=np.int64)
        self.first = np.searchsorted(of, np.arange(len(self.words) + 1))
        self.entry_word = of
        pairs = [np.array(sorted(n << 21 | ord(c) for n, e in enumerate(entries) for c in e[side]), dtype=np.int64) for side in (3, 4)]
        self.left, self.right = pairs
        self.flat = _points("".join(self.words))
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.lengths = sorted(set(self.size.tolist()))
        self.starts = np.zeros(0x110000, dtype=bool)
        if self.words:
            self.starts[self.flat[self.at[:-1]]] = True
        self.base = 0x9E3779B97F4A7C15
        while not self._tables():
            self.base += 2

    def _tables(self) -> bool:
        """Sorted hashes for each length; False if two words of a length share one."""
        powers = _powers(self.base, max(self.lengths, default=0))
        self.by_length, self.seen = {}, {}
        for size in self.lengths:
            which = np.flatnonzero(self.size == size)
            letters = self.flat[self.at[which][:, None] + np.arange(size)].astype(np.uint64) + np.uint64(1)
            hashes = (letters * powers[:size]).sum(axis=1, dtype=np.uint64)
            order = np.argsort(hashes, kind="stable")
            hashes, which = hashes[order], which[order]
            if (hashes[1:] == hashes[:-1]).any():
                return False
            self.by_length[size] = hashes, which
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.seen[size] = seen
        return True

    def hits(self, points: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, stop, word) by start, then the longest first, of each slice of texts put end to end.

        ends[i] is where the text of character i ends; hits don't cross texts.
        """
        if not self.words:
            return
        most = self.lengths[-1]
        powers = _powers(self.base, SLICE + most + 1)
        back = _powers(pow(self.base, -1, 1 << 64), SLICE + 1)
        for a in range(0, len(points), SLICE):
            b = min(a + SLICE, len(points))
            part = points[a : min(b + most, len(points))]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: len(part)], dtype=np.uint64, out=sums[1:])
            begin = np.flatnonzero(self.starts[part[: b - a]])
            room = ends[a + begin] - (a + begin)
            found = []
            for size in self.lengths:
                s = begin[room >= size]
                h = (sums[s + size] - sums[s]) * back[s]
                maybe = np.flatnonzero(self.seen[size][(h >> np.uint64(64 - _BITS)).astype(np.int64)])
                s, h = s[maybe], h[maybe]
                hashes, which = self.by_length[size]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                same = hashes[at] == h
                s, w = s[same], which[at[same]]
                if len(s):
                    span = np.arange(size)
                    exact = (part[s[:, None] + span] == self.flat[self.at[w][:, None] + span]).all(axis=1)
                    found.append((s[exact] + a, w[exact]))
            if found:
                start, word = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                order = np.lexsort((-self.size[word], start))
                start, word = start[order], word[order]
                yield start, start + self.size[word], word

    def entries_of(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the hit, entry) for every kind that a hit's word has."""
        many = self.first[word + 1] - self.first[word]
        row = np.repeat(np.arange(len(word)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return row, self.first[word[row]] + nth


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base & (1 << 64) - 1, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _lookup(chars: str) -> np.ndarray:
    out = np.zeros(0x110001, dtype=bool)
    out[_points(chars)] = True
    return out


class Neighbours:
    """Keeps hits whose neighbours let the word stand on its own.

    A hit goes if a negator stands before it; if a neighbour, not an edge, is no ideograph or makes
    a longer keyword of the same kind with it. The ends of a text are edges.
    """

    def __init__(self, negators: str = NEGATORS, edges: str = EDGES):
        self.negators, self.edges = negators, edges

    def start(self, words: Words) -> None:
        none = 0x110000
        self.words, self.negates, self.ends_word = words, _lookup(self.negators), _lookup(self.edges)
        self.ends_word[none] = True
        self.joins = np.zeros(none + 1, dtype=bool)
        for low, high in IDEOGRAPHS:
            self.joins[low : high + 1] = True

    def keep(self, points, begins, ends, start, stop, row, entry) -> np.ndarray:
        none, s, e = 0x110000, start[row], stop[row]
        before = np.where(s > begins[s], points[np.maximum(s - 1, 0)], none).astype(np.int64)
        after = np.where(e < ends[s], points[np.minimum(e, len(points) - 1)], none).astype(np.int64)
        good = ~self.negates[before]
        for char, longer in ((before, self.words.left), (after, self.words.right)):
            good &= self.ends_word[char] | self.joins[char] & ~np.isin(entry << 21 | char, longer)
        return good


class Longest:
    """Keeps hits that aren't part of a longer hit or a longer Latin word, nor behind a negating text.

    Which hits a longer one covers is told after the others were dropped, over all kinds.
    """

    def __init__(self, negators: Sequence[str] = ()):
        self.negators = [_points(n) for n in negators if n]

    def start(self, words: Words) -> None:
        self.plain = np.zeros(0x110001, dtype=bool)
        self.plain[_points("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
        self.reach = -1

    def keep(self, points, begins, ends, start, stop, row, entry) -> np.ndarray:
        none, last = 0x110000, len(points) - 1
        before = np.where(start > begins[start], points[np.maximum(start - 1, 0)], none)
        after = np.where(stop < ends[start], points[np.minimum(stop, last)], none)
        good = ~(self.plain[before] & self.plain[points[start]]) & ~(self.plain[after] & self.plain[points[stop - 1]])
        for n in self.negators:
            room = start - begins[start] >= len(n)
            at = np.maximum(start - len(n), 0)[:, None] + np.arange(len(n))
            good &= ~(room & (points[np.minimum(at, last)] == n).all(axis=1))
        reach = np.maximum.accumulate(np.concatenate([[self.reach], np.where(good, stop, -1)]))
        good &= stop > reach[:-1]
        self.reach = int(reach[-1])
        return good[row]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, stop) of stretches of texts with RUN_CHARS characters at most, or of one longer text."""
    ends, at = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + RUN_CHARS, side="right")))
        yield at, stop
        at = stop


def _batch_hits(words: Words, rule, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    texts = texts.to_pylist()
    sizes = np.array([len(t or "") for t in texts], dtype=np.int64)
    stops = np.cumsum(sizes)
    points = _points("".join(t or "" for t in texts))
    begins, ends = np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
    kinds, names, canonical = pa.array(words.kinds, pa.string()), pa.array(words.words, pa.string()), pa.array(words.canonical, pa.string())
    for start, stop, word in words.hits(points, ends):
        row, entry = words.entries_of(word)
        if rule is not None:
            good = rule.keep(points, begins, ends, start, stop, row, entry)
            row, entry = row[good], entry[good]
        s, e = start[row], stop[row]
        of = np.searchsorted(stops, s, side="right")
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(of)), kinds.take(pa.array(entry)), names.take(pa.array(words.entry_word[entry])), canonical.take(pa.array(entry)),
             pa.array(s - begins[s]), pa.array(e - begins[s])],
            ["id", "kind", "keyword", "canonical", "start", "stop"],
        )


def scan_words(texts: DataFrame, words: Words, rule=None) -> DataFrame:
    """Hits of a dictionary that a task can hold."""
    held = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch's size is Spark's; its characters taken apart fill many times their room
            for a, b in _runs(batch.column(1)):
                if rule is not None:
                    rule.start(held.value)
                yield from _batch_hits(held.value, rule, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a))

    known = texts.select("id", "text")
    return known.mapInArrow(run, f"id {known.schema['id'].dataType.simpleString()}, {HIT_TYPE}")


def entries(words: DataFrame) -> DataFrame:
    """(kind, keyword, canonical, left, right) of a dictionary table, a row for each kind and keyword.

    Null or empty keywords are left out, the least canonical name of a keyword counts, without one
    the keyword itself.
    """
    one = words.filter("keyword <> ''").groupBy("kind", "keyword").agg(F.min(F.coalesce("canonical", "keyword")).alias("canonical"))
    size = F.length("keyword")
    grown = one.filter(size > 1)
    left = grown.groupBy("kind", F.expr("substring(keyword, 2)").alias("keyword")).agg(F.array_join(F.collect_set(F.expr("left(keyword, 1)")), "").alias("left"))
    right = grown.groupBy("kind", F.expr("left(keyword, length(keyword) - 1)").alias("keyword")).agg(F.array_join(F.collect_set(F.expr("right(keyword, 1)")), "").alias("right"))
    same = lambda o: F.col("o.kind").eqNullSafe(F.col(f"{o}.kind")) & (F.col("o.keyword") == F.col(f"{o}.keyword"))
    joined = one.alias("o").join(left.alias("l"), same("l"), "left").join(right.alias("r"), same("r"), "left")
    return joined.select("o.kind", "o.keyword", "o.canonical", F.coalesce("l.left", F.lit("")).alias("left"), F.coalesce("r.right", F.lit("")).alias("right"))


def from_rules(rules: DataFrame) -> DataFrame:
    """The dictionary of rules (kind, name, synonyms): a name and its synonyms all mean the name."""
    every = F.array_union(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    return rules.select("kind", F.explode(every).alias("keyword"), F.col("name").alias("canonical"))


def find(texts: DataFrame, words: DataFrame, boundaries: bool = True, negators: str = NEGATORS, edges: str = EDGES) -> DataFrame:
    """All hits of a dictionary: (id, kind, keyword, canonical, start, stop), positions in characters from 0.

    texts: (id, text), words: (kind, keyword, canonical). A null or empty text has no hits; repeated
    ids and rows have theirs each. With boundaries hits follow ``Neighbours``, whose longer keywords
    are those of the whole table. The table's size is checked: beyond ``PART_CHARS`` it is dealt to
    parts by a hash of the keyword, each of which takes a pass over the texts.
    """
    table = entries(words)
    chars = table.agg(F.sum(F.length("keyword") + F.length("left") + F.length("right"))).first()[0] or 0
    parts = -(-chars // PART_CHARS) or 1
    rule = Neighbours(negators, edges) if boundaries else None
    out = None
    for n in range(parts):
        mine = table.filter(F.pmod(F.xxhash64("keyword"), F.lit(parts)) == n) if parts > 1 else table
        part = scan_words(texts, Words([tuple(r) for r in mine.collect()]), rule)  # bounded by PART_CHARS
        out = part if out is None else out.unionByName(part)
    return out


def in_order(hits: DataFrame, name: str = "canonical") -> DataFrame:
    """(id, kind, names): distinct canonical names, or keywords, of a text in order of their first hit.

    A hit is before another if it ends first, of two ends if it is longer.
    """
    first = hits.groupBy("id", "kind", name).agg(F.min(F.struct("stop", "start")).alias("at"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda x: x[name])
    return first.groupBy("id", "kind").agg(names.alias("names"))


def route(texts: DataFrame, words: DataFrame, order: Sequence[str], short: Column, default: str = "general") -> DataFrame:
    """(id, route): the first kind of the order with a hit anywhere; else the default where ``short`` holds, else null.

    texts: (id, text, ...); ids tell rows apart.
    """
    hits = find(texts, words, boundaries=False).filter(F.col("kind").isin(list(order)))
    nth = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    best = hits.groupBy("id").agg(F.min_by("kind", nth).alias("kind"))
    return texts.join(best, "id", "left").select("id", F.coalesce("kind", F.when(short, F.lit(default))).alias("route"))


def unsupported(answers: DataFrame, sources: DataFrame, words: DataFrame) -> DataFrame:
    """(id, keyword): words of the dictionary that an answer has and none of its sources.

    answers: (id, text), sources: (id, doc_id) with docs' texts in a column text. Answers without
    sources aren't judged. A source is scanned once, however many answers have it.
    """
    said = find(answers, words, boundaries=False).select("id", "keyword").distinct()
    texts = sources.select(F.col("doc_id").alias("id"), "text").dropDuplicates(["id"])
    known = find(texts, words, boundaries=False).select(F.col("id").alias("doc_id"), "keyword").distinct()
    links = sources.select("id", "doc_id").distinct()
    backed = links.join(known, "doc_id").select("id", "keyword").distinct()
    return said.join(links.select("id").distinct(), "id", "left_semi").join(backed, ["id", "keyword"], "left_anti")
