"""Word segmentation of text that isn't spaced: a word graph, its best path, and a hidden Markov model.

A lexicon is the words of a corpus with their counts. A run of characters is cut along the path
through the graph of its lexicon words that has the highest product of word probabilities; a
character is always a way on. Stretches of two or more single characters on that path are words
the lexicon doesn't know: they are cut by Viterbi decoding over the states begin, middle, end
and single, whose probabilities come from the same words.

Both models are counted in Spark. What is sent to tasks is bounded: MOST_WORDS words, and one
number for each state and character. Texts are cut where they lie, without a shuffle.

Defined cases: null and empty texts have no terms; characters that no run pattern takes are
left out; ties go to the longer first word, in Viterbi decoding to the state named first;
without any words each character stands alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import shared

MOST_WORDS = 500_000
#: Runs that are cut, and runs that are one term as they are.
CJK, SPACED = r"[一-鿿]+", r"[a-z0-9]+"
BEGIN, MIDDLE, END, SINGLE = range(4)
#: States that may precede each state.
_BEFORE = {BEGIN: (END, SINGLE), MIDDLE: (BEGIN, MIDDLE), END: (BEGIN, MIDDLE), SINGLE: (END, SINGLE)}
_CACHED = 100_000
#: Longer runs are cut alone; characters of texts that are cut at a time.
LONG, TOGETHER = 1000, 100_000


def word_counts(words: DataFrame) -> DataFrame:
    """(word, n) of arrays of words in ``words``."""
    return words.select(F.explode("words").alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & (size - 1)


class _Ways:
    """Where a node and a character lead: an open hash table of node << 21 | character."""

    def __init__(self, keys: np.ndarray, nodes: np.ndarray):
        self.size = 1 << max(4, (2 * len(keys)).bit_length())
        self.keys, self.nodes = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32)
        slot = _slot(keys, self.size)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of those that meet in a slot the last stays
            stays = self.keys[slot] == keys
            self.nodes[slot[stays]] = nodes[stays]
            keys, nodes, slot = keys[~stays], nodes[~stays], (slot[~stays] + 1) & (self.size - 1)

    def __call__(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 for none."""
        key = node << 21 | char
        out, at, slot = np.full(len(key), -1, np.int64), np.arange(len(key)), _slot(key, self.size)
        while len(at):
            held = self.keys[slot]
            hit = held == key[at]
            out[at[hit]] = self.nodes[slot[hit]]
            on = ~hit & (held >= 0)
            at, slot = at[on], (slot[on] + 1) & (self.size - 1)
        return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Lexicon:
    """Log probabilities of words, and their tree of beginnings as arrays; these alone go to tasks."""

    def __init__(self, counts: dict[str, int]):
        self.total = max(sum(counts.values()), 1)
        self.words = {w: math.log(n / self.total) for w, n in counts.items()}
        self.unknown = -math.log(self.total)  # of a character that is no word, as if it had occurred once
        words = [w for w in self.words if w]
        size, points = np.array([len(w) for w in words], np.int64), _points("".join(words))
        first, node, p = np.cumsum(size) - size, np.zeros(len(words), np.int64), np.array([self.words[w] for w in words], float)
        alive, count, depth = np.arange(len(words)), 1, 0
        keys, ends = [], [np.full(1, -np.inf)]
        while len(alive):
            found, of = np.unique(node[alive] << 21 | points[first[alive] + depth], return_inverse=True)
            node[alive] = count + of
            end, done = np.full(len(found), -np.inf), size[alive] == depth + 1
            end[of[done]] = p[alive[done]]
            keys.append(found)
            ends.append(end)
            alive, count, depth = alive[~done], count + len(found), depth + 1
        self.ways = _Ways(np.concatenate(keys or [np.zeros(0, np.int64)]), np.arange(1, count))
        self.ends = np.concatenate(ends)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "words"}

    def _matches(self, points: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, size, log probability) of all words in runs; ``last`` is where the run of a place ends."""
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        places, sizes, values = [], [], []
        depth = 0
        while len(at):
            node = self.ways(node, points[at + depth])
            depth += 1
            p = np.where(node >= 0, self.ends[node], -np.inf)
            some = p > -np.inf
            if depth == 1:  # a character is always a way on
                p, some = np.where(some, p, self.unknown), np.ones(len(at), bool)
            places.append(at[some])
            sizes.append(np.full(some.sum(), depth))
            values.append(p[some])
            on = (node >= 0) & (at + depth < last[at])
            at, node = at[on], node[on]
        return np.concatenate(places), np.concatenate(sizes), np.concatenate(values)

    def paths(self, runs: Sequence[str]) -> list[list[str]]:
        """The words of the best path of each run.

        Runs of up to LONG characters go together, from their last characters to their first ones;
        longer ones go one by one, as they would leave nothing to go with.
        """
        out: list[list[str]] = [[] for _ in runs]
        for group in ([k for k, r in enumerate(runs) if 0 < len(r) <= LONG], *([k] for k, r in enumerate(runs) if len(r) > LONG)):
            if not group:
                continue
            sizes = np.array([len(runs[k]) for k in group])
            ends = np.cumsum(sizes)
            last = np.repeat(ends, sizes)
            place, size, p = self._matches(_points("".join(runs[k] for k in group)), last)
            stop = (self._together if len(group) > 1 else self._alone)(place, size, p, last)
            for k, n, end in zip(group, sizes.tolist(), ends.tolist(), strict=True):
                run, i, begin = runs[k], 0, end - n
                while i < n:
                    to = stop[begin + i] - begin
                    out[k].append(run[i:to])
                    i = to
        return out

    @staticmethod
    def _together(place: np.ndarray, size: np.ndarray, p: np.ndarray, last: np.ndarray) -> list[int]:
        # places by what is left of their run; sizes come in ascending order, so a stable sort keeps it
        near = np.argsort((last - np.arange(len(last))).astype(np.int16), kind="stable")
        rank = np.empty(len(last), np.int64)
        rank[near] = np.arange(len(last))
        order = np.argsort(rank[place], kind="stable")
        place, size, p = place[order], size[order], p[order]
        left = last[place] - place
        best, stop = np.zeros(len(last) + 1), np.zeros(len(last), np.int64)
        head = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        steps = np.searchsorted(left, np.arange(1, left[-1] + 2)).tolist()
        heads = np.searchsorted(head, steps).tolist()
        whole = place + size
        for a, b, c, d in zip(steps, steps[1:], heads, heads[1:]):
            at = head[c:d]
            # a run's last place is followed by the next run's first
            value = p[a:b] + np.where(whole[a:b] == last[place[a:b]], 0.0, best[whole[a:b]])
            top = np.maximum.reduceat(value, at - a)
            same = value == np.repeat(top, np.diff(np.append(at, b)))
            best[place[at]] = top
            stop[place[at]] = np.maximum.reduceat(np.where(same, whole[a:b], 0), at - a)
        return stop.tolist()

    @staticmethod
    def _alone(place: np.ndarray, size: np.ndarray, p: np.ndarray, last: np.ndarray) -> list[int]:
        order = np.lexsort((size, -place))
        best, stop, top = [0.0] * (len(last) + 1), [0] * len(last), -math.inf
        for i, n, v in zip(place[order].tolist(), size[order].tolist(), p[order].tolist(), strict=True):
            value = v + best[i + n]
            if n == 1 or value >= top:
                top, best[i], stop[i] = value, value, i + n
        return stop

    def path(self, run: str) -> list[str]:
        return self.paths([run])[0]


class Hidden:
    """Log probabilities of states at the start, of their successions, and of characters in them."""

    def __init__(self, start: Sequence[float], follow: Sequence[Sequence[float]], chars: dict[tuple[int, str], int]):
        log = lambda p: math.log(p) if p > 0 else -math.inf
        self.start, self.follow = [log(p) for p in start], [[log(p) for p in row] for row in follow]
        total = [0] * 4
        for (s, _), n in chars.items():
            total[s] += n
        self.chars = {key: math.log(n / total[key[0]]) for key, n in chars.items()}
        self.rare = [math.log(0.5 / max(t, 1)) for t in total]  # a character that a state never had

    def states(self, run: str) -> list[int]:
        """The likeliest states; a run begins with begin or single and ends with end or single."""
        score = [self.start[s] + self.chars.get((s, run[0]), self.rare[s]) for s in range(4)]
        score[MIDDLE] = score[END] = -math.inf
        back = []
        for c in run[1:]:
            from_ = [max(_BEFORE[s], key=lambda b: score[b] + self.follow[b][s]) for s in range(4)]
            score = [score[b] + self.follow[b][s] + self.chars.get((s, c), self.rare[s]) for s, b in enumerate(from_)]
            back.append(from_)
        at = max((END, SINGLE), key=lambda s: score[s])
        out = [at]
        for from_ in reversed(back):
            at = from_[at]
            out.append(at)
        return out[::-1]

    def cut(self, run: str) -> list[str]:
        words, begin = [], 0
        for k, s in enumerate(self.states(run), 1):
            if s in (END, SINGLE):
                words.append(run[begin:k])
                begin = k
        return words


class Segmenter:
    """Cuts runs; keeps the last ones, since lines repeat."""

    def __init__(self, lexicon: Lexicon, hidden: Hidden, cut: str, keep: str):
        self.lexicon, self.hidden = lexicon, hidden
        self.cut, self.runs = re.compile(cut), re.compile(f"(?:{cut})|(?:{keep})")
        self.cache: dict[str, list[str]] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def words(self, run: str) -> list[str]:
        """The best path, with stretches of single characters cut by the hidden model."""
        return self._known(self.lexicon.path(run))

    def _known(self, path: list[str]) -> list[str]:
        out, single = [], ""
        for word in [*path, ""]:
            if len(word) == 1:
                single += word
                continue
            out += self.hidden.cut(single) if len(single) > 1 else [single] if single else []
            single = ""
            if word:
                out.append(word)
        return out

    def terms(self, text: str | None) -> list[str]:
        return next(self.all_terms([text]))

    def all_terms(self, texts: Sequence[str | None]) -> Iterator[list[str]]:
        """The terms of each text; runs of about TOGETHER characters are cut at a time."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self.runs.findall((text or "").lower()))
            size += len(text or "")
            if size >= TOGETHER:
                yield from self._cut_all(held)
                held, size = [], 0
        yield from self._cut_all(held)

    def _cut_all(self, held: list[list[str]]) -> Iterator[list[str]]:
        if len(self.cache) >= _CACHED:
            self.cache = {}
        new = [r for r in dict.fromkeys(r for runs in held for r in runs) if r not in self.cache]
        for run in new:
            if not self.cut.fullmatch(run):
                self.cache[run] = [run]
        new = [r for r in new if r not in self.cache]
        for run, path in zip(new, self.lexicon.paths(new), strict=True):
            self.cache[run] = self._known(path)
        for runs in held:
            yield [w for r in runs for w in self.cache[r]]


def hidden_model(words: DataFrame, counts: DataFrame) -> Hidden:
    """Probabilities counted over the texts in ``words`` (words array<string>) and their word counts."""
    place = F.posexplode(F.split("word", ""))
    one = counts.select("n", F.length("word").alias("size"), place.alias("at", "char"))
    state = F.when(F.col("size") == 1, SINGLE).when(F.col("at") == 0, BEGIN).when(F.col("at") == F.col("size") - 1, END).otherwise(MIDDLE)
    chars = one.filter("char <> ''").groupBy(state.alias("state"), "char").agg(F.sum("n").alias("n"))
    found = {(r["state"], r["char"]): r["n"] for r in chars.collect()}  # a row a state and character
    single = lambda w: F.length(w) == 1
    rest = F.greatest(F.size("words") - 1, F.lit(0))
    both = F.zip_with(F.slice("words", F.lit(1), rest), F.slice("words", F.lit(2), rest), lambda a, b: F.struct(single(a).alias("a"), single(b).alias("b")))
    first = F.try_element_at("words", F.lit(1))  # a pair without a left side
    begins = F.when(first != "", F.array(F.struct(F.lit(None).cast("boolean").alias("a"), single(first).alias("b"))))
    pairs = words.select(F.explode(F.concat(F.coalesce(begins, F.slice(both, 1, 0)), both)).alias("p")).groupBy("p.a", "p.b").count()
    start, follow = [0.0] * 4, [[0.0] * 4 for _ in range(4)]
    for r in pairs.collect():  # six rows
        row = start if r["a"] is None else follow[SINGLE if r["a"] else END]
        row[SINGLE if r["b"] else BEGIN] += r["count"]
    long = counts.filter(F.length("word") > 1)
    inner = long.agg(F.sum(F.when(F.length("word") == 2, F.col("n"))), F.sum(F.when(F.length("word") > 2, F.col("n"))), F.sum(F.when(F.length("word") > 2, F.col("n") * (F.length("word") - 3)))).first()
    two, more, within = (float(x or 0) for x in inner)
    follow[BEGIN][END], follow[BEGIN][MIDDLE], follow[MIDDLE][END], follow[MIDDLE][MIDDLE] = two, more, more, within
    share = lambda row: [x / sum(row) if sum(row) else 0.0 for x in row]
    # one more of each allowed succession, so that every run has some path
    for s, before in _BEFORE.items():
        for b in before:
            follow[b][s] += 1
    start[BEGIN], start[SINGLE] = start[BEGIN] + 1, start[SINGLE] + 1
    return Hidden(share(start), [share(r) for r in follow], found)


def segmenter(words: DataFrame, least: int = 1, cut: str = CJK, keep: str = SPACED) -> Segmenter:
    """Learns from the arrays of words in ``words``; the lexicon holds the MOST_WORDS commonest that occur ``least`` times."""
    spark = words.sparkSession
    kept = shared.fresh_dir(spark, "word-counts")  # counted once for both models
    word_counts(words).write.parquet(kept)
    counts = spark.read.schema("word string, n long").parquet(kept)
    known = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(MOST_WORDS)
    return Segmenter(Lexicon({r["word"]: r["n"] for r in known.collect()}), hidden_model(words, counts), cut, keep)


def terms(model: Segmenter, texts: DataFrame, text: str = "text") -> Column:
    """The terms of a text column of ``texts``, in order."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<string>")
    def cut(column: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.all_terms(column)), dtype=object)

    return cut(text)


def telling(found: Column, stop_words: Sequence[str] = (), least: int = 2) -> Column:
    """Terms of ``least`` characters or more that aren't stop words."""
    return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(list(stop_words)) if stop_words else F.length(t) >= least)
