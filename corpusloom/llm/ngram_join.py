"""Exact n-gram Jaccard join by T-occurrence search in divided inverted lists.

A document's set is its distinct 5-word shingles as 64-bit hashes; documents with equal sets
are one class, named by a 64-bit digest of the set. Two sets of sizes x and y link if their
overlap reaches the occurrence threshold T = ceil(p (x + y) / (100 + p)), p the percentage.

Division. Shingles have one global order: those that occur often anywhere come last, most
frequent at the very end. The first n - ceil(p n / 100) + 1 of a set are listed; if two sets
link, these parts share at least min(T - ceil(p x / 100), T - ceil(p y / 100)) + 1 shingles. A
list in order of size falls apart where a size is too small for the next; what is left alone
links with nothing there. Of each part the class with the fewest rare shingles is the pivot, and
all of the part meet in the pivot's block with the shingles that they share with anything.

Search. In a block inverted lists are built and DivideSkip takes a class at a time, in order of
size: the L longest of its lists are put aside, the others are merged by a heap, and classes
before it that occur T - L times are looked up in the long lists by binary search until T is
reached or out of reach. Classes that reach the smaller bound above are candidates. They form
components, kept by joining classes as they are found; a class is not compared with its own
component again, so what leaves a block are fewer pairs than it has classes.

Then each component of candidates is a block with whole sets, and the same search, now for the
overlap itself, gives the links. Each block is first compared with its pivot as a whole.

Blocks of more than PIECE shingles are cut into pieces, and pairs of pieces are separate work
that holds the pivot too, so a task's memory is bounded whatever the size of a group.

Which shingles count as frequent is found from local counts; that choice and the bounds on
it only change the amount of work, since any global order gives the same links.

Defined cases: null text and text without words have an empty set and link with nothing;
rows with a null id can link others; repeated rows are in one component; of classes that tie as
pivot the least is taken; an empty table gives no rows; columns other than doc_id and text are
not read by ``link_documents`` and come back as they are from ``keep_one_of_each``.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm import keyfilter, shingles
from corpusloom.llm.components import components
from corpusloom.llm.scratch import Scratch, free_names
from corpusloom.llm.trim import frugal

PERCENT = 75
#: Shingles that a task holds of a block, at about 60 bytes each.
PIECE = 500_000
#: The share of T by which long lists are put aside falls with the logarithm of the longest list.
_SKIP = 0.0085
#: The most frequent shingles that the order puts last; the list is sent to all tasks.
FREQUENT = 1 << 16
_WINDOW = 1 << 21


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    for begin, end in shingles.chunks(texts):
        h, counts = shingles.shingles(texts[begin:end])
        stops = np.cumsum(counts)
        for a, b in zip((stops - counts).tolist(), stops.tolist(), strict=True):
            yield np.unique(h[a:b])


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _often(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingles that at least 4 classes hold among those of one window of texts."""
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def out() -> pd.DataFrame:
        s, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"shingle": s[n >= 4].view(np.int64), "n": n[n >= 4]})

    for batch in batches:
        for s in _sets([t.encode() for t in batch["text"]]):
            if len(s) and (k := _class_of(s)) not in seen:
                seen.add(k)
                held.append(s)
                size += len(s)
                if size >= _WINDOW:
                    yield out()
                    held, size, seen = [], 0, set()
    if held:
        yield out()


def _divider(often: np.ndarray, counts: np.ndarray, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            sizes, classes, rare, short = [], [], [], []
            for s in _sets([t.encode() for t in batch["text"]]):
                n = len(s)
                sizes.append(n)
                k = _class_of(s) if n else 0
                classes.append(k)
                if not n or k in seen:
                    rare.append(0)
                    short.append(None)
                    continue
                if len(seen) < 1 << 20:
                    seen.add(k)
                often_n = np.zeros(n, np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    often_n = np.where(often[at] == s, counts[at], 0)
                rare.append(int((often_n == 0).sum()))
                order = np.lexsort((s, often_n))[: n - -(-percent * n // 100) + 1]
                short.append(s[order].view(np.int64))
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "n": sizes, "cls": classes, "rare": rare, "short": short})

    return run


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of adjacent rows with equal keys, from sorted rows."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
        last = np.ones(len(rows), bool)
        for k in keys:
            last &= rows[k].to_numpy() == rows[k].iloc[-1]
        first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if first:
            yield rows.iloc[:first]
        rest = rows.iloc[first:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _compatible(x, y, percent: int):
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def _parts(percent: int):
    """Postings, sorted by shingle and n_rare (size, then rare shingles), that have one of a compatible size beside them; part names their part.

    Only one posting is kept from batch to batch, so a list may be of any length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, joined, start = None, False, 0  # the last posting, whether it met one before it, its part
        for batch in batches:
            if not len(batch):
                continue
            lead = held is not None
            rows = pd.concat((held, batch), ignore_index=True) if lead else batch
            s, c = rows["shingle"].to_numpy(), rows["cls"].to_numpy()
            new = np.ones(len(rows), bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])  # a class that two tasks met
            rows = rows[new].reset_index(drop=True)
            s, both = rows["shingle"].to_numpy(), rows["n_rare"].to_numpy()
            n = both >> 32
            meets = np.zeros(len(rows), bool)
            meets[1:] = (s[1:] == s[:-1]) & _compatible(n[1:], n[:-1], percent)
            if lead:
                meets[0] = joined
            first = np.maximum.accumulate(np.where(meets, 0, np.arange(len(rows))))
            part = n[first]
            if lead and joined:
                part[first == 0] = start
            keep = meets.copy()
            keep[:-1] |= meets[1:]
            last = keep[:-1]  # the last one waits for the next batch
            if last.any():
                yield opened(rows.iloc[:-1][last], part[:-1][last])
            held, joined, start = rows.iloc[-1:].reset_index(drop=True), bool(meets[-1]), int(part[-1])
        if held is not None and joined:
            yield opened(held, start)

    def opened(rows: pd.DataFrame, part) -> pd.DataFrame:
        both = rows["n_rare"].to_numpy()
        return pd.DataFrame({"shingle": rows["shingle"], "n": both >> 32, "cls": rows["cls"], "rare": both & 0xFFFFFFFF, "part": part})

    return run


def _visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(pivot, cls): the first of each part, by rare shingles, and all of it; from rows sorted so."""
    head = pivot = None
    for batch in batches:
        if not len(batch):
            continue
        key, cls = batch[["shingle", "part"]].to_numpy(), batch["cls"].to_numpy()
        new = np.ones(len(batch), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        new[0] = head is None or tuple(key[0]) != head
        first = np.maximum.accumulate(np.where(new, np.arange(len(batch)), -1))
        pivots = np.where(first >= 0, cls[first], 0 if pivot is None else pivot)
        head, pivot = tuple(key[-1]), pivots[-1]
        yield pd.DataFrame({"pivot": pivots, "cls": cls}).drop_duplicates()


def _overlap(x, y, percent: int):
    """The overlap that links sizes x and y."""
    return -(-percent * (x + y) // (100 + percent))


def _listed(x, y, percent: int):
    """The overlap of the listed shingles of sets that link."""
    need = _overlap(x, y, percent)
    return np.minimum(need - -(-percent * x // 100), need - -(-percent * y // 100)) + 1


class _Components:
    """Union by the smaller name, over 0 .. n - 1."""

    def __init__(self, n: int):
        self.names = np.arange(n)

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.names[a], self.names[b]))
        self.names[self.names == b] = a


def search_block(sizes: np.ndarray, sets: list[np.ndarray], pivot: int, percent: int, threshold=_overlap, pieces: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (places in ``sizes``) that connect what any pair connects whose sets share ``threshold`` members.

    sizes: those of the whole sets, in ascending order; pairs of sizes that can't link don't count.
    pieces: if given, only sets of different pieces are compared, and all with the pivot.
    """
    n, links, known = len(sizes), [], _Components(len(sizes))
    lengths = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), lengths)
    at = np.minimum(np.searchsorted(sets[pivot], every), lengths[pivot] - 1)
    with_pivot = np.bincount(owner[sets[pivot][at] == every], minlength=n)
    near = (with_pivot >= threshold(sizes, sizes[pivot], percent)) & _compatible(sizes, sizes[pivot], percent)
    near[pivot] = False
    for k in np.flatnonzero(near).tolist():
        links.append((k, pivot))
        known.join(k, pivot)
    if (known.names == known.names[0]).all():
        return links
    # inverted lists of the shingles that several sets hold; each in order of size
    order = np.lexsort((owner, every))
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    length = np.diff(np.append(starts, len(every)))
    begin = np.repeat(starts, length)
    own = np.argsort(owner, kind="stable")  # the places of each set in the lists
    cuts = np.searchsorted(owner[own], np.arange(n + 1))
    least = np.searchsorted(100 * sizes, percent * sizes)  # the smallest set that could link
    longest = int(length.max(initial=1))
    for k in range(1, n):
        if least[k] == k:
            continue
        places = own[cuts[k] : cuts[k + 1]]
        before = places - begin[places]  # how many smaller sets each list holds
        places, before = places[before > 0], before[before > 0]
        most = max(1, int(threshold(sizes[k], sizes[least[k]], percent)))
        if len(places) < most:
            continue
        by_length = np.argsort(before, kind="stable")
        aside = max(0, min(most - 1, int(most / (_SKIP * np.log2(longest + 1) + 1))))
        short, long = places[by_length[: len(places) - aside]], places[by_length[len(places) - aside :]]
        open_ = known.names != known.names[k]
        open_[: least[k]] = False
        if pieces is not None:
            open_ &= pieces != pieces[k]
        lists = []
        for p in short.tolist():
            some = owner[begin[p] : p]
            some = some[open_[some]]
            if len(some):
                lists.append(some.tolist())
        merged = np.fromiter(heapq.merge(*lists), np.int64)
        if not len(merged):
            continue
        turns = np.flatnonzero(np.concatenate(([True], merged[1:] != merged[:-1])))
        found, met = merged[turns], np.diff(np.append(turns, len(merged)))
        need = threshold(sizes[k], sizes[found], percent)
        for left, p in zip(range(len(long), 0, -1), long.tolist(), strict=True):
            some = met + left >= need
            found, met, need = found[some], met[some], need[some]
            if not len(found):
                break
            at = np.minimum(begin[p] + np.searchsorted(owner[begin[p] : p], found), p - 1)
            met = met + (owner[at] == found)
        for c in found[met >= need].tolist():
            if known.names[c] != known.names[k]:
                links.append((k, c))
                known.join(k, c)
    return links


def _searcher(percent: int, threshold):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole_groups(batches, ["pivot", "low", "high"]):
            key = rows[["pivot", "low", "high"]].to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            x, y = [], []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
                unit = rows.iloc[a:b].sort_values(["n", "cls"])
                if len(unit) != unit["rows"].iloc[0]:
                    raise RuntimeError("a block of classes came apart, so links would be lost")
                cls, sizes = unit["cls"].to_numpy(), unit["n"].to_numpy()
                sets = [np.sort(np.asarray(m).view(np.uint64)) for m in unit["members"]]
                pivot = int(np.flatnonzero(cls == key[a, 0])[0])
                pieces = unit["piece"].to_numpy() if key[a, 1] != key[a, 2] else None
                for k, c in search_block(sizes, sets, pivot, percent, threshold, pieces):
                    x.append(cls[k])
                    y.append(cls[c])
            if x:
                yield pd.DataFrame({"x": x, "y": y})

    return run


def _collector(wanted: keyfilter.Filter):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            found, classes = [], []
            for s in _sets([t.encode() for t in batch["text"]]):
                if len(s):
                    k = _class_of(s)
                    if k not in seen and wanted.passes(np.array([k], np.int64))[0]:
                        if len(seen) < 1 << 20:
                            seen.add(k)
                        found.append(s.view(np.int64))
                        classes.append(k)
            if classes:
                yield pd.DataFrame({"cls": classes, "members": found})

    return run


class _Join:
    def __init__(self, docs: DataFrame, percent: int, scratch: Scratch):
        self.percent, self.scratch, self.spark = percent, scratch, docs.sparkSession
        self.texts = docs.select(
            F.col("doc_id").cast("string").alias("id"), F.xxhash64("text").alias("key"), F.coalesce("text", F.lit("")).alias("text")
        )

    def divided(self) -> DataFrame:
        often = self.texts.select("text").mapInPandas(frugal(_often), "shingle long, n long")
        often = often.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "shingle").limit(FREQUENT).collect()
        table = np.array([(r["shingle"], r["n"]) for r in often], np.int64).reshape(-1, 2)
        names = table[:, 0].copy().view(np.uint64)
        order = np.argsort(names)
        run = _divider(names[order], table[order, 1], self.percent)
        return self.scratch.table(self.texts.mapInPandas(frugal(run), "id string, key long, n long, cls long, rare long, short array<long>"))

    def candidates(self, rows: DataFrame) -> DataFrame:
        """(x, y): pairs that connect all classes whose listed shingles allow a link."""
        postings = rows.filter("short is not null").select(F.explode("short").alias("shingle"), (F.shiftleft("n", 32) + F.col("rare")).alias("n_rare"), "cls")
        postings = postings.repartition("shingle").sortWithinPartitions("shingle", "n_rare", "cls")
        parts = postings.mapInPandas(frugal(_parts(self.percent)), "shingle long, n long, cls long, rare long, part long")
        parts = self.scratch.table(parts)
        ordered = parts.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "rare", "cls")
        visits = ordered.select("shingle", "part", "cls").mapInPandas(frugal(_visits), "pivot long, cls long").distinct()
        listed = parts.groupBy(F.col("cls").alias("of")).agg(F.first("n").alias("n"), F.collect_list("shingle").alias("members"))
        return self.search(visits, listed, _listed)

    def search(self, visits: DataFrame, sets: DataFrame, threshold) -> DataFrame:
        """(x, y) of all blocks from (pivot, cls) and the sets (of, n, members) of the classes."""
        visits = self.scratch.table(visits.join(sets.select("of", "n", F.size("members").alias("size")), F.col("cls") == F.col("of")).drop("of"))
        blocks = visits.groupBy(F.col("pivot").alias("of")).agg(F.ceil(F.sum("size") / float(PIECE)).cast("int").alias("pieces"))
        work = visits.join(blocks, F.col("pivot") == F.col("of")).drop("of")
        work = work.withColumn("piece", F.when(F.col("pivot") == F.col("cls"), -1).otherwise(F.pmod(F.xxhash64("cls"), F.col("pieces"))).cast("int"))
        # pairs of pieces; the pivot, piece -1, is in all of them
        last = F.col("pieces") - 1
        pairs = F.when(F.col("piece") >= 0, F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(F.least("piece", o).alias("low"), F.greatest("piece", o).alias("high"))))
        every = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda a: F.transform(F.sequence(a, last), lambda b: F.struct(a.alias("low"), b.alias("high")))))
        work = work.withColumn("pair", F.explode(F.coalesce(pairs, every))).select("pivot", "pair.low", "pair.high", "cls", "n", "piece")
        unit = ["pivot", "low", "high"]
        counts = work.groupBy(*[F.col(c).alias(f"of_{c}") for c in unit]).agg(F.count("*").alias("rows"))
        counts = counts.filter("rows > 1")
        whole = (F.col("pivot") == F.col("of_pivot")) & (F.col("low") == F.col("of_low")) & (F.col("high") == F.col("of_high"))
        work = work.join(counts, whole).drop("of_pivot", "of_low", "of_high")
        work = work.join(sets.select("of", "members"), F.col("cls") == F.col("of")).drop("of")
        # the pieces come first, so that the keys are not those of a join before whose skewed groups Spark may split
        work = work.repartition("low", "high", "pivot").sortWithinPartitions(*unit)
        return self.scratch.table(work.mapInPandas(frugal(_searcher(self.percent, threshold)), "x long, y long"))

    def sets(self, classes: DataFrame) -> DataFrame:
        """(cls, members) of the ``cls`` of all rows, from the texts."""
        classes = classes.select("cls").distinct()
        names = keyfilter.build(classes.withColumnRenamed("cls", "key"))
        found = self.texts.select("text").mapInPandas(frugal(_collector(names)), "cls long, members array<long>")
        return found.dropDuplicates(["cls"])

    def labels(self, links: DataFrame) -> DataFrame:
        return components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), self.scratch)

    def links(self, rows: DataFrame) -> DataFrame:
        """Links (x, y) between classes, enough of them to connect what any link connects."""
        near = self.labels(self.candidates(rows))
        known = rows.filter("short is not null").select(F.col("cls").alias("of"), "rare").distinct()
        near = self.scratch.table(near.join(known, F.col("node") == F.col("of")).select(F.col("node").alias("cls"), "label", "rare"))
        pivots = near.groupBy(F.col("label").alias("of")).agg(F.min_by("cls", F.struct("rare", "cls")).alias("pivot"))
        visits = near.join(pivots, F.col("label") == F.col("of")).select("pivot", "cls")
        sets = self.scratch.table(self.sets(near))
        return self.search(visits, sets.select(F.col("cls").alias("of"), F.size("members").cast("long").alias("n"), "members"), _overlap)


def _labelled(docs: DataFrame, percent: int, scratch: Scratch | None) -> DataFrame:
    """The columns of ``link_documents`` and label, the least class of the component; null without words."""
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    join = _Join(docs, percent, scratch)
    rows = join.divided()
    label = join.labels(join.links(rows))
    rows = rows.select(F.col("id").cast("long").alias("doc_id"), F.col("key").alias("text_key"), F.col("n").alias("n_shingles"), "cls")
    classes = rows.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    classes = classes.join(label, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cls"))
    classes = scratch.table(classes.select("cls", "label", "least"))
    whole = classes.groupBy(F.col("label").alias("of_label")).agg(F.min("least").alias("component_id"))
    named = classes.join(whole, F.col("label") == F.col("of_label")).select(F.col("cls").alias("of_cls"), "label", "component_id")
    out = rows.join(named, (F.col("cls") == F.col("of_cls")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"), "label")


def link_documents(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; text_key is xxhash64(text)."""
    return _labelled(docs, percent, scratch).drop("label")


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the first by doc_id of each component stays.

    Texts without words all stay. Of repeated rows one stays.
    """
    # components without any doc_id share the component_id null, so they are told apart by label
    linked = _labelled(docs, percent, None).filter("n_shingles > 0")
    first = linked.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("keep")).select("keep.*")
    gone = linked.select("doc_id", "text_key").distinct().join(
        first.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")),
        F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_key") == F.col("k_key")), "left_anti",
    )
    g_id, g_key, key, place = free_names(docs, 4)
    gone = gone.select(F.col("doc_id").alias(g_id), F.col("text_key").alias(g_key))
    out = docs.withColumn(key, F.xxhash64("text"))
    out = out.join(gone, F.col("doc_id").eqNullSafe(F.col(g_id)) & (F.col(key) == F.col(g_key)), "left_anti")
    alike = W.partitionBy("doc_id", key).orderBy(F.lit(1))
    out = out.withColumn(place, F.row_number().over(alike))
    return out.filter((F.col(place) == 1) | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
