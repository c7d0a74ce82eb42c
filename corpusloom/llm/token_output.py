"""Documents as token ids in Simple-8b shards, in ascending doc_id order.

Rows are range-partitioned by doc_id before they are tokenised, so each text moves once and
a partition writes its shards in order. A shard is one row of a Parquet table (partition,
number in it, image), since Spark's writers reach every store that executors share. A shard
closes at SHARD_IDS ids, which bounds what a task holds.

Defined cases: null text is empty; a document is at least its end id; null doc_ids come
first; rows with equal doc_ids follow by a digest of the text; no rows give no shards. A text
of any length is encoded in one piece, and its own words don't depend on what the cache holds.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.llm import simple8b
from corpusloom.llm.scratch import Scratch

SHARD_IDS = 1 << 20
SHARD_DOCS = 1 << 16
CACHED_WORDS = 1 << 20


#: A comma or full stop at a word's end that isn't a token of its own.
_AFTER_MARK = re.compile(r"[^0-9a-z\u00df-\u00f6\u00f8-\u00ff ][.,] ")


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Ids of a lower-casing tokenizer that drops white space, by a cache of its words.

    Such a tokenizer encodes what stands between white space on its own, so each distinct
    word is encoded by the library and texts are put together from the cache. A comma or
    full stop after a Latin letter or digit is a token of its own, so the cache holds words
    without it. New words of Latin letters go to the library as one text; each of them ends
    with a token that marks a word's end, which takes the result apart again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for token, k in vocab.items():
            self.ends[k] = token.endswith("</w>")
        self.cache: dict[str, bytes] = {"": b""}
        self.marks = {m: self._ids([m])[0] for m in ",."}

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _learned(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words, which the cache gets as well; a full cache is emptied first."""
        found: dict[str, bytes] = {}
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            plain = [w for w in part if w.isalpha() and max(w) < "\u0130"]
            if len(plain) > 1:
                ids = np.array(self.library.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(stops) == len(plain):
                    raw = ids.tobytes()
                    found.update(zip(plain, (raw[4 * a : 4 * b] for a, b in zip([0, *stops], stops)), strict=True))
                    part = [w for w in part if w not in found]
            found.update(zip(part, self._ids(part), strict=True))
        if len(self.cache) + len(found) > CACHED_WORDS:
            self.cache = {"": b""}
        if len(found) < CACHED_WORDS:
            self.cache.update(found)
        return found

    def encode(self, text: str) -> bytes:
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if _is_latin(text) and "<|" not in text:  # such a text is lower-cased alike as a whole
            text = text.lower()
            if not _AFTER_MARK.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
        words = text.split(" ")
        found = list(map(self.cache.get, words))
        if None in found:
            missing = [k for k, f in enumerate(found) if f is None]
            bare = []
            for k in missing:
                w = words[k]
                if w[-1] in self.marks and w[-2:-1].isalnum() and w[-2] < "\u0130":
                    w = w[:-1]
                bare.append(w.lower() if w.isascii() and "<|" not in w else w)  # added tokens keep their case
            # the text's own words, whatever the cache holds by then
            own = {w: self.cache.get(w) for w in bare}
            own.update(self._learned([w for w, ids in own.items() if ids is None]))
            for k, w in zip(missing, bare, strict=True):
                found[k] = own[w] + self.marks[words[k][-1]] if len(w) < len(words[k]) else own[w]
        return b"".join(found)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps its cache from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def _shards(path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, docs, texts, size, part, shard, at = encoder(path), [], [], 0, None, 0, 0

        def image():
            ids = np.frombuffer(b"".join(texts), "<u4").astype(np.uint64)
            lengths = np.array([len(t) // 4 for t in texts], np.int64)
            return pd.DataFrame({"part": [part], "shard": [shard], "ahead": [at], "n_ids": [len(ids)], "image": [simple8b.write_shard(docs, lengths, ids)]})

        for batch in batches:
            for p, doc, known, text in zip(batch["part"], batch["doc"], batch["known"], batch["text"], strict=True):
                part = p
                docs.append(int(doc) if known else None)
                texts.append(coder.encode(text) + end)
                size += len(texts[-1]) // 4
                if size >= SHARD_IDS or len(docs) >= SHARD_DOCS:
                    yield image()
                    at, shard, size, docs, texts = at + size, shard + 1, 0, [], []
        if docs:
            yield image()

    return write


def write_tokens(docs: DataFrame, path: str, end_id: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """Shards of ``docs`` (doc_id, text): (part, shard, ahead, n_ids, image), written and reread.

    ``ahead`` is the number of ids before the shard in its part; parts are in order too.
    """
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie").asc()]
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(
        F.spark_partition_id().alias("part"),
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"),
        F.col("doc_id").isNotNull().alias("known"),
        "text",
    )
    return scratch.table(rows.mapInPandas(_shards(path, end_id), "part int, shard int, ahead long, n_ids long, image binary"))


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, ahead, image in zip(batch["part"], batch["ahead"], batch["image"], strict=True):
            docs, lengths, ids = simple8b.read_shard(image)
            stops = np.cumsum(lengths)
            yield pd.DataFrame({
                "part": part,
                "doc_id": pd.array(docs, "Int64"),
                "within": ahead + stops - lengths,
                "n_tokens": lengths,
                "ids": np.split(ids.astype(np.int64), stops[:-1]),
            })


def read_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the shards."""
    rows = shards.select("part", "ahead", "image").mapInPandas(_read, "part int, doc_id long, within long, n_tokens long, ids array<long>")
    return _started(shards, rows).select("doc_id", "start", "n_tokens", "ids")


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part, ahead, image in zip(batch["part"], batch["ahead"], batch["image"], strict=True):
            docs, lengths, ids = simple8b.read_shard(image)
            raw, stops = ids.astype("<u4").tobytes(), np.cumsum(lengths)
            yield pd.DataFrame({
                "part": part,
                "doc_id": pd.array(docs, "Int64"),
                "within": ahead + stops - lengths,
                "n_tokens": lengths,
                "ids_crc32": [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)],
            })


def digest_tokens(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards."""
    rows = shards.select("part", "ahead", "image").mapInPandas(_digest, "part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return _started(shards, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


def _started(shards: DataFrame, rows: DataFrame) -> DataFrame:
    # one row per partition: what the partitions before it hold
    parts = shards.groupBy(F.col("part").alias("of_part")).agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("of_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("of_part", F.coalesce(before, F.lit(0)).alias("base"))
    return rows.join(parts, F.col("part") == F.col("of_part")).withColumn("start", F.col("base") + F.col("within"))
