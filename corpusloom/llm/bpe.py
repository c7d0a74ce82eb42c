"""Byte-level BPE by forced-boundary splitting, and decoding.

A pair of bytes that occurs inside no token of the vocabulary can never be merged across:
wherever it stands in a text, a token ends between its bytes. Fragments between such cuts are
encoded on their own and their ids concatenated. In byte-level vocabularies hardly a token
holds a space after another character, so words begin at cuts, and encoded words can be kept
and used again; inside a word, cuts split off further fragments.

The pre-tokenizer's splits hold too. It always splits before a single space between two
characters that aren't white space, whatever stands further off, so texts are taken apart
there first. Where white space touches such a space, the text is pre-tokenized whole.

Defined cases: null text is empty and has no ids; added tokens in a text are matched first,
as the tokenizers library does; ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.trim import frugal

CACHED_WORDS = 1 << 19
#: The byte-level pre-tokenizer's pattern over the letters of ASCII bytes (\u0120 is the space's).
_WHITE = "\u0109\u010a\u010b\u010c\u010d\u0120"
_ASCII_SPLITS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|\u0120?[A-Za-z]+|\u0120?[0-9]+|\u0120?[^{_WHITE}A-Za-z0-9]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
_WHOLE = (-1,)
_MARKS = {",", "."}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in printable else spare))
        spare += b not in printable
    return letters


class ForcedBoundaryBPE:
    """Encoder and decoder of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.merges = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(spec["model"]["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.added_pattern = re.compile("|".join(longest_first)) if longest_first else None
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take neighbouring characters are not supported")
        #: pairs of neighbours inside some token; a text is cut between any other
        self.joined = {t[k : k + 2] for t in self.vocab for k in range(len(t) - 1)}
        letters = byte_letters()
        split = spec["pre_tokenizer"]
        self.splits_words = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.pretokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.ascii_letters = {b: letters[b] for b in range(128)}
        of = {c: b for b, c in enumerate(letters)}
        self.bytes_of = [b""] * (max([*self.vocab.values(), *self.added.values()]) + 1)
        for t, k in self.vocab.items():
            self.bytes_of[k] = bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        for t, k in self.added.items():
            self.bytes_of[k] = t.encode()
        self.fragments: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _merge(self, fragment: str) -> tuple[int, ...]:
        """The fragment's ids by merging the pair of lowest rank, leftmost first, till none is left."""
        parts, rank, last = list(fragment), self.merges.get, len(self.merges)
        ranks = [rank(two, last) for two in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < last:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), last)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), last)
        return tuple(map(self.vocab.__getitem__, parts))

    def _pretoken(self, letters: str) -> tuple[int, ...]:
        ids = self.fragments.get(letters)
        if ids is None:
            joined = self.joined
            cuts = [k for k in range(1, len(letters)) if letters[k - 1 : k + 1] not in joined]
            out: list[int] = []
            for begin, end in zip([0, *cuts], [*cuts, len(letters)]):
                fragment = letters[begin:end]
                out += self._merge(fragment) if len(fragment) <= 256 else self._merge_long(fragment)
            ids = tuple(out)
            if len(self.fragments) >= CACHED_WORDS:
                self.fragments.clear()
            if len(letters) <= 64:
                self.fragments[letters] = ids
        return ids

    def _merge_long(self, fragment: str) -> tuple[int, ...]:
        """The same as ``_merge`` with a heap and links, for time in proportion to n log n."""
        import heapq

        n, parts, ranks = len(fragment), list(fragment), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, x) for k, x in enumerate(zip(parts, parts[1:])) if (r := ranks.get(x)) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, (a, b) = heapq.heappop(heap)
            j = after[k]
            if parts[k] != a or j >= n or parts[j] != b:
                continue
            parts[k], parts[j] = a + b, ""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (r := ranks.get(two := (parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, two))
        return tuple(self.vocab[p] for p in parts if p)

    def _pretokenized(self, text: str) -> tuple[int, ...]:
        if self.splits_words and text.isascii():
            parts = _ASCII_SPLITS.findall(text.translate(self.ascii_letters))
        else:
            parts = [letters for letters, _ in self.pretokenizer.pre_tokenize_str(text)]
        if len(parts) == 1:
            return self._pretoken(parts[0])
        out: list[int] = []
        for letters in parts:
            out += self._pretoken(letters)
        return tuple(out)

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens."""
        if not text:
            return []
        if not self.splits_words:
            return list(self._pretokenized(text))
        first, *rest = text.split(" ")
        known, out = self.words, []
        for word in [first, *[f" {w}" for w in rest]]:
            ids = known.get(word)
            if ids is None and word[-1:] in _MARKS and word[-2:-1].isalnum() and word[-2] < "\u0250":
                ids = known.get(word[:-1])
                if ids is not None and ids is not _WHOLE:  # a mark after a Latin letter or digit is a pre-token of its own
                    ids += self._pretoken(word[-1])
            if ids is None:
                bare = word[1:] if word[:1] == " " else word
                touches = not bare or bare[0].isspace() or bare[-1].isspace()
                ids = _WHOLE if touches else self._pretokenized(word)
                if len(known) >= CACHED_WORDS:
                    known.clear()
                if len(word) <= 64:
                    if ids is not _WHOLE and word[-1:] in _MARKS and word[-2:-1].isalnum() and word[-2] < "\u0250":
                        known[word[:-1]] = ids[: -len(self._pretoken(word[-1]))]
                    else:
                        known[word] = ids
            if ids is _WHOLE:
                return list(self._pretokenized(text))
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if not any(t in text for t in self.added):  # a plain search is faster than the pattern
            return self._plain(text)
        out: list[int] = []
        begin = 0
        # the first added token from each place on, the longest of those that begin there
        for found in self.added_pattern.finditer(text):
            out += self._plain(text[begin : found.start()])
            out.append(self.added[found[0]])
            begin = found.end()
        return out + self._plain(text[begin:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _coded(path: str):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ForcedBoundaryBPE(path)
        digits = [str(k) for k in range(len(bpe.bytes_of))]
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch["text"]:
                ids = bpe.encode(text)
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": ids_hex, "decoded_sha256": text_hex})

    return code


def _ids(path: str):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ForcedBoundaryBPE(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [bpe.encode(t) for t in batch["text"]]})

    return code


def _texts(path: str):
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ForcedBoundaryBPE(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [bpe.decode(list(x)) for x in batch["ids"]]})

    return code


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every row's text."""
    out = _rows(docs).mapInPandas(frugal(_ids(path)), "doc_id string, ids array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def decode_documents(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of every row's ids."""
    rows = ids.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    out = rows.mapInPandas(frugal(_texts(path)), "doc_id string, text string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from its ids."""
    out = _rows(docs).mapInPandas(frugal(_coded(path)), "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
