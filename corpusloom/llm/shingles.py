"""Word and shingle hashes of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; white space and A-Z are single bytes
of UTF-8, so all of it works on bytes. A word's hash is a polynomial of its bytes modulo
2**64, taken as a difference of prefix sums, then mixed; a shingle's is a polynomial of its
words' hashes, mixed again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE = 5
CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 512
_BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        _powers = np.cumprod(np.full(n, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
        back = pow(_BASE, -1, 1 << 64)
        _inverses = np.cumprod(np.full(n, back, np.uint64)) * np.uint64(_BASE)


def chunks(texts: Sequence[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK_BYTES, at most CHUNK_DOCS; a longer text stands alone."""
    begin = size = 0
    for k, t in enumerate(texts):
        if k > begin and (size + len(t) > CHUNK_BYTES or k - begin >= CHUNK_DOCS):
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    joined = np.frombuffer(b" ".join((b"", *texts, b"")), np.uint8)
    joined = joined + np.where(joined - np.uint8(65) < 26, np.uint8(32), np.uint8(0))
    filled = ~((joined == 32) | (joined - np.uint8(9) < 5))
    edge = np.flatnonzero(filled[1:] != filled[:-1]) + 1
    start, stop = edge[0::2], edge[1::2]
    _grow(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers[: len(joined)], out=sums[1:])
    hashes = (sums[stop] - sums[start]) * _inverses[start]
    hashes = mix64(hashes + (stop - start).astype(np.uint64) * STEP)
    # a text's bytes begin one past the space before it
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
    return hashes, np.diff(np.searchsorted(start, begins))


def shingles(texts: Sequence[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-word shingles in order, number of shingles of each text).

    A text of 1 to k - 1 words has its whole sequence as one shingle; one without words, none.
    """
    w, per = words(texts)
    counts = np.where(per >= k, per - k + 1, np.minimum(per, 1))
    first = np.cumsum(per) - per
    of = np.repeat(np.arange(len(texts)), counts)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.minimum(per, k)[of]
    total = length.astype(np.uint64)
    padded = np.concatenate((w, np.zeros(k, np.uint64)))
    for j in range(k):
        here = padded[at + j]
        total = np.where(length > j, total * STEP + here, total)
    return mix64(total), counts
