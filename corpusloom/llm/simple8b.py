"""Simple-8b word-aligned coding of ids below 2**63, vectorised over blocks.

A 64-bit word holds a 4-bit selector and 60 bits of payload. Selector s packs COUNTS[s] ids
of WIDTHS[s] bits, the first id in the low bits. An id of more than 60 bits is an escape:
the word's payload is its place in a table of whole ids. Blocks of BLOCK ids are coded on
their own, and the word offset of every block is kept, so blocks are coded and decoded side
by side, and any block can be read alone. A block's last word may have unused places.

A shard is the image of one file: a header, doc ids, tokens per document, block offsets,
words, escapes (all little-endian).
"""

from __future__ import annotations

import struct

import numpy as np

# Ids per word and bits per id, by selector; selector 15 is the escape.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
ESCAPE = 15
BLOCK = 1024
#: Blocks that are coded in step; as many as stay in a core's cache.
AT_ONCE = 96
MAGIC = b"S8BT\x01\x00\x00\x00"
_HEAD = struct.Struct("<8sQQQQQ")


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    powers = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    if v.size and int(v.max()) < 1 << 52:
        return np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    return np.searchsorted(powers, v, side="right").astype(np.uint8)


def _selectors(bits: np.ndarray) -> np.ndarray:
    """The selector of a word that would start at each place: the one that packs most ids."""
    best = np.where(bits > 60, np.uint8(ESCAPE), np.uint8(14))
    widest, have = bits, 1
    for s in range(13, 0, -1):
        want = int(COUNTS[s])
        step = want - have
        while step:
            by = min(step, have)
            widest = np.maximum(widest, np.pad(widest[:, by:], ((0, 0), (0, by))))
            have += by
            step = want - have
        fits = widest <= WIDTHS[s]
        if not fits.any():
            break
        best[fits] = s
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of every block and the end, escapes) of non-negative ids."""
    words, offsets, escapes, n_words, n_escapes = [], [np.zeros(1, np.int64)], [], 0, 0
    for at in range(0, len(ids), AT_ONCE * BLOCK):
        w, o, e = _encode(ids[at : at + AT_ONCE * BLOCK], n_escapes)
        words.append(w)
        offsets.append(o[1:] + n_words)
        escapes.append(e)
        n_words, n_escapes = n_words + len(w), n_escapes + len(e)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *words]), np.concatenate(offsets), np.concatenate([none, *escapes])


def _encode(ids: np.ndarray, escaped_before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(ids)
    blocks = -(-n // BLOCK)
    v = np.zeros((blocks, BLOCK + 60), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = ids
    v[:, :BLOCK] = full.reshape(blocks, BLOCK)
    sizes = np.full(blocks, BLOCK, np.int64)
    if n % BLOCK:
        sizes[-1] = n % BLOCK
    selectors = _selectors(_bit_lengths(v.reshape(-1)).reshape(v.shape))
    at, live, taken = np.zeros(blocks, np.int64), np.arange(blocks), []
    while live.size:  # one word of every block at a time
        here = at[live]
        taken.append((live, here))
        at[live] = here + COUNTS[selectors[live, here]]
        live = live[at[live] < sizes[live]]
    row, col = (np.concatenate(x) for x in zip(*taken, strict=True))
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    chosen = selectors[row, col]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        of = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            words[of] |= np.arange(escaped_before, escaped_before + len(of), dtype=np.uint64)
            continue
        places = (row[of] * v.shape[1] + col[of])[:, None] + np.arange(COUNTS[s])
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        words[of] |= np.bitwise_or.reduce(v.reshape(-1)[places] << shifts, axis=1)
    escaped = chosen == ESCAPE
    offsets = np.zeros(blocks + 1, np.int64)
    np.cumsum(np.bincount(row, minlength=blocks), out=offsets[1:])
    return words, offsets, v[row[escaped], col[escaped]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """The n ids of the blocks from ``first`` on; all words of one selector are unpacked at once."""
    words, starts = words[offsets[first] : offsets[-1]], offsets[first:] - offsets[first]
    if not len(words):
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[chosen]
    total = np.concatenate(([0], np.cumsum(held)))[starts]
    sizes = np.full(len(starts) - 1, BLOCK, np.int64)
    sizes[-1] = n - BLOCK * (len(sizes) - 1)
    held[starts[1:] - 1] -= np.diff(total) - sizes
    to = np.cumsum(held) - held
    out = np.zeros(n, np.uint64)
    for s in np.unique(chosen):
        of = np.flatnonzero(chosen == s)
        if s == ESCAPE:
            out[to[of]] = escapes[(words[of] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for j in range(int(COUNTS[s])):
            some = of[held[of] > j]
            out[to[some] + j] = (words[some] >> np.uint64(j * int(WIDTHS[s]))) & mask
    return out


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets, escapes = encode(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(offsets), len(escapes))
    parts = (numbers, lengths.astype("<u4"), offsets.astype("<u4"), words.astype("<u8"), escapes.astype("<u8"), known)
    return head + b"".join(x.tobytes() for x in parts)


def read_shard(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, tokens per document, ids) of a shard."""
    magic, docs, n, n_words, n_offsets, n_escapes = _HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, found = _HEAD.size, []
    for kind, count in (("<i8", docs), ("<u4", docs), ("<u4", n_offsets), ("<u8", n_words), ("<u8", n_escapes), ("u1", docs)):
        found.append(np.frombuffer(image, kind, count, at))
        at += found[-1].nbytes
    numbers, lengths, offsets, words, escapes, known = found
    doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
    return doc_ids, lengths.astype(np.int64), decode(words, offsets.astype(np.int64), escapes, n)
