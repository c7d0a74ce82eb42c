"""A Bloom filter of 64-bit keys, sized to their number, built in the tasks and sent to all of them.

It has BITS_A_KEY bits for each key, up to MOST_BITS in all; with more keys it lets more others
through, so whoever filters with it must stay right with any key that passes. A key belongs to
one segment of the filter; each segment is filled by one task and is met by a bounded number
of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusloom.llm.shingles import mix64

BITS_A_KEY = 12
SEGMENT = 1 << 20
MOST_BITS = 1 << 30
_HASHES = 3


def _hashes(keys: np.ndarray) -> list[np.ndarray]:
    k = np.ascontiguousarray(keys).view(np.uint64)
    return [mix64(k + np.uint64(j * 0x9E37 + 1)) for j in range(_HASHES)]


def _places(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Bits within a segment, by the low bits of each hash."""
    return [(h % np.uint64(SEGMENT)).astype(np.int64) for h in hashes]


def _segments(hashes: list[np.ndarray], count: int) -> np.ndarray:
    """By the high bits of a hash, so that keys of any pattern are dealt evenly."""
    return (hashes[0] // np.uint64(SEGMENT) % np.uint64(count)).astype(np.int64)


def _dealt(count: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"segment": _segments(_hashes(batch["key"].to_numpy(np.int64)), count), "key": batch["key"]})

    return run


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(SEGMENT, bool)
    for at in _places(_hashes(rows["key"].to_numpy(np.int64))):
        bits[at] = True
    return pd.DataFrame({"segment": rows["segment"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})


class Filter:
    """Tells whether keys may be among those it was built from; never wrong about those that are."""

    def __init__(self, segments: dict[int, bytes], count: int):
        self.segments, self.count = segments, count
        self._opened: np.ndarray | None = None

    def __getstate__(self):
        return {"segments": self.segments, "count": self.count, "_opened": None}

    def passes(self, keys: np.ndarray) -> np.ndarray:
        if self._opened is None:
            self._opened = np.zeros((self.count, SEGMENT // 8), np.uint8)
            for k, bits in self.segments.items():
                self._opened[k] = np.frombuffer(bits, np.uint8)
        keys = np.ascontiguousarray(keys).view(np.int64)
        hashes = _hashes(keys)
        found, segment = np.ones(len(keys), bool), _segments(hashes, self.count)
        for at in _places(hashes):
            found &= (self._opened[segment, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return found


def build(keys: DataFrame) -> Filter:
    """The filter of the non-null ``key`` (long) of all rows."""
    keys = keys.filter("key is not null").select("key").distinct()
    count = max(1, min(-(-keys.count() * BITS_A_KEY // SEGMENT), MOST_BITS // SEGMENT))
    filled = keys.mapInPandas(_dealt(count), "segment int, key long")
    # a segment's keys are bounded by its share, as long as MOST_BITS suffice
    rows = filled.groupBy("segment").applyInPandas(_fill, "segment int, bits binary").collect()  # MOST_BITS / 8 bytes at most
    return Filter({r["segment"]: bytes(r["bits"]) for r in rows}, count)
