"""Python workers live on from task to task; what one task freed shouldn't count against the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd

Run = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def release() -> None:
    """Gives freed memory of Arrow and of the C library back, where the latter can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        return


def frugal(run: Run) -> Run:
    """``run`` of mapInPandas that releases memory at the end of a task."""

    def trimmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            release()

    return trimmed
