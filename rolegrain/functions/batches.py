"""Python steps over Arrow columns that hold a bounded part of a batch at a time."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a column that are Python objects at a time, about.
SLICE = 1 << 20


def slices(column: pa.Array, size: int = SLICE) -> Iterator[pa.Array]:
    """Consecutive slices of at most ``size`` bytes, or single values beyond it."""
    if len(column) < 2 or column.nbytes <= size:
        yield column
        return
    half = len(column) // 2
    yield from slices(column[:half], size)
    yield from slices(column[half:], size)


def give_back() -> None:
    """Gives freed memory back to the machine: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_slices(work: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``work`` as the body of an iterator UDF: every slice is returned as a batch of its own, whatever the batches that come."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for column in columns:
                for part in slices(column):
                    yield work(part)
        finally:
            give_back()

    return run
