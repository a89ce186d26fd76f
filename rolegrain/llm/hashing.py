"""Vectorised hashes over byte arrays, and slices of Arrow batches that bound a task's memory."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
MASK64 = (1 << 64) - 1


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work``, giving the memory it has freed back to the machine at its end: Python workers outlive their tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word; works in place on unsigned values."""
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


class SpanHash:
    """Polynomial hashes mod 2**64 of spans of a text, from one running sum.

    Powers are kept and grown as needed, so one instance per task serves all its texts.
    """

    def __init__(self, seed: int = 1) -> None:
        self.table = np.random.default_rng(seed).integers(1, MASK64, 256, dtype=np.uint64, endpoint=True)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.up) >= size:
            return
        size = max(size, 1 << 16)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums of a byte array, one longer than it."""
        return self.running(self.table[data])

    def running(self, values: np.ndarray) -> np.ndarray:
        """The same for 64-bit values."""
        self._grow(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=total[1:])
        return total

    def grams(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hash of every span of ``width`` items."""
        return mix((sums[width:] - sums[:-width]) * self.down[: len(sums) - width])

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def sliding_argmin(keys: np.ndarray, window: int, rightmost: bool = False) -> np.ndarray:
    """Position of the least of every ``window`` consecutive 64-bit keys; equal keys: the leftmost, or the rightmost.

    Compares the upper 42 bits beside a position, so it takes 2**21 windows at a time.
    """
    count = len(keys) - window + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    if count > 1 << 21:
        steps = range(0, count, 1 << 21)
        return np.concatenate([sliding_argmin(keys[a : min(a + (1 << 21), count) + window - 1], window, rightmost) + a for a in steps])
    low = np.uint64((1 << 22) - 1)
    place = np.arange(len(keys), dtype=np.uint64)
    tagged = (keys & ~low) | ((low - place) if rightmost else place)
    blocks = -(-len(keys) // window)
    padded = np.full(blocks * window, np.uint64(MASK64))
    padded[: len(keys)] = tagged
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:count], ahead[window - 1 : window - 1 + count]) & low
    return ((low - least) if rightmost else least).astype(np.int64)


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of an Arrow column as views of its buffers."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        values, cuts = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return out


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes sum to at most ``limit``, or single items beyond it."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def pieces(texts: list[bytes], limit: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of (item number, piece of its text) of about ``limit`` bytes; longer texts are cut at white space."""
    owners: list[int] = []
    parts: list[bytes] = []
    total = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + limit - total)
            if end < len(text):
                cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                if cut > at:
                    end = cut
                elif owners:
                    end = at  # take it up in a fresh group
            if end > at:
                owners.append(i)
                parts.append(text[at:end])
                total += end - at
                at = end
            if total >= limit or at < len(text):
                yield owners, parts
                owners, parts, total = [], [], 0
    if owners:
        yield owners, parts
