"""Hierarchical packing of token sequences into windows of several context sizes.

Each task tokenises its documents and packs them as they come, so no text is shuffled. A document longer than the largest
window fills whole windows and its rest is routed by its length like any other document: to the tier of the smallest window
that holds it. A tier packs its windows by best fit over its waiting pieces; a gap that no waiting piece of the tier fits is
filled from shorter tiers, longest first, cutting the last piece. So every window but those of a task's end is full, and full
windows of a power of two need no padding. What is left at the end of a task fills ever smaller windows, and at most one
window below ``smallest`` per task is padded. Windows are dealt in order to step groups of an equal number of tokens.

Tokens come from the vocabulary file's own model, asked once per distinct word: the vocabulary's pre-tokeniser never joins
characters across white space, so ids of a text are the ids of its words in order.

Defined cases: a null or empty text is the end token alone; equal rows are packed separately; an empty table gives no piece.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import lean

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class _Words(dict):
    """Computes the value of a missing key once."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.make(key)
        return value


class WordTokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes; equal to ``Tokenizer.encode`` without special tokens."""

    #: Words remembered before the memory is cleared.
    KEEP = 500_000

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        # Byte-level models write a byte that is no printable Latin-1 character as a character from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(odd)}
        self.parts: dict[str, bytes] = {}
        self.words = _Words(self.word)

    def part(self, part: str) -> bytes:
        ids = self.model.tokenize(part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters))
        return np.array([x.id for x in ids], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a text without spaces and line ends."""
        if any(s in word for s in self.special):
            return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if not word.isascii():
            word = normalize("NFC", word)
        out = []
        for part in self.pattern.findall(word.lower() if word.isascii() else "".join(map(str.lower, word))):
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= self.KEEP:
                    self.parts.clear()
                ids = self.parts[part] = self.part(part)
            out.append(ids)
        return b"".join(out)

    def text(self, text: str) -> bytes:
        if len(self.words) >= self.KEEP:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


class Packer:
    """Packs pieces ``(doc_id, start, ids, doc_tokens)`` into windows; yields rows of placed pieces."""

    #: Tokens that wait before windows are cut from them.
    WAIT = 1 << 19

    def __init__(self, windows: tuple[int, ...], smallest: int, step_tokens: int, first_id: int) -> None:
        self.windows = tuple(sorted(windows))
        self.smallest, self.step_tokens, self.next, self.first, self.used = smallest, step_tokens, first_id, first_id, 0
        self.tiers: list[list] = [[] for _ in self.windows]
        self.totals = [0] * len(self.windows)
        self.serial = 0
        self.rows: list[tuple] = []

    @property
    def waiting(self) -> int:
        return sum(self.totals)

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        top, at = self.windows[-1], 0
        while total - at >= top:
            self.close(top, [(doc_id, at, ids[4 * at : 4 * (at + top)], total)])
            at += top
        if at < total:
            self.route((doc_id, at, ids[4 * at :], total))
        if self.waiting >= self.WAIT:
            self.drain(False)

    def route(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        tier = next(i for i, w in enumerate(self.windows) if n <= w)
        self.serial += 1
        insort(self.tiers[tier], (n, self.serial, piece))
        self.totals[tier] += n

    def take(self, tier: int, place: int) -> tuple:
        n, _, piece = self.tiers[tier].pop(place)
        self.totals[tier] -= n
        return piece

    def fit(self, tier: int, room: int) -> tuple | None:
        """The longest waiting piece of a tier that fits."""
        found = bisect_right(self.tiers[tier], (room, float("inf")))
        return self.take(tier, found - 1) if found else None

    def drain(self, everything: bool) -> None:
        """Windows of every tier that can fill one, from the longest; at the end also what is left."""
        for tier in range(len(self.windows) - 1, -1, -1):
            while self.totals[tier] >= self.windows[tier]:
                self.fill(tier, self.windows[tier])
        while everything and self.waiting:
            window = self.windows[-1]
            while window > self.waiting and window > self.smallest:
                window //= 2
            self.fill(len(self.windows) - 1, window if window <= self.waiting else self.windows[-1])

    def fill(self, tier: int, window: int) -> None:
        """One window from a tier, its gaps from shorter tiers; the last piece is cut to fit."""
        placed, room = [], window
        while room and self.waiting:
            piece = next((p for t in range(tier, -1, -1) if (p := self.fit(t, room))), None)
            if piece is None:  # every waiting piece of these tiers is longer than the gap: cut the shortest
                low = next((t for t in range(tier + 1) if self.tiers[t]), None)
                if low is None:
                    break
                doc_id, at, ids, total = self.take(low, 0)
                self.route((doc_id, at + room, ids[4 * room :], total))
                piece = (doc_id, at, ids[: 4 * room], total)
            placed.append(piece)
            room -= len(piece[2]) // 4
        self.close(window, placed)

    def close(self, window: int, placed: list[tuple]) -> None:
        offset = 0
        group = self.first + self.used // self.step_tokens
        for doc_id, at, ids, total in placed:
            n = len(ids) // 4
            self.rows.append((doc_id, at, n, zlib.crc32(ids), total, self.next, offset, window, group))
            offset += n
        self.next += 1
        self.used += window


def pack(
    docs: DataFrame, vocabulary: str, end: int = 2, windows: tuple[int, ...] = (512, 1024, 2048, 4096), smallest: int = 32,
    step_tokens: int = 1 << 20,
) -> DataFrame:
    """Placed pieces of all documents; ``vocabulary`` is the tokeniser file's path on every executor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary)
        packer = Packer(windows, smallest, step_tokens, TaskContext.get().partitionId() << 33)
        tail = np.array([end], "<u4").tobytes()

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [()] * 9
            packer.rows = []
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            names = [x.split()[0] for x in PIECE.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, tokens.text(text.as_py() or "") + tail)
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.drain(True)
        yield out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(work), PIECE)
