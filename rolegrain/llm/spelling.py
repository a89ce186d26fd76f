"""Spelling variants: words of a corpus within one edit of each other, by dynamic programming over sorted lists.

Counting. A word is a maximal run of ASCII letters and U+00C0 to U+00FF with A-Z lower-cased. Every such character fits a byte of
Latin-1, so texts are split, hashed and counted as byte arrays; a task sends each of its words once per slice of text.

Searching. Two words are near if one inserted, deleted or replaced code point turns one into the other. Let ``m`` be the
shorter one's length less one: the common prefix and suffix then cover ``m`` code points, so if ``m`` is cut into ``PARTS``
parts, the pair agrees on everything outside one of them. Words that agree there form a cell. A cell is a sorted list of what
lies between the shared ends. All its words are searched in it at once: the row of the edit matrix, banded to three columns,
belongs to a range of words with a common prefix, is computed once for the range, and is handed to the ranges that the next
longest common prefix splits it into; a range whose row exceeds one edit everywhere is skipped whole. A cell beyond ``CELL``
words is dealt to blocks and every pair of blocks meets in a cell of its own, so no task holds more than two blocks.

Every ordered pair is found in one cell only (that of its common prefix), so counts need no de-duplication.

Defined cases: null and empty texts have no words; a null ``doc_id`` reads as an empty string where a run is hashed; equal rows
count as often as they occur; very long texts are cut between words only, very long words are kept whole; of near words with
equal counts the one that is first in code-point order wins; an empty table gives no words. Only ``doc_id`` and ``text`` are
read, so columns of any other name do not clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Parts a word is cut into, and words of one block of a cell.
PARTS, CELL = 3, 4096
#: Code points per slice of text, and runs up to which hashes are vectorised.
SLICE, LONG = 4 << 20, 64
#: Every ``TYPO``-th run (by its hash) loses a code point.
TYPO = 97
#: Words searched at once.
SEARCHED = 8192

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 0 for b in range(256))


def crc_table() -> np.ndarray:
    """Register updates of CRC-32 for every byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def slices(texts: list[str | None], ids: list[str], limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Letters of some texts as bytes (0 between words), where each text ends, and their ids; long texts are cut between words."""
    parts: list[bytes] = []
    owners: list[str] = []
    total = 0

    def packed() -> tuple[np.ndarray, np.ndarray, list[str]]:
        return np.frombuffer(b"\0".join(parts) + b"\0", np.uint8), np.cumsum([len(p) + 1 for p in parts]), owners

    for text, name in zip(texts, ids, strict=True):
        data = (text or "").encode("latin-1", "replace").translate(_LETTERS)
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > limit:
                gap = data.find(b"\0", at + limit)
                end = gap if gap >= 0 else end
            parts.append(data[at:end])
            owners.append(name)
            total += end - at
            at = end
            if total >= limit:
                yield packed()
                parts, owners, total = [], [], 0
    if parts:
        yield packed()


def run_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, register: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC-32 of the UTF-8 of every run, carried on from ``register``."""
    order = np.argsort(-length, kind="stable")
    start, length, state = start[order], length[order], register[order]
    for n in np.flatnonzero(length > LONG).tolist():
        text = data[start[n] : start[n] + length[n]].tobytes().decode("latin-1").encode()
        state[n] = zlib.crc32(text, int(state[n]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    first = int(np.searchsorted(-length, -LONG))
    for j in range(int(length[first]) if first < len(length) else 0):
        last = int(np.searchsorted(-length, -j))
        byte = data[start[first:last] + j]
        now = state[first:last]
        wide = np.flatnonzero(byte & 0x80)
        lead = byte.copy()
        lead[wide] = 0xC3
        now = table[(now ^ lead) & np.uint32(255)] ^ (now >> np.uint32(8))
        if len(wide):
            now[wide] = table[(now[wide] ^ (byte[wide] - np.uint8(0x40))) & np.uint32(255)] ^ (now[wide] >> np.uint32(8))
        state[first:last] = now
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def tally(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[list[bytes], list[int]]]:
    """The distinct runs with their counts, by exact comparison of eight bytes at a time."""
    chunks = -(-length // 8)
    for c in np.unique(chunks).tolist():
        mine = np.flatnonzero(chunks == c)
        if 8 * c > LONG:
            counts = Counter(data[s : s + n].tobytes() for s, n in zip(start[mine].tolist(), length[mine].tolist(), strict=True))
            yield list(counts), list(counts.values())
            continue
        place = np.arange(8 * c)
        letters = data[np.minimum(start[mine, None] + place, len(data) - 1)]
        letters[place >= length[mine, None]] = 0
        words = letters.view(np.uint64)
        code, first, count = np.unique(words[:, 0], return_index=True, return_inverse=True)[2], None, None
        for k in range(1, c):
            values, inverse = np.unique(words[:, k], return_inverse=True)
            code = np.unique(code * len(values) + inverse, return_inverse=True)[1]
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        yield np.ascontiguousarray(letters[first]).view(f"S{8 * c}").ravel().tolist(), count.tolist()


def count_words(docs: DataFrame, least: int = 5, typo: int = TYPO) -> DataFrame:
    """``word, n``: words of at least ``least`` code points and their occurrences in whole texts.

    A run whose CRC-32 of ``<doc_id>:<run>`` is divisible by ``typo`` loses the code point at that hash modulo its length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = crc_table()
        for batch in batches:
            for data, ends, owners in slices(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                edge = np.flatnonzero(np.diff(data != 0, prepend=False, append=False))
                start, length = edge[::2], edge[1::2] - edge[::2]
                heads = np.array([zlib.crc32(f"{o}:".encode()) ^ 0xFFFFFFFF for o in owners], np.uint32)
                register = heads[np.searchsorted(ends, start, "right")]
                kept = length >= least  # a run can only become shorter
                start, length, register = start[kept], length[kept], register[kept]
                hashed = run_hashes(data, start, length, register, table)
                mark = hashed % typo == 0
                edited: Counter[bytes] = Counter()
                for s, n, h in zip(start[mark].tolist(), length[mark].tolist(), hashed[mark].tolist(), strict=True):
                    if n > least:
                        run, at = data[s : s + n].tobytes(), h % n
                        edited[run[:at] + run[at + 1 :]] += 1
                for words, counts in [*tally(data, start[~mark], length[~mark]), (list(edited), list(edited.values()))]:
                    for a in range(0, len(words), 1 << 16):
                        part = [w.decode("latin-1") for w in words[a : a + (1 << 16)]]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(counts[a : a + (1 << 16)], pa.int64())], ["word", "n"])

    narrow = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def cells(vocabulary: DataFrame, least: int) -> DataFrame:
    """Every word once for each part that may hold its edit: ``key, word, n, short`` (length of the pair's shorter word), ``part``."""
    size = F.length("word")
    kinds = F.explode(F.array(*[F.struct(F.lit(longer).alias("longer"), F.lit(part).alias("part")) for longer in (0, 1) for part in range(PARTS)]))
    placed = vocabulary.select("word", "n", size.alias("size"), kinds.alias("kind")).select(
        "word", "n", "size", (F.col("size") - F.col("kind.longer")).alias("short"), F.col("kind.part").alias("part"),
    ).filter(F.col("short") >= least)

    def cut(part: Column) -> Column:
        product = (F.col("short") - 1) * part
        return ((product - product % PARTS) / PARTS).cast("int")

    front, back = cut(F.col("part")), F.col("short") - 1 - cut(F.col("part") + 1)
    ends = F.concat(F.substring(F.col("word"), F.lit(1), front), F.lit("|"), F.substring(F.col("word"), F.col("size") - back + 1, back))
    return placed.select(F.concat_ws(" ", F.col("short").cast("string"), F.col("part").cast("string"), ends).alias("key"), "word", "n", F.col("short").cast("int"), "part")


def longest_common(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of two padded byte matrices."""
    same = np.logical_and.accumulate(one == other, axis=1) & (one != 0)
    return same.sum(axis=1)


class SortedLists:
    """The sorted lists of some cells, as ranges of words with a common prefix."""

    def __init__(self, letters: np.ndarray, cell: np.ndarray) -> None:
        """``letters``: one padded row per word, with at least one zero at the end; rows are sorted by cell, then letters."""
        self.letters, self.size = letters, (letters != 0).sum(axis=1)
        self.common = np.full(len(letters), -1)
        if len(letters) > 1:
            inside = cell[1:] == cell[:-1]
            self.common[1:] = np.where(inside, longest_common(letters[1:], letters[:-1]), -1)
        self.cell_of = np.cumsum(self.common == -1) - 1

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, other row) at exactly one edit; ``queries`` are rows, each searched in its own list."""
        letters, width = self.letters, self.letters.shape[1]
        query, place = queries, self.cell_of[queries]
        size = self.size[query]
        rows = np.stack([np.full(len(query), 2, np.int8), np.zeros(len(query), np.int8), np.where(size >= 1, 1, 2).astype(np.int8)])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(self.common < 0)
        for depth in range(width):
            if not len(query):
                break
            # The ranges of this depth are split where the common prefix of neighbours ends here.
            deeper = np.flatnonzero(self.common < depth + 1)
            low = np.searchsorted(deeper, starts)
            high = np.append(low[1:], len(deeper))
            count = (high - low)[place]
            child = np.arange(count.sum()) + np.repeat(low[place] - (np.cumsum(count) - count), count)
            query, rows = np.repeat(query, count), np.repeat(rows, count, axis=1)
            letter = letters[deeper[child], depth]
            size = self.size[query]
            ended = letter == 0
            away = size - depth + 1
            hit = np.flatnonzero(ended & (away >= 0) & (away <= 2))
            hit = hit[rows[away[hit], hit] == 1]
            found.append((query[hit], deeper[child[hit]]))
            # Columns depth, depth + 1 and depth + 2 of the next row of the edit matrix.
            before = letters[query, depth - 1] if depth else np.zeros(len(query), np.uint8)
            here = letters[query, depth]
            after = letters[query, min(depth + 1, width - 1)]
            left = np.minimum(rows[1] + 1, rows[0] + (before != letter))
            middle = np.minimum(np.minimum(rows[1] + (here != letter), rows[2] + 1), left + 1)
            right = np.minimum(rows[2] + (after != letter), middle + 1)
            left[size < depth], middle[size < depth + 1], right[size < depth + 2] = 2, 2, 2
            open_ = np.flatnonzero(~ended & (np.minimum(np.minimum(left, middle), right) <= 1))
            query, place = query[open_], child[open_]
            rows = np.minimum(np.stack([left[open_], middle[open_], right[open_]]), 2).astype(np.int8)
            starts = deeper
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


def solve(words: list[bytes], n: np.ndarray, short: np.ndarray, part: np.ndarray, cell: np.ndarray, block: np.ndarray, mixed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per word with near words in its cell: its row, their number, and the row of the best (largest ``n``, then first).

    ``cell`` numbers whole cells in ascending order; in a ``mixed`` cell two blocks meet and only pairs across them count.
    """
    width = max(map(len, words)) + 2
    full = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
    length = (full != 0).sum(axis=1)
    front, until = (short - 1) * part // PARTS, (short - 1) * (part + 1) // PARTS
    middle = length - front - (short - 1 - until)
    reach = int(middle.max()) + 1
    place = np.arange(reach)
    letters = full[np.arange(len(full))[:, None], np.minimum(front[:, None] + place, width - 1)]
    letters[place >= middle[:, None]] = 0
    names = np.ascontiguousarray(letters).view(f"S{reach}").ravel()
    order = np.argsort(names, kind="stable")
    order = order[np.argsort(cell[order], kind="stable")]
    lists = SortedLists(letters[order], cell[order])
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(order), SEARCHED):
        one, other = lists.near(np.arange(at, min(at + SEARCHED, len(order))))
        one, other = order[one], order[other]
        common = longest_common(full[one], full[other])
        # The cell of a pair: its common prefix ends in this part, and its shorter word has this cell's length.
        own = (common >= front[one]) & ((common < until[one]) | (part[one] == PARTS - 1))
        own &= np.minimum(length[one], length[other]) == short[one]
        own &= ~mixed[one] | (block[one] != block[other])
        one, other = one[own], other[own]
        if len(one):
            ranked = np.lexsort((np.array(words, object)[other].astype(f"S{width}"), -n[other], one))
            one, other = one[ranked], other[ranked]
            first = np.flatnonzero(np.diff(one, prepend=-1))
            out.append((one[first], np.diff(first, append=len(one)), other[first]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def near_words(vocabulary: DataFrame, least: int = 5, limit: int = CELL) -> DataFrame:
    """``word, n_near, best_n, best`` for the words of ``vocabulary`` (``word, n``) that have near words."""
    placed = cells(vocabulary, least)
    # Cells beyond the limit, by a hash of their key: a few numbers, and at worst a small cell is divided with a large one.
    mark = F.xxhash64("key")
    large = stored(placed.groupBy(mark.alias("mark")).agg(F.count("*").alias("rows")).filter(F.col("rows") > limit).select(
        "mark", F.ceil(F.col("rows") / limit).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = placed.withColumn("mark", mark).join(large, "mark", "left").select(
        "key", "word", "n", "short", "part", blocks.alias("blocks"), F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"),
    )
    met = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("two"), "word", "n", "short", "part", "block",
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(table: pa.Table) -> pa.RecordBatch:
            key = table.column(0).combine_chunks()
            one, two, n, short, part, block = (table.column(i).to_numpy() for i in (1, 2, 4, 5, 6, 7))
            names = key.dictionary_encode().indices.to_numpy()
            cell = np.cumsum((np.diff(names, prepend=names[:1]) != 0) | (np.diff(one, prepend=one[:1]) != 0) | (np.diff(two, prepend=two[:1]) != 0))
            words = [w.encode("latin-1") for w in table.column(3).to_pylist()]
            alone = np.bincount(cell)[cell] == 1
            use = np.flatnonzero(~alone)
            kept = [words[i] for i in use.tolist()]
            own, count, best = solve(kept, *(x[use] for x in (n, short.astype(np.int64), part.astype(np.int64), cell, block, one != two))) if kept else (np.zeros(0, np.int64),) * 3
            own, best = use[own], use[best]
            column = table.column(3).combine_chunks()
            return pa.RecordBatch.from_arrays([column.take(pa.array(own)), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), column.take(pa.array(best))], ["word", "n_near", "best_n", "best"])

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None and rest.num_rows else table
            rest = table
            if table.num_rows < SEARCHED:
                continue
            last = {c: table.column(c)[table.num_rows - 1].as_py() for c in ("key", "one", "two")}
            same = np.ones(table.num_rows, bool)
            for c, value in last.items():
                same &= np.asarray(pc.equal(table.column(c), value))
            cut = int(np.flatnonzero(~same).max(initial=-1)) + 1
            if cut:
                yield answer(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield answer(rest)

    ordered = met.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    found = ordered.mapInArrow(work, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("at")).select(
        "word", "n_near", (-F.col("at.less")).alias("best_n"), F.col("at.best").alias("best"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` where ``word`` has a ``form``: the last word that forms lead to.

    Every word's pointer is replaced by its target's pointer until none moves. Counts at least double along a chain, so chains
    are short and the rounds fewer still.
    """
    pointers = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        target = pointers.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = stored(pointers.join(target, pointers["root"] == target["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        pointers = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return pointers


def variants(docs: DataFrame, least: int = 5, seen: int = 3, ratio: int = 2, typo: int = TYPO, limit: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for words of at least ``least`` code points that occur ``seen`` times.

    A word's form is its near word with the largest count, if that is at least ``ratio`` times its own.
    """
    vocabulary = stored(count_words(docs, least, typo).filter(F.col("n") >= seen))
    taken = F.col("best_n") >= ratio * F.col("n")
    formed = stored(vocabulary.join(near_words(vocabulary, least, limit), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"),
    ))
    ends = roots(formed.filter(F.col("form").isNotNull()))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
