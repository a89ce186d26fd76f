"""Texts as sets of word shingles, and all pairs of them whose Jaccard similarity is 4/5 or more.

Words are maximal runs of characters other than ASCII white space after A-Z were lower-cased; a text of fewer words than a
shingle is one shingle, a text without words (or null) is the empty set. A set of ``n`` shingles is known by their 64-bit hashes.

The search is exact. Sets of ``n`` and ``m`` shingles are alike if they share at least 4(n + m)/9. In any order of all shingles,
with the first shared one at place ``i`` (from 0) of one set and ``j`` of the other, they share at most ``n - i`` and ``m - j``; so
both places must be low enough for the other's size, and a place admits partners up to ``(5n - 9i)/4`` shingles. Only such places
are listed (prefix filter), and a pair is formed only where both admit each other. The order takes shingles that are common in a
sample last, which keeps lists of sets short; the sample has no influence on the result. Equal sets are one node.

Copies of one text with different edits share long lists, but an edited copy has its own shingles first and so a high place. So every
list's set at the lowest place is its hub, compared with the whole list first; what is alike to a hub needs no more comparison
with each other, and copies too far from the hub have no admitting places left. Candidates are dropped by exact bounds before whole sets are read: by what pairs
can share beyond their last place, and by sketches, in which every shingle flips one bit, so that they differ in no
more bits than the sets in shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .hashing import lean

#: Seed of the shingle hash.
SEED = 42
#: Least Jaccard similarity, as a fraction.
ALIKE = (4, 5)
#: Texts from which common shingles are found, and how many are listed.
SAMPLE, LISTED = 20_000, 1 << 16
#: Pairs that a task returns at a time, about.
PAIRS = 1 << 18
#: Bits of a set's sketch (a power of two, 64 at least).
SKETCH = 2048
#: Bits of the filter for texts that are read again (a multiple of 32,768).
FILTER = 1 << 24


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """Unsigned 64-bit hashes of all shingles of a text, with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))


def alike(one: np.ndarray, other: np.ndarray) -> bool:
    """Is the similarity of two sets without repeats at least 4/5? Two empty ones are alike."""
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both * ALIKE[1] >= (len(one) + len(other) - both) * ALIKE[0]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_hash``; a null text counts as an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, ascending, and how many have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(hashes(x.as_py(), shingle)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    rows = docs.count()
    texts = docs.select(F.col("text").cast("string"))
    texts = texts.sample(SAMPLE / rows, 1) if rows > SAMPLE else texts
    counted = texts.mapInArrow(lean(work), "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    listed = counted.sort(F.desc("n"), "shingle").limit(LISTED).toArrow()
    names, often = listed.column("shingle").to_numpy().view(np.uint64), listed.column("n").to_numpy()
    order = np.argsort(names)
    return names[order], often[order]


def prefix(own: np.ndarray, names: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of the ascending set ``own``, of which sets that are alike share one; rare ones first."""
    count = np.zeros(len(own), np.int64)
    if len(names):
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        count = np.where(names[at] == own, often[at], 0)
    return own[np.argsort(count, kind="stable")[: len(own) + ALIKE[0] * len(own) // -ALIKE[1] + 1]] if len(own) else own


def sketch(own: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits, each the parity of the shingles that fall on it."""
    places = (own >> np.uint64(64 - (SKETCH.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def described(docs: DataFrame, shingle: int, sign: Callable[[np.ndarray], int]) -> DataFrame:
    """``doc_id, text_hash, node, size, prefix, sketch, fp`` per row of ``docs``; ``node`` names the set, ``fp`` is ``sign`` of all shingles."""
    names, often = common(docs, shingle)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, signs = [], np.empty(batch.num_rows, np.uint64)
            for i, text in enumerate(batch.column(2)):
                every = hashes(text.as_py(), shingle)
                signs[i] = sign(every)
                sets.append(np.unique(every))
            node = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            first = pa.array([prefix(s, names, often).view(np.int64) for s in sets], pa.list_(pa.int64()))
            sketches = pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), first, sketches, pa.array(signs.view(np.int64))],
                ["doc_id", "text_hash", "node", "size", "prefix", "sketch", "fp"],
            )

    return keyed(docs).select("doc_id", "text_hash", "text").mapInArrow(
        lean(work), "doc_id long, text_hash long, node long, size int, prefix array<long>, sketch array<long>, fp long",
    )


def rows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)


LIST = ["shingle", "node", "size", "place", "hub", "hub_size", "hub_place"]


def lists(nodes: DataFrame) -> DataFrame:
    """``LIST``: the nodes of every shingle that is in several prefixes, with the one at the lowest place.

    A list is read as a sorted stream, so its length takes no memory.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, hub, several = np.zeros((0, 4), np.int64), np.zeros((0, 4), np.int64), False
        for batch in batches:
            rows = np.concatenate([rest, rows_of(batch)])
            if not len(rows):
                continue
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            goes_on = len(hub) > 0 and hub[0, 0] == rows[0, 0]
            hubs = rows[starts].copy()
            if goes_on:
                hubs[0] = hub[0]
            lengths = np.diff(np.append(starts, len(rows)))
            keep = lengths > 1
            keep[0] |= goes_on and several
            # The last row waits if it is alone so far.
            waits = not keep[-1]
            own = np.repeat(hubs, np.where(keep, lengths, 0), axis=0)
            yield listed(rows[np.repeat(keep, lengths)], own)
            rest, hub, several = (rows[-1:], hubs[-1:], False) if waits else (rows[:0], hubs[-1:], True)

    def listed(rows: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        columns = [*np.ascontiguousarray(rows.T), *np.ascontiguousarray(own[:, 1:].T)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], LIST)

    placed = nodes.select(F.posexplode("prefix").alias("place", "shingle"), "node", "size").select("shingle", "node", "size", "place")
    ordered = placed.repartition("shingle").sortWithinPartitions("shingle", "place", "node")
    return ordered.mapInArrow(lean(work), ", ".join(f"{c} long" for c in LIST))


def most(size: Column | np.ndarray, place: Column | np.ndarray) -> Column | np.ndarray:
    """Four times the largest size of a partner whose first shared shingle is at this place."""
    return size * (ALIKE[0] + 1) - place * (ALIKE[0] + ALIKE[1])


def hub_pairs(found: DataFrame) -> DataFrame:
    """``one, other``: nodes of a list with its hub, where both places admit the other."""
    own = (F.col("node") != F.col("hub")) & (F.col("hub_size") * 4 <= most(F.col("size"), F.col("place")))
    pairs = found.filter(own & (F.col("size") * 4 <= most(F.col("hub_size"), F.col("hub_place"))))
    return pairs.select(F.least("node", "hub").alias("one"), F.greatest("node", "hub").alias("other")).distinct()


def open_pairs(found: DataFrame, roots: DataFrame) -> DataFrame:
    """``one, other``: all pairs that may be alike by their lists and that ``roots`` has not linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``rows``: shingle, node, size, place, root; whole lists, by ascending size."""
            starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            lengths = np.diff(np.append(starts, len(rows)))
            # Lists within one group are done.
            mixed = np.minimum.reduceat(rows[:, 4], starts) != np.maximum.reduceat(rows[:, 4], starts)
            rows, line = rows[np.repeat(mixed, lengths)], np.repeat(np.arange(mixed.sum()), lengths[mixed])
            if not len(rows):
                return
            reach = most(rows[:, 2], rows[:, 3]) // 4
            # Sizes are below 2**31, so list and size make one ascending key.
            ends = np.searchsorted((line << 32) + rows[:, 2], (line << 32) + np.maximum(reach, 0), "right")
            count = np.maximum(ends - np.arange(len(rows)) - 1, 0)
            done = np.cumsum(count)
            at = 0
            while at < len(rows):
                before = done[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(done, before + PAIRS, "right")))
                own = np.repeat(np.arange(at, to), count[at:to])
                mate = own + 1 + np.arange(len(own)) - np.repeat(done[at:to] - count[at:to] - before, count[at:to])
                keep = (rows[own, 4] != rows[mate, 4]) & (reach[mate] >= rows[own, 2])
                a, b = rows[own[keep], 1:4], rows[mate[keep], 1:4]
                swap = a[:, 0] > b[:, 0]
                a[swap], b[swap] = b[swap], a[swap]
                columns = [a[:, 0], b[:, 0], a[:, 1], b[:, 1], a[:, 2], b[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], pair_names)
                at = to

        rest = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, rows_of(batch)])
            cut = int(np.flatnonzero(rows[:, 0] != rows[-1, 0]).max(initial=-1)) + 1 if len(rows) else 0
            if cut:
                yield from solve(rows[:cut])
            rest = rows[cut:]
        if len(rest):
            yield from solve(rest)

    pair_names = ["one", "other", "one_size", "other_size", "one_place", "other_place"]
    named = found.join(roots, "node", "left").select("shingle", "node", "size", "place", F.coalesce("root", "node").alias("root"))
    ordered = named.repartition("shingle").sortWithinPartitions("shingle", "size", "node")
    pairs = ordered.mapInArrow(lean(work), ", ".join(f"{c} long" for c in pair_names))
    kept = [F.first(c).alias(c) for c in pair_names[2:4]] + [F.max(c).alias(c) for c in pair_names[4:]]
    counted = pairs.groupBy("one", "other").agg(F.count("*").alias("n"), *kept)
    # What they share: the lists counted, and at most what follows the last of these places.
    beyond = F.least(F.col("one_size") - F.col("one_place"), F.col("other_size") - F.col("other_place")) - 1
    enough = (F.col("n") + beyond) * (ALIKE[0] + ALIKE[1]) >= (F.col("one_size") + F.col("other_size")) * ALIKE[0]
    return counted.filter(enough).select("one", "other")


def close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose sketches differ in no more bits than alike sets of these sizes in shingles."""
    for side in ("one", "other"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("sketch").alias(f"{side}_sketch")), side)
    bits = F.aggregate(F.zip_with("one_sketch", "other_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, x: n + x)
    # At least 4/9 of both sizes are shared, so at most 1/9 of them is not.
    return pairs.filter(bits * (ALIKE[0] + ALIKE[1]) <= F.col("one_size") + F.col("other_size")).select("one", "other")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``src, dst``: those of ``pairs`` that are alike, compared on their whole sets."""

    row = F.xxhash64("id", "hash")
    asked = pairs.select(F.col("one").alias("node")).union(pairs.select("other")).distinct()
    keys = nodes.join(asked, "node").select("node", F.col("at.doc_id").alias("id"), F.col("at.text_hash").alias("hash"))
    wanted = stored(keys.select("node", row.alias("row")))
    # The driver sees one bit per row at most, in FILTER bits: texts that nobody asks for are not sent.
    place = F.pmod("row", F.lit(FILTER)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(place).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    bits = np.zeros(FILTER // 8, np.uint8)
    for m in maps:
        bits[(m["at"] - 1) * 4096 : m["at"] * 4096] = np.frombuffer(bytes(m["bits"]), np.uint8)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() % FILTER
            keep = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            sets = [np.unique(hashes(x.as_py(), shingle)).tobytes() for x in keep.column(1)]
            yield pa.RecordBatch.from_arrays([keep.column(0), pa.array(sets, pa.binary())], ["row", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(batch.column(2), batch.column(3), strict=True)
            keep = pa.array([alike(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["src", "dst"])

    texts = keyed(docs).select(F.xxhash64("doc_id", "text_hash").alias("row"), "text").mapInArrow(lean(read), "row long, own binary")
    # Equal rows all answer; one is enough.
    sets = stored(texts.join(wanted, "row").select("node", "own").dropDuplicates(["node"]))
    left = pairs.join(sets.select(F.col("node").alias("one"), F.col("own").alias("one_set")), "one")
    both = left.join(sets.select(F.col("node").alias("other"), F.col("own").alias("other_set")), "other")
    return both.select("one", "other", "one_set", "other_set").mapInArrow(lean(compare), "src long, dst long")
