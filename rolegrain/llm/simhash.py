"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius through sharded BK-trees.

Words are maximal runs of characters other than ASCII white space after A-Z were lower-cased; shingles of ``shingle`` words
count with their repeats, a shorter text is one shingle, a text without words (or null) has fingerprint 0. A fingerprint bit
is 1 if it is set in over half of the shingles' hashes (XXH64 of the UTF-8 text, seed 42).

Linking is exact. Equal fingerprints are one node, so copies cost nothing. Nodes within the radius ``r`` agree on at least
``k`` of ``r + k`` bit ranges (pigeonhole), so a node goes to one shard for each choice of ``k`` ranges, keyed by its bits
there. A shard is one BK-tree: a child hangs below its parent on the edge of their Hamming distance ``d``, and a search at
distance ``x`` from the parent follows only edges with ``|d - x| <= r``. A shard beyond ``SHARD`` nodes is cut into blocks:
each block is a tree of its own, sent to the tasks that search it with the nodes of another block. Tasks return links that
span their components, never all pairs; components across tasks follow from large-star and small-star steps.

Defined cases: null and empty texts share fingerprint 0 and link like any other; equal rows are separate documents of one
group; documents with a null id are linked, but a null id is never the smallest of a group that has another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from . import shingles
from .hashing import runs

#: Nodes per tree; a shard beyond it is searched block by block.
SHARD = 2048
#: Keys per node at most.
MOST_KEYS = 200


def text_fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return fingerprint(shingles.hashes(text, shingle))


def fingerprint(hashes: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint of all shingles of a text."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a long) per row of ``docs``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((text_fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return narrow.mapInArrow(work, "doc_id long, fp long")


def ranges(parts: int) -> list[tuple[int, int]]:
    """``parts`` bit ranges (shift, width) that cover 64 bits."""
    cuts = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def agreeing(radius: int, nodes: int) -> int:
    """How many of ``radius + k`` ranges must agree, so that a shard of unrelated nodes stays small; any ``k`` is exact."""
    k = 2
    while k < 4 and nodes / 2 ** (64 * k / (radius + k)) > SHARD / 32 and comb(radius + k + 1, k + 1) <= MOST_KEYS:
        k += 1
    return k


def shard_keys(fp: Column, radius: int, agree: int) -> Column:
    """One long per choice of ``agree`` bit ranges: the choice's number above the bits of its ranges."""
    spans = ranges(radius + agree)
    keys = []
    for number, choice in enumerate(combinations(spans, agree)):
        bits = F.lit(0).cast("long")
        for shift, width in choice:
            bits = F.shiftleft(bits, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.lit(number << 52).bitwiseOR(bits))
    return F.array(*keys)


def distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ other).astype(np.int16)


class BKTrees:
    """One tree per cell, built and searched level by level for all cells at once."""

    def __init__(self, nodes: np.ndarray, cell: np.ndarray) -> None:
        """``cell`` is ascending; the first node of a cell is its root."""
        self.nodes = nodes
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.roots = dict(zip(cell[first].tolist(), first.tolist(), strict=True))
        item = np.delete(np.arange(len(nodes)), first)
        above = np.repeat(first, np.diff(first, append=len(nodes)) - 1)
        found = []
        while len(item):
            edge = distances(nodes[item], nodes[above])
            order = np.lexsort((edge, above))
            item, above, edge = item[order], above[order], edge[order]
            # The first of all that are equally far from a node becomes its child, the others go below that child.
            new = np.concatenate([[True], (above[1:] != above[:-1]) | (edge[1:] != edge[:-1])])
            found.append((above[new], edge[new], item[new]))
            child = np.repeat(item[new], np.diff(np.flatnonzero(new), append=len(item)))
            item, above = item[~new], child[~new]
        parent, edge, child = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(parent, kind="stable")
        self.edge, self.child = edge[order], child[order]
        self.low = np.searchsorted(parent[order], np.arange(len(nodes)))
        self.high = np.searchsorted(parent[order], np.arange(len(nodes)), "right")

    def search(self, queries: np.ndarray, cell: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node number) of a cell within the radius; only edges within it are followed."""
        node = np.array([self.roots.get(c, -1) for c in cell.tolist()], np.int64)
        query = np.flatnonzero(node >= 0)
        node = node[query]
        while len(query):
            d = distances(queries[query], self.nodes[node])
            hit = d <= radius
            yield query[hit], node[hit]
            count = self.high[node] - self.low[node]
            place = np.arange(count.sum()) + np.repeat(self.low[node] - (np.cumsum(count) - count), count)
            follow = np.abs(self.edge[place] - np.repeat(d, count)) <= radius
            query, node = np.repeat(query, count)[follow], self.child[place[follow]]


def least_labels(size: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least member of every item's component."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[one], label[other])
        np.minimum.at(label, one, low)
        np.minimum.at(label, other, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            return label


def cell_links(fps: np.ndarray, cell: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of fingerprints that span the components inside the cells; ``tree`` and ``query`` tell the rows' parts."""
    trees, own, asked = BKTrees(fps[tree], cell[tree]), np.flatnonzero(tree), np.flatnonzero(query)
    pairs = list(trees.search(fps[asked], cell[asked], radius))
    if not pairs:
        return np.zeros((0, 2), np.uint64)
    one, other = asked[np.concatenate([q for q, _ in pairs])], own[np.concatenate([n for _, n in pairs])]
    label = least_labels(len(fps), one, other)
    away = np.flatnonzero(label != np.arange(len(fps)))
    return np.stack([fps[away], fps[label[away]]], axis=1)


def links(nodes: DataFrame, radius: int, limit: int = SHARD) -> DataFrame:
    """A spanning set ``src, dst`` of the links between the distinct fingerprints ``fp``."""
    agree = agreeing(radius, nodes.count())
    placed = nodes.select("fp", F.explode(shard_keys(F.col("fp"), radius, agree)).alias("key"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Most shards hold one node and end here; of the others large ones are dealt to blocks.
    grid = stored(sizes.select("key", F.ceil(F.col("n") / limit).cast("int").alias("blocks")))
    dealt = placed.join(grid, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("two"), "fp", "block",
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: np.ndarray) -> pa.RecordBatch:
            """``rows``: key, one, two, fp, block; whole cells."""
            found = []
            cell = np.cumsum((np.diff(rows[:, :3], axis=0, prepend=rows[:1, :3]) != 0).any(axis=1))
            sizes = np.bincount(cell)
            ends = np.cumsum(sizes)
            # So many cells at a time that their pairs would fit in memory.
            for a, b in runs((sizes.astype(float) ** 2).tolist(), float(limit) ** 2):
                part = slice(ends[a] - sizes[a], ends[b - 1])
                one, two, block = rows[part, 1], rows[part, 2], rows[part, 4]
                found.append(cell_links(rows[part, 3].copy().view(np.uint64), cell[part], block == one, block == two, radius))
            both = np.unique(np.concatenate(found), axis=0).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["src", "dst"])

        rest = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
            cut = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)).max(initial=-1)) + 1
            if cut:
                yield solve(rows[:cut])
            rest = rows[cut:]
        if len(rest):
            yield solve(rest)

    ordered = cells.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return ordered.mapInArrow(work, "src long, dst long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges``; the root is the component's least node.

    Alternates large-star and small-star steps; each is one grouping, and the number of rounds grows with the logarithm
    of the component sizes. A star's centre may have very many leaves, so the minimum is found by a partial aggregate and
    joined back instead of gathering the leaves.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stored(least)
        spent.append(least)
        joined = both.join(least, "a")
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    pairs = stored(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).filter("a <> b").distinct())
    mark = None
    while True:
        spent = [pairs]
        pairs = stored(star(star(pairs, True), False))
        discard(*spent)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``; the component's id is its smallest document id."""
    found = stored(fingerprints(docs, shingle))
    nodes = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes, radius))
    labelled = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(labelled.join(least, "root").select("fp", "component_id"))
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def near_pairs(nodes: DataFrame, radius: int, limit: int = SHARD) -> DataFrame:
    """``one, other``: nodes whose fingerprints ``fp`` are equal, or linked by the trees; pairs that span what is linked."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    equal = nodes.select("fp", "node").join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = links(heads.select("fp"), radius, limit)
    for side, end in (("a", "src"), ("b", "dst")):
        found = found.join(heads.select(F.col("fp").alias(end), F.col("head").alias(side)), end)
    pairs = equal.union(found.select("a", "b"))
    return pairs.select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other")).distinct()


def similar_groups(docs: DataFrame, shingle: int = 5, radius: int = 4) -> DataFrame:
    """``doc_id, text_hash, root`` per row of ``docs``: groups of texts linked by a Jaccard similarity of their shingles of 4/5 or more.

    The links of the trees within ``radius`` bits come first. A link counts if the whole sets are alike; what is alike at a greater
    distance follows from the exact search in the lists, which compares only what is not linked by then.
    """
    found = stored(shingles.described(docs, shingle, fingerprint))
    nodes = stored(found.groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("size", "prefix", "sketch")], F.min("fp").alias("fp"), F.min(F.struct("doc_id", "text_hash")).alias("at"),
    ))
    rows = stored(found.select("doc_id", "text_hash", "node"))
    discard(found)
    near = stored(near_pairs(nodes, radius))
    lists = stored(shingles.lists(nodes))
    # Links of the trees and of the hubs are compared in one reading of the texts.
    pairs = stored(shingles.close(near.union(shingles.hub_pairs(lists)).distinct(), nodes))
    discard(near)
    linked = stored(shingles.verified(pairs, docs, nodes, shingle))
    first = components(linked)
    rest = stored(shingles.close(shingles.open_pairs(lists, first).join(pairs, ["one", "other"], "left_anti"), nodes))
    discard(lists)
    more = stored(shingles.verified(rest, docs, nodes, shingle))
    roots = components(linked.union(more))
    discard(nodes, pairs, rest, linked, more)
    return rows.join(roots.withColumnsRenamed({"node": "node_"}), F.col("node") == F.col("node_"), "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` per group of near-duplicates: that with the smallest id (null last), then text hash; of equal rows one.

    Near-duplicates are linked by their fingerprints in BK-trees and confirmed on the whole shingle sets. Fingerprints of texts with a
    similarity of 0.8 differ by 9 to 14 bits, which no radius covers that keeps shards small, so an exact search adds what is left.
    """
    rows = stored(similar_groups(docs, shingle))
    # An id does not name a row: ids may be null or repeated. Equal ids with equal texts are in one group.
    places = rows.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = places.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n")).alias("at"))
    keep = stored(first.select(F.col("at.doc_id").alias("id_"), F.col("at.text_hash").alias("hash_"), "at.n"))
    texts = docs.withColumn("hash_of_", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    # The same plan at every size: both sides are laid out by key, the kept keys are never sent to all tasks.
    same = (texts["hash_of_"] == keep["hash_"]) & texts["doc_id"].cast("long").eqNullSafe(keep["id_"])
    kept = texts.join(keep.select("id_", "hash_").hint("merge"), same, "left_semi")
    repeated = keep.filter("n > 1").limit(1).count() > 0
    return (kept.dropDuplicates(["doc_id", "hash_of_"]) if repeated else kept).drop("hash_of_")
