"""Prefix tries of conversations: adaptive radix trees over fixed-width turn ids.

A turn's id is 16 bytes, big-endian: the head of the SHA-256 of role and text. A conversation's key is the sequence of its
ids, and a trie node stands for every distinct sequence of first turns. Keys are sorted over the whole cluster, so a node's
members are neighbours, and every task holds one range of the order in an adaptive radix tree: nodes grow from 4 over 16 and
48 to 256 children, runs of bytes without a branch are kept in one node, a lone key is a leaf as a whole. Branches inside an
id and compressed runs emit nothing of their own; byte depths that are multiples of the id's width emit a node each.

Only prefixes of a range's first and last key can have members in another range. A task reports those apart, with what lies
closed below them; partial nodes of equal prefixes are merged, and sums over subtrees climb the merged ones by pointer
doubling, in as many rounds as the logarithm of their depth. All other nodes are complete where they are emitted. Ranges cut
conversations with equal turns as well, so a sequence shared by any share of all conversations is no task's burden; its member
list is hashed from pieces of ``PIECE`` ids, in order, by one task that keeps one piece at a time.

Defined cases: a null role or text is empty; null turns come first; turns with equal numbers (repeated rows too) follow the
order of their ids; rows without a conversation id belong to no conversation; a conversation whose rebuilt turns are empty is a
member of the root alone; very long texts leave the first stage as an id and a length; a conversation's turns are one row of 24
bytes each; an empty table gives no nodes. Only the four named columns are read, so columns of any other name do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Bytes of a turn id, and turns and conversations of one range, about.
WIDTH, TURNS, CONVERSATIONS = 16, 250_000, 50_000
#: Ids per piece of a member list that may span ranges.
PIECE = 8192
_EMPTY = hashlib.sha256(b"").hexdigest()
_SCHEMA = ("kind int, part int, id binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
           "saved_tokens long, ends_sha256 string, size long, closed_children long, closed_leaves long, closed_saved long, first long, piece binary")
_FIELDS = [x.strip().split()[0] for x in _SCHEMA.split(",")]
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_ARROW = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in _SCHEMA.split(",")])


class Leaf:
    """One key with its conversations, in ascending order, and the lengths of its turns."""

    __slots__ = ("key", "members", "sizes")

    def __init__(self, key: bytes, member: int, sizes: list[int]) -> None:
        self.key, self.members, self.sizes = key, [member], sizes


class Few:
    """Up to 4 or 16 children beside a sorted list of their bytes."""

    __slots__ = ("prefix", "own", "room", "letters", "below")

    def __init__(self, prefix: bytes, own: Leaf | None = None, room: int = 4) -> None:
        self.prefix, self.own, self.room, self.letters, self.below = prefix, own, room, bytearray(), []

    def get(self, letter: int):
        at = self.letters.find(letter)
        return self.below[at] if at >= 0 else None

    def put(self, letter: int, child) -> bool:
        """Sets a child; False if there is no room for another."""
        at = self.letters.find(letter)
        if at >= 0:
            self.below[at] = child
            return True
        if len(self.letters) == self.room:
            return False
        at = next((i for i, x in enumerate(self.letters) if x > letter), len(self.letters))
        self.letters.insert(at, letter)
        self.below.insert(at, child)
        return True

    def children(self) -> list:
        return self.below

    def grown(self):
        larger = Few(self.prefix, self.own, 16) if self.room == 4 else Indexed(self.prefix, self.own)
        for letter, child in zip(self.letters, self.below, strict=True):
            larger.put(letter, child)
        return larger


class Indexed:
    """Up to 48 children, found over an index of 256 bytes."""

    __slots__ = ("prefix", "own", "index", "below")

    def __init__(self, prefix: bytes, own: Leaf | None) -> None:
        self.prefix, self.own, self.index, self.below = prefix, own, bytearray(256), []

    def get(self, letter: int):
        at = self.index[letter]
        return self.below[at - 1] if at else None

    def put(self, letter: int, child) -> bool:
        at = self.index[letter]
        if at:
            self.below[at - 1] = child
            return True
        if len(self.below) == 48:
            return False
        self.below.append(child)
        self.index[letter] = len(self.below)
        return True

    def children(self) -> list:
        return [self.below[at - 1] for at in self.index if at]

    def grown(self):
        larger = Direct(self.prefix, self.own)
        for letter, at in enumerate(self.index):
            if at:
                larger.below[letter] = self.below[at - 1]
        return larger


class Direct:
    """A place for each of 256 children."""

    __slots__ = ("prefix", "own", "below")

    def __init__(self, prefix: bytes, own: Leaf | None) -> None:
        self.prefix, self.own, self.below = prefix, own, [None] * 256

    def get(self, letter: int):
        return self.below[letter]

    def put(self, letter: int, child) -> bool:
        self.below[letter] = child
        return True

    def children(self) -> list:
        return [x for x in self.below if x is not None]


def agreement(one: bytes, other: bytes) -> int:
    """Bytes of the common prefix."""
    n = min(len(one), len(other))
    if one[:n] == other[:n]:
        return n
    apart = int.from_bytes(one[:n], "big") ^ int.from_bytes(other[:n], "big")
    return n - (apart.bit_length() + 7) // 8


class RadixTree:
    """An adaptive radix tree with path compression and whole keys in its leaves."""

    def __init__(self) -> None:
        self.root = Few(b"")

    def insert(self, key: bytes, member: int, sizes: list[int]) -> None:
        above, letter, node, depth = None, 0, self.root, 0
        while True:
            if isinstance(node, Leaf):
                if node.key == key:
                    node.members.append(member)
                    return
                same = depth + agreement(node.key[depth:], key[depth:])
                branch = Few(key[depth:same])
                self.hang(branch, node, same)
                self.hang(branch, Leaf(key, member, sizes), same)
                above.put(letter, branch)
                return
            same = agreement(node.prefix, key[depth : depth + len(node.prefix)])
            if same < len(node.prefix):
                branch = Few(node.prefix[:same])
                branch.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                self.hang(branch, Leaf(key, member, sizes), depth + same)
                above.put(letter, branch)
                return
            depth += same
            if depth == len(key):
                if node.own is None:
                    node.own = Leaf(key, member, sizes)
                else:
                    node.own.members.append(member)
                return
            child = node.get(key[depth])
            if child is None:
                leaf = Leaf(key, member, sizes)
                if not node.put(key[depth], leaf):
                    node = node.grown()
                    node.put(key[depth], leaf)
                    if above is None:
                        self.root = node
                    else:
                        above.put(letter, node)
                return
            above, letter, node, depth = node, key[depth], child, depth + 1

    @staticmethod
    def hang(branch: Few, leaf: Leaf, depth: int) -> None:
        if len(leaf.key) == depth:
            branch.own = leaf
        else:
            branch.put(leaf.key[depth], leaf)


class Row:
    """A trie node whose parent is not known yet."""

    __slots__ = ("least", "depth", "n", "children", "leaves", "saved", "ends", "id")

    def __init__(self, least: int, depth: int, n: int, children: int, leaves: int, saved: int, ends: str, name: bytes | None) -> None:
        self.least, self.depth, self.n, self.children, self.leaves, self.saved, self.ends, self.id = least, depth, n, children, leaves, saved, ends, name


class Summary:
    """What is known of a subtree while its upper nodes are still to come."""

    __slots__ = ("least", "n", "leaf", "open", "border")

    def __init__(self, least: int, n: int, leaf: Leaf, waiting: list[Row], border: tuple[int, int]) -> None:
        self.least, self.n, self.leaf, self.open, self.border = least, n, leaf, waiting, border


class Range:
    """Emits the nodes of one range of sorted keys."""

    def __init__(self, part: int) -> None:
        self.part, self.tree, self.first, self.last, self.out = part, RadixTree(), None, b"", []

    def add(self, key: bytes, member: int, sizes: list[int]) -> None:
        if self.first is None:
            self.first = key
        self.last = key
        self.tree.insert(key, member, sizes)

    @staticmethod
    def names(key: bytes) -> list[bytes]:
        """Ids of all prefixes of a key."""
        running = hashlib.sha256()
        found = [running.digest()[:16]]
        for at in range(0, len(key), WIDTH):
            running.update(key[at : at + WIDTH])
            found.append(running.copy().digest()[:16])
        return found

    def report(self, **values) -> None:
        self.out.append(tuple(values.get(f) for f in _FIELDS))

    def name(self, found: Summary, depth: int) -> bytes | None:
        """The id of a node that may have members in another range."""
        if depth * WIDTH <= found.border[0]:
            return self.heads[depth]
        return self.tails[depth] if depth * WIDTH <= found.border[1] else None

    def climb(self, found: Summary, end: int, above: int, own: Leaf | None) -> None:
        """Emits the nodes at byte depths in ``(above, end]``; ``own`` ends at ``end``."""
        for depth in range(end // WIDTH, above // WIDTH, -1):
            name = self.name(found, depth)
            members = own.members if own is not None and depth * WIDTH == end else []
            below = found.open
            ends = hashlib.sha256(",".join(map(str, members)).encode()).hexdigest() if members else _EMPTY
            size = found.leaf.sizes[depth - 1] if depth else 0
            leaves, saved = sum(r.leaves for r in below) or 1, sum(r.saved for r in below) + (found.n - 1) * size
            for r in below:
                self.settle(r, name, None if name else found.least)
            if name:
                closed = [r for r in below if r.id is None]
                up = self.name(found, depth - 1) if depth else None
                self.report(
                    kind=1, part=self.part, id=name, parent=up, conv_id=found.least, depth=depth, n_convs=found.n, n_children=len(below), n_leaves=leaves,
                    saved_tokens=saved, ends_sha256=ends, size=size, closed_children=len(closed), closed_leaves=sum(r.leaves for r in closed),
                    closed_saved=sum(r.saved for r in closed),
                )
                for at in range(0, len(members), PIECE):
                    piece = members[at : at + PIECE]
                    self.report(kind=2, part=self.part, id=name, first=piece[0], piece=",".join(map(str, piece)).encode())
            found.open = [Row(found.least, depth, found.n, len(below), leaves, saved, ends, name)]

    def settle(self, r: Row, parent: bytes | None, parent_conv: int | None) -> None:
        if r.id is None:
            self.report(
                kind=0, part=self.part, parent=parent, conv_id=r.least, depth=r.depth, parent_conv_id=parent_conv, n_convs=r.n, n_children=r.children,
                n_leaves=r.leaves, saved_tokens=r.saved, ends_sha256=r.ends,
            )

    def leaf(self, leaf: Leaf) -> Summary:
        border = agreement(leaf.key, self.first), agreement(leaf.key, self.last)
        return Summary(leaf.members[0], len(leaf.members), leaf, [], border)

    def emit(self) -> Iterator[pa.RecordBatch]:
        """All rows of the range, nodes below their parents first."""
        if self.first is None:
            return
        self.heads, self.tails = self.names(self.first), self.names(self.last)
        # Each frame: node, byte depth of its end, of its parent's end, its children, summaries of those done.
        root = self.tree.root
        stack = [(root, len(root.prefix), -WIDTH, iter(root.children()), [])]
        while stack:
            node, end, above, rest, done = stack[-1]
            child = next(rest, None)
            if child is not None:
                if isinstance(child, Leaf):
                    found = self.leaf(child)
                    self.climb(found, len(child.key), end, child)
                    done.append(found)
                else:
                    stack.append((child, end + 1 + len(child.prefix), end, iter(child.children()), []))
                continue
            stack.pop()
            parts = done + ([self.leaf(node.own)] if node.own is not None else [])
            found = Summary(min(p.least for p in parts), sum(p.n for p in parts), parts[0].leaf, [r for p in parts for r in p.open], parts[0].border)
            self.climb(found, end, above, node.own)
            if stack:
                stack[-1][4].append(found)
            if len(self.out) >= 1 << 16:
                yield self.batch()
        yield self.batch()

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[]] * len(_FIELDS)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def rebuilt(docs: DataFrame, period: int = 100, heads: int = 6) -> DataFrame:
    """``conv_id, path, sizes``: turn ids and text lengths of every rebuilt conversation.

    Conversation ``c`` takes its first ``crc32(c) % heads`` turns from conversation ``c - c % period``. One shuffle: a block of
    ``period`` conversations and the one they borrow from meet in one task.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    conv = F.col("conv_id").cast("long")
    narrow = docs.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % period).alias("base"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(named, 1, 2 * WIDTH)).alias("id"), F.length(text).alias("size")).alias("turn"),
    )
    grouped = narrow.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    lent = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, heads - 1))).over(Window.partitionBy("base"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = F.slice("turns", F.col("taken") + 1, F.size("turns"))
    joined = grouped.withColumn("lent", lent).withColumn("taken", taken).select(
        "conv_id", F.when(F.col("lent").isNull(), own).otherwise(F.concat(F.slice("lent", F.lit(1), F.col("taken")), own)).alias("turns"),
    )
    return joined.select("conv_id", F.transform("turns", lambda t: t["id"]).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


def ranges(keys: DataFrame, turns: int = TURNS, conversations: int = CONVERSATIONS) -> DataFrame:
    """Rows of every range's tree: complete nodes (kind 0), nodes that may be shared (1), pieces of their members (2)."""
    sizes = keys.agg(F.count("*").alias("n"), F.sum(F.size("path")).alias("turns")).first()
    parts = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes["n"] // conversations), -(-(sizes["turns"] or 0) // turns))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Range(TaskContext.get().partitionId())
        for batch in batches:
            for conv, path, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own.add(b"".join(path), conv, lengths)
        yield from own.emit()

    ordered = keys.select("conv_id", "path", "sizes").repartitionByRange(parts, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.mapInArrow(work, _SCHEMA)


def hashed_members(pieces: DataFrame) -> DataFrame:
    """``id, ends_sha256`` from pieces of member lists in order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name == now:
                    running.update(b",")
                else:
                    if now is not None:
                        done.append((now, running.hexdigest()))
                    now, running = name, hashlib.sha256()
                running.update(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], ["id", "ends_sha256"])

    ordered = pieces.select("id", "first", "piece").repartition("id").sortWithinPartitions("id", "first")
    return ordered.mapInArrow(work, "id binary, ends_sha256 string")


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` (``id, parent, depth, n_leaves, saved_tokens`` and others) with both sums taken over all nodes below as well."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    jumps = nodes.select("id", F.col("parent").alias("up")).filter(F.col("up").isNotNull())
    step = 1
    while step <= deepest:
        added = nodes.join(jumps, "id").groupBy("up").agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        nodes = stored(nodes.join(added, nodes["id"] == added["up"], "left").withColumns({
            "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)),
        }).drop("up", "more_leaves", "more_saved"))
        farther = jumps.select(F.col("id").alias("at"), F.col("up").alias("next"))
        jumps = stored(jumps.join(farther, jumps["up"] == farther["at"]).select("id", F.col("next").alias("up")))
        step *= 2
    return nodes


def trie(keys: DataFrame, turns: int = TURNS, conversations: int = CONVERSATIONS) -> DataFrame:
    """One row per node of the trie of ``keys`` (``conv_id, path, sizes``)."""
    found = stored(ranges(stored(keys), turns, conversations))
    partial = found.filter("kind = 1")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "closed_children", "closed_leaves", "closed_saved")]
    firsts = [F.min(c).alias(c) for c in ("parent", "conv_id", "depth", "size", "n_children", "n_leaves", "saved_tokens", "ends_sha256")]
    merged = stored(partial.groupBy("id").agg(*sums, *firsts, F.count("*").alias("parts")))
    inside, shared = merged.filter("parts = 1"), merged.filter("parts > 1")
    # A shared node's children: those closed in some range, those reported but met in one range only, and shared ones.
    lone = inside.groupBy("parent").agg(F.count("*").alias("lone"), F.sum("n_leaves").alias("lone_leaves"), F.sum("saved_tokens").alias("lone_saved"))
    common = shared.groupBy("parent").agg(F.count("*").alias("common"))
    own = shared.drop("n_children", "n_leaves", "saved_tokens", "ends_sha256")
    own = own.join(lone.withColumnRenamed("parent", "of"), F.col("id") == F.col("of"), "left").drop("of")
    own = own.join(common.withColumnRenamed("parent", "of"), F.col("id") == F.col("of"), "left").drop("of").fillna(0, ["lone", "lone_leaves", "lone_saved", "common"])
    children = F.col("closed_children") + F.col("lone") + F.col("common")
    own = own.withColumns({
        "n_children": children, "n_leaves": F.col("closed_leaves") + F.col("lone_leaves") + (children == 0).cast("long"),
        "saved_tokens": F.col("closed_saved") + F.col("lone_saved") + (F.col("n_convs") - 1) * F.col("size"),
    })
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    own = subtree_sums(stored(own.select("id", "parent", *[c for c in columns if c not in ("parent_conv_id", "ends_sha256")])))
    ends = hashed_members(found.filter("kind = 2").join(own.select("id"), "id", "left_semi"))
    own = own.join(ends, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    least = merged.select(F.col("id").alias("of"), F.col("conv_id").alias("parent_conv_id"))
    reported = own.unionByName(inside.select(*own.columns))
    reported = reported.join(least, reported["parent"] == least["of"], "left")
    # Complete nodes below a reported one look its least member up by range, so the root's many children are spread.
    closed = found.filter("kind = 0")
    here = partial.select(F.col("id").alias("of"), F.col("part").alias("in_part")).join(least, "of").withColumnRenamed("parent_conv_id", "known")
    top = closed.filter(F.col("parent").isNotNull())
    top = top.join(here, (top["parent"] == here["of"]) & (top["part"] == here["in_part"])).withColumn("parent_conv_id", F.col("known"))
    return closed.filter(F.col("parent").isNull()).select(*columns).union(top.select(*columns)).union(reported.select(*columns))


def conversation_trie(docs: DataFrame, period: int = 100, heads: int = 6, turns: int = TURNS, conversations: int = CONVERSATIONS) -> DataFrame:
    """The trie of the rebuilt conversations of ``docs`` (``conv_id, turn, role, text``)."""
    return trie(rebuilt(docs, period, heads), turns, conversations)
