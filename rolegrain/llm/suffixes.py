"""Removal of repeated byte strings: every byte covered by a string of ``length`` bytes that also starts elsewhere.

Strings of ``length`` bytes are compared where they can be equal, and nowhere else:

1. *Anchors.* Of the grams inside a string the one with the least hash is its anchor. Equal strings have equal anchors at
   equal places. Consecutive strings with the same anchor form a segment of less than two lengths. Equal segments of one
   text (a phrase said over and over) are one row with all their places.
2. Segments whose anchor occurs once are done. Equal segments are counted: all strings of a segment that occurs twice are
   repeated. One segment of each kind goes on, if its anchor has segments of another kind.
3. *Interval expansion.* Such segments are laid out by anchor. A task joins them to one text with distinct separators, sorts
   its suffixes, takes the Burrows-Wheeler transform and expands suffix intervals backwards, breadth first: intervals of
   strings of 0, 1, 2, ... bytes. A boundary between suffixes that is first seen after ``v`` bytes has a common prefix of
   ``v`` bytes. The expansion stops at ``length``; boundaries that were not seen by then have a common prefix of at least
   ``length`` bytes, and the suffixes beside them start a repeated string.
4. An anchor with more than ``GROUP`` kinds of segments (a passage that very many documents share) is not gathered in one
   task: its segments are cut to blocks of strings, keyed by the bytes that all strings of a block share, which takes the
   same steps again; blocks that are still too many are compared string by string in an aggregate.
5. Repeated strings are joined with the segments' places, one row per text and kind, and cut out of their documents.

Passages of so many words take the same steps on texts in which every word is a code of ``CODE`` letters, so their number of
bytes does not matter. Words are maximal runs of characters other than ASCII white space, compared as they are written.

Defined cases: a null text is an empty one; texts shorter than ``length`` lose nothing; of equal rows each is a place of its
own, so all lose their repeated bytes; ids may be null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .columns import restored, shielded
from .hashing import SpanHash, lean, runs, sliding_argmin

LENGTH = 400
#: Kinds of segments of one anchor that a task takes at most.
GROUP = 1000
#: Bytes that one transform takes, about.
TEXT = 1 << 19
#: Strings per block of a divided segment.
BLOCK = 25

#: Letters of a word's code.
CODE = 8

KEY = ["doc_id", "text_hash"]
#: A word.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; ``text`` are integers whose last is unique.

    Only suffixes that are still tied are sorted again, in the order they have, which a merge sort uses.
    """
    n = len(text)
    symbols, symbol = np.unique(text, return_inverse=True)
    step = max(1, min(8, int(61 / np.log2(len(symbols) + 1))))  # so many symbols fit in one key
    padded = np.concatenate([symbol + 1, np.zeros(step - 1, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = key * (len(symbols) + 1) + padded[i : i + n]
    order = np.argsort(key)
    sorted_key = key[order]
    place = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
    rank = np.empty(n, np.int64)
    rank[order] = place
    while place[-1] < n - 1:
        tied = np.zeros(n, bool)
        same = place[1:] == place[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        items = order[at]
        ahead = np.where(items + step < n, rank[np.minimum(items + step, n - 1)] + 1, 0)
        pair = place[at] * (n + 1) + ahead
        again = np.argsort(pair, kind="stable")
        order[at], pair = items[again], pair[again]
        first = np.ones(n, bool)
        first[at[1:]] = pair[1:] != pair[:-1]
        place = np.cumsum(first) - 1
        rank[order] = place
        step *= 2
    return order


def long_boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For i: have the suffixes i - 1 and i in order a common prefix of at least ``length``? By interval expansion."""
    n = len(text)
    last = text[order - 1]  # the transform: what precedes each suffix
    place = np.argsort(last, kind="stable")
    back = np.empty(n, np.int64)
    back[place] = np.arange(n)
    same = last[place][1:] == last[place][:-1]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[place[:-1][same]] = place[1:][same]
    preceding[place[1:][same]] = place[:-1][same]
    unseen = np.ones(n + 1, bool)
    unseen[[0, n]] = False
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        # All places of all intervals, with their interval's ends.
        sizes = high - low
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
        lower, upper = np.sort(back[at[preceding[at] < np.repeat(low, sizes)]]), np.sort(back[at[following[at] >= np.repeat(high, sizes)]]) + 1
        new = unseen[upper]
        low, high = lower[new], upper[new]
        if not len(low):
            break
        unseen[high] = False
    return unseen[:n]


def repeated_starts(segments: list[bytes], length: int) -> list[np.ndarray]:
    """Per segment: which of its strings of ``length`` bytes start at another place of these segments, too?"""
    sizes = np.array([len(s) for s in segments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.empty(starts[-1], np.int64)
    bytes_at = np.ones(starts[-1], bool)
    bytes_at[starts[1:] - 1] = False
    text[bytes_at] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + len(segments)
    text[starts[1:] - 1] = np.arange(len(segments))
    order = suffix_order(text)
    deep = long_boundaries(text, order, length)
    mark = np.zeros(len(text), bool)
    mark[order[deep]] = True
    mark[order[np.flatnonzero(deep) - 1]] = True
    return [mark[a : a + max(0, n - length + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=False)]


def spans_of(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def segments_of(data: np.ndarray, length: int, gram: int, spans: SpanHash) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of one text: start, number of strings, anchor's place in the segment, anchor's hash; in bounded pieces."""
    window, piece = length - gram + 1, 1 << 20
    for at in range(0, len(data) - length + 1, piece):
        part = data[at : at + piece + length - 1]
        grams = spans.grams(spans.sums(part), gram)
        anchor = sliding_argmin(grams, window)
        start = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(start, append=len(anchor))
        yield start + at, count, anchor[start] - start, grams[anchor[start]]


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text``: rows with equal keys have equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All segments, the equal ones of a text (of a piece of 1 MB, if it is longer) in one row: their document, ``starts`` and how
    many, ``places``; number of strings ``count``, ``lead`` before the anchor, ``anchor``, ``kind``."""
    schema = "doc_id long, text_hash long, starts array<long>, places int, count int, lead int, anchor long, kind long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = SpanHash()
        for batch in batches:
            ids, hashes, texts = batch.columns
            for low, high in runs(pa.compute.binary_length(texts).to_pylist(), 1 << 22):
                rows = []
                for i in range(low, high):
                    text = texts[i].as_py().encode("utf-8", "surrogatepass")
                    for start, count, lead, anchor in segments_of(np.frombuffer(text, np.uint8), length, gram, spans):
                        ends = (start + count + (length - 1)).tolist()
                        kind = np.fromiter([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(start.tolist(), ends, strict=True)], np.uint64, len(start))
                        # The anchor's place is part of a segment's kind.
                        kind ^= lead.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        order = np.lexsort((start, kind, anchor))
                        new = np.ones(len(order), bool)
                        new[1:] = (np.diff(anchor[order]) != 0) | (np.diff(kind[order]) != 0)
                        first = order[new]
                        places = np.diff(np.flatnonzero(new), append=len(order))
                        rows.append((np.full(len(first), i), places, count[first], lead[first], anchor[first], kind[first], start[order]))
                if rows:
                    *columns, start = (np.concatenate(x) for x in zip(*rows, strict=True))
                    owner, places, count, lead, anchor, kind = columns
                    starts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(places)]), pa.int32()), pa.array(start))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(owner)), hashes.take(pa.array(owner)), starts, *(pa.array(c.astype(np.int32)) for c in (places, count, lead)),
                         pa.array(anchor.view(np.int64)), pa.array(kind.view(np.int64))],
                        ["doc_id", "text_hash", "starts", "places", "count", "lead", "anchor", "kind"],
                    )

    return keyed(docs).filter(F.octet_length("text") >= length).mapInArrow(lean(work), schema)


def expand(groups: DataFrame, length: int) -> DataFrame:
    """``anchor, kind, first, last``: runs of repeated strings (numbered in their segment) of ``anchor, kind, body`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple] = []

        def solve(rows: list[tuple]) -> pa.RecordBatch:
            out: list[tuple] = []
            for (anchor, kind, _), mark in zip(rows, repeated_starts([r[2] for r in rows], length), strict=True):
                out += [(anchor, kind, a, b - 1) for a, b in zip(*(x.tolist() for x in spans_of(mark)), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["anchor", "kind", "first", "last"])

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rest and row[:2] == rest[-1][:2]:
                    continue  # the same segment of an equal row
                if size >= TEXT and row[0] != rest[-1][0]:
                    yield solve(rest)
                    rest, size = [], 0
                rest.append(row)
                size += len(row[2])
        if rest:
            yield solve(rest)

    laid = groups.select("anchor", "kind", "body").repartition("anchor").sortWithinPartitions("anchor", "kind")
    return laid.mapInArrow(lean(work), "anchor long, kind long, first int, last int")


def divided(segments: DataFrame, length: int, size: int) -> DataFrame:
    """Blocks of at most ``size`` strings: the segment's ``anchor, kind``, ``shift`` of the block's first string, and the
    block's own ``part`` (hash of the bytes that all its strings share), ``part_kind``, ``count``, ``body``."""
    schema = "anchor long, kind long, shift int, part long, part_kind long, count int, body binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for anchor, kind, lead, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                strings = len(body) - length + 1
                for block in range((lead - strings + 1) // size, lead // size + 1):
                    # Strings whose anchor lies block * size ... + size - 1 bytes after their start.
                    first, last = max(0, lead - block * size - size + 1), min(strings - 1, lead - block * size)
                    if first <= last:
                        shared = body[lead - block * size : lead - block * size - size + 1 + length]
                        own = body[first : last + length]
                        seed = (anchor ^ (block * 0x9E3779B9)) & ((1 << 63) - 1)
                        out.append((anchor, kind, first, xxhash.xxh3_64_intdigest(shared, seed), xxhash.xxh3_64_intdigest(own, seed) ^ (lead - first), last - first + 1, own))
            columns = list(zip(*out, strict=True)) or [()] * 7
            hashes = [np.array(columns[i], np.uint64).view(np.int64) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(hashes[0]), pa.array(hashes[1]),
                 pa.array(columns[5], pa.int32()), pa.array(columns[6], pa.binary())],
                ["anchor", "kind", "shift", "part", "part_kind", "count", "body"],
            )

    return segments.select("anchor", "kind", "lead", "body").mapInArrow(lean(work), schema)


def repeats(found: DataFrame, docs: DataFrame, length: int, group: int) -> tuple[DataFrame, list[DataFrame]]:
    """``anchor, kind, first, last``: repeated strings of each kind of segment of ``found``; and the stored tables it reads."""
    place = F.struct(*KEY, F.col("starts")[0].alias("start"), "count", "lead")
    kinds = stored(found.groupBy("anchor", "kind").agg(F.sum("places").alias("n"), F.min(place).alias("at")))
    whole = kinds.filter("n > 1").select("anchor", "kind", F.lit(0).alias("first"), (F.col("at.count") - 1).alias("last"))
    many = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    wanted = kinds.join(many, "anchor").select("anchor", "kind", "n", "kinds", "at.*")
    asked = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "kind", "kinds", "start", "count", "lead")).alias("asked"))
    requests = stored(asked)
    asked = requests.withColumnsRenamed({k: f"{k}_" for k in KEY})
    texts = keyed(docs)
    # A key is asked for once; rows with equal keys all answer, which the grouping below undoes.
    bodies = texts.join(asked, (texts["text_hash"] == asked["text_hash_"]) & texts["doc_id"].eqNullSafe(asked["doc_id_"]))
    data = F.encode("text", "utf-8")
    answers = F.transform("asked", lambda s: s.withField("body", F.substring(data, (s["start"] + 1).cast("int"), s["count"] + (length - 1))))
    bodies = stored(bodies.select(F.explode(answers).alias("s")).select("s.*"))
    few = expand(bodies.filter(F.col("kinds") <= group), length)
    blocks = stored(divided(bodies.filter(F.col("kinds") > group).dropDuplicates(["anchor", "kind"]), length, BLOCK))
    parts = stored(blocks.groupBy("part", "part_kind").agg(F.count("*").alias("n"), F.first("count").alias("count"), F.first("body").alias("body")))
    shared = stored(parts.groupBy("part").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    asked_parts = parts.join(shared, "part")
    inside = expand(asked_parts.filter(F.col("kinds") <= group).select(F.col("part").alias("anchor"), F.col("part_kind").alias("kind"), "body"), length)
    single = asked_parts.filter(F.col("kinds") > group).select(
        "part", "part_kind", "n", F.posexplode(F.expr(f"transform(sequence(1, count), i -> substring(body, i, {length}))")).alias("first", "string"),
    ).select("part", "part_kind", "n", "first", F.xxhash64("string").alias("string"), F.xxhash64(F.lit(1), "string").alias("again"))
    twice = stored(single.groupBy("string", "again").agg(F.sum("n").alias("places"), F.count("*").alias("rows")).filter("places > 1").select("string", "again"))
    strings = single.join(twice, ["string", "again"]).select("part", "part_kind", "first", F.col("first").alias("last"))
    from_parts = stored(
        inside.select(F.col("anchor").alias("part"), F.col("kind").alias("part_kind"), "first", "last")
        .union(strings.select("part", "part_kind", "first", "last"))
        .union(parts.filter("n > 1").select("part", "part_kind", F.lit(0), F.col("count") - 1))
    )
    large = blocks.join(from_parts, ["part", "part_kind"]).select("anchor", "kind", (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last"))
    discard(many, requests, shared, twice)
    return whole.union(few).union(large), [kinds, bodies, blocks, parts, from_parts]


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int | None = None, group: int = GROUP) -> DataFrame:
    """``doc_id, text_hash, spans``: byte ranges that start at a repeated string, unordered and overlapping; a stored table."""
    every = stored(anchored(docs, length, gram or length // 2))
    often = stored(every.groupBy("anchor").agg(F.sum("places").alias("n")).filter("n > 1").select("anchor"))
    found = stored(every.join(often, "anchor", "left_semi"))
    discard(every, often)
    strings, spent = repeats(found, docs, length, group)
    runs_ = stored(strings.groupBy("anchor", "kind").agg(F.collect_set(F.struct("first", "last")).alias("runs")))
    discard(*spent)
    span = lambda s, r: F.struct((s + r["first"]).alias("low"), (s + r["last"] + length).alias("high"))
    spans = F.flatten(F.transform("starts", lambda s: F.transform("runs", lambda r: span(s, r))))
    hits = found.join(runs_, ["anchor", "kind"]).select(*KEY, spans.alias("spans"))
    ranges = stored(hits.groupBy(*KEY).agg(F.flatten(F.collect_set("spans")).alias("spans")))
    discard(found, runs_)
    return ranges


def merged(spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.array(sorted((s["low"], s["high"]) for s in spans), np.int64)
    reach = np.maximum.accumulate(both[:, 1])
    first = np.flatnonzero(np.concatenate([[True], both[1:, 0] > reach[:-1]]))
    return both[first, 0], reach[np.concatenate([first[1:] - 1, [len(both) - 1]])]


def coded(text: str | None) -> str:
    """``CODE`` letters per word; only the first is upper case."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    digests = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))
    letters = ((digests[:, None] >> np.arange(0, 4 * CODE, 4, dtype=np.uint32)) & np.uint32(15)).astype(np.uint8) + np.uint8(ord("a"))
    letters[:, 0] -= np.uint8(32)
    return letters.tobytes().decode("ascii")


def removed_words(docs: DataFrame, words: int, group: int = GROUP) -> DataFrame:
    """``doc_id, text_hash, word_spans``: as ``removed_spans``, for passages of ``words`` words and in numbers of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coded(x.as_py()) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    texts = keyed(docs).withColumn("row", F.xxhash64(*KEY))
    length = words * CODE
    found = removed_spans(texts.select("row", "text").mapInArrow(lean(work), "doc_id long, text string"), length, None, group)
    # Only strings that start with a word count.
    whole = F.transform("spans", lambda s: F.struct(F.ceil(s["low"] / CODE).alias("low"), (F.floor((s["high"] - length) / CODE) + words).alias("high")))
    found = found.select(F.col("doc_id").alias("row"), F.filter(whole, lambda s: s["high"] - s["low"] >= words).alias("word_spans"))
    return texts.select("row", *KEY).distinct().join(found, "row").select(*KEY, "word_spans")


def with_spans(docs: DataFrame, length: int, group: int, words: int | None = None) -> DataFrame:
    """``docs`` with the byte ranges to remove in ``spans``, and the ranges of words in ``word_spans`` if ``words`` are given."""
    spans = removed_spans(docs, length, None, group)
    if words:
        passages = removed_words(docs, words, group).select(*KEY, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), "word_spans")
        both = spans.select(*KEY, "spans", F.lit(None).cast(passages.schema["word_spans"].dataType).alias("word_spans")).union(passages)
        spans = stored(both.groupBy(*KEY).agg(*[F.first(c, True).alias(c) for c in ("spans", "word_spans")]))
    spans = spans.withColumnsRenamed({k: f"{k}_" for k in KEY})
    texts = docs.withColumn("text_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = (texts["text_hash"] == spans["text_hash_"]) & texts["doc_id"].cast("long").eqNullSafe(spans["doc_id_"])
    return texts.join(spans, same, "left").drop("text_hash", "text_hash_", "doc_id_")


def in_bytes(text: bytes, word_spans: list[dict] | None) -> list[dict]:
    """Ranges of words as ranges of bytes, each with the white space behind it."""
    if not word_spans:
        return []
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    return [{"low": starts[s["low"]], "high": starts[s["high"]]} for s in word_spans]


def apply_cut(joined: DataFrame, keep: list[str], body: bool) -> DataFrame:
    """Cuts ``spans`` out of ``text``; ``keep`` columns come along, ``body`` adds the remaining text."""
    fields = [f for f in joined.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + ["kept string"] * body)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, own, *passages in zip(*batch.columns[len(fields) :], strict=True):
                text = (text.as_py() or "").encode("utf-8", "surrogatepass")
                low, high = merged((own.as_py() or []) + [s for p in passages for s in in_bytes(text, p.as_py())])
                edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(rest), len(low), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)][: 5 if body else 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *made], [f.name for f in fields] + ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(made)])

    ranges = [c for c in ("spans", "word_spans") if c in joined.columns]
    return joined.select(*[f.name for f in fields], F.col("text").cast("string"), *ranges).mapInArrow(lean(work), schema)


def remove(docs: DataFrame, keep: list[str], length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``keep`` columns (other than ``text``) with counts and digest of what remains of every text."""
    narrow = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    return apply_cut(with_spans(narrow, length, group), keep, False)


def cut_texts(docs: DataFrame, length: int = LENGTH, group: int = GROUP, words: int | None = None) -> DataFrame:
    """``docs`` with what remains of every text, and ``n_chars`` (if there) of that; cut characters go as a whole.

    ``words`` also cuts every passage of so many words that starts elsewhere too.
    """
    needed = ["doc_id", "text"]
    safe = shielded(docs, needed)
    done = apply_cut(with_spans(safe, length, group, words), [c for c in safe.columns if c != "text"], True).withColumnRenamed("kept", "text")
    out = restored(done, docs, needed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
