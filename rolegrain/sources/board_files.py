"""Landed board snapshots of any size: one JSON document per file, cut into postings by many tasks.

A document ``{..., "jobs": [{...}, ...], ...}`` has no line breaks to split at, and whether a bracket counts depends on every
quote before it.  So it is read in three steps, none of which needs a file in one task:

1. The file is read in byte ranges, as records that end at ``{``.  Each range is joined to chunks.  A chunk carries how it
   changes the reading state (inside a string or not, nesting depth) for both states in which its range may begin.
2. The states of ranges, a few numbers each, are chained in file order, which tells the true state at every chunk.
3. Every chunk is cut on its own: whole postings, pieces of postings that cross a chunk's edge, and what is left outside the
   array, which makes up the document's own fields.  Pieces are put together by their place in the file.

Postings and the fetch status come from this one parse.  A file that does not hold exactly one whole document (cut short while
it landed, for example) counts as a failed fetch and gives no postings, so that nothing looks closed for it.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import give_back
from ..schemas import BOARD_HEADER, BOARD_JOB
from ..session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of one chunk, about.
CHUNK = 1 << 20
PLACE = ["file", "block", "chunk"]
_JOBS = re.compile(rb'"jobs"\s*:\s*\Z')


def real_quotes(data: np.ndarray) -> np.ndarray:
    """Positions of the quotes that are not escaped."""
    found = np.flatnonzero(data == ord('"'))
    if not (data == ord("\\")).any():
        return found
    other = np.flatnonzero(data != ord("\\"))
    before = np.searchsorted(other, found) - 1
    run = found - 1 - np.where(before >= 0, other[before], -1)
    return found[run % 2 == 0]


def brackets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of brackets, +1 or -1 for each, and whether an odd number of quotes precedes it."""
    opening = (data == ord("{")) | (data == ord("["))
    at = np.flatnonzero(opening | (data == ord("}")) | (data == ord("]")))
    return at, np.where(opening[at], 1, -1), np.searchsorted(real_quotes(data), at) % 2 == 1


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Chunks of every byte range, with the state before and after them for a range that begins outside or inside a string."""
    place: tuple[str, int] | None = None
    parts: list[str] = []
    size = number = 0
    state = (0, 0, 0)  # odd quotes so far, depth if the range began outside, depth if it began inside a string

    def close() -> pa.RecordBatch:
        nonlocal parts, size, number, state
        text = "".join(parts)
        data = np.frombuffer(text.encode(), np.uint8)
        at, step, odd = brackets(data)
        flipped, outside, inside = state
        # A bracket counts where the quotes of the range before it leave the reader outside a string.
        quoted = odd ^ bool(flipped)
        after = ((flipped + len(real_quotes(data))) % 2, outside + int(step[~quoted].sum()), inside + int(step[quoted].sum()))
        row = (*place, number, text, *state, *after)
        parts, size, number, state = [], 0, number + 1, after
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], _CHUNK_NAMES)

    for batch in batches:
        for value, file, block in (tuple(v.as_py() for v in row) for row in zip(*batch.columns, strict=True)):
            if (file, block) != place:
                if parts:
                    yield close()
                place, number, state = (file, block), 0, (0, 0, 0)
                parts, size = [value if block == 0 else "{" + value], len(value)
                continue
            if size >= limit:
                yield close()
            parts.append("{" + value)
            size += len(value)
    if parts:
        yield close()


_CHUNK_NAMES = [*PLACE, "text", "flipped", "outside", "inside", "flipped_after", "outside_after", "inside_after"]
_CHUNK_SCHEMA = "file string, block long, chunk long, text string, " + ", ".join(f"{c} long" for c in _CHUNK_NAMES[4:])


def _cut(data: bytes, quoted: bool, depth: int) -> Iterator[tuple[str, str | None, bool | None]]:
    """``(kind, text, flag)`` of one chunk: see ``cut_chunks``."""
    codes = np.frombuffer(data, np.uint8)
    at, step, odd = brackets(codes)
    real = odd == quoted
    at, step = at[real], step[real]
    after = depth + np.cumsum(step)
    before = after - step
    letter = codes[at]
    tops = np.flatnonzero((before == 1) & (step > 0))
    is_jobs = [letter[i] == ord("[") and _JOBS.search(data[max(0, at[i] - 4096) : at[i]]) is not None for i in tops]
    starts, ends = at[(before == 2) & (letter == ord("{"))], at[(after == 2) & (letter == ord("}"))]
    if depth >= 3:  # the chunk begins inside an entry
        yield "head", data[: ends[0] + 1 if len(ends) else len(data)].decode(), None
        ends = ends[1:]
    owner = np.searchsorted(at[tops], starts) - 1
    for i, (start, top) in enumerate(zip(starts.tolist(), owner.tolist(), strict=True)):
        if top >= 0 and not is_jobs[top]:
            continue
        whole = i < len(ends)
        yield "whole" if whole else "tail", data[start : ends[i] + 1 if whole else len(data)].decode(), top < 0
    if len(tops):
        yield "array", None, bool(is_jobs[-1])
    # Characters outside all containers of the document, its brackets included.
    level = np.repeat(np.concatenate([[depth], after]), np.diff(np.concatenate([[0], at, [len(data)]])))
    level[at] = np.minimum(before, after)
    own = codes[level <= 1].tobytes().decode()
    if own.strip():
        yield "own", own, None
    for _ in range(int(((before == 0) & (step > 0)).sum())):
        yield "document", None, None


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``cut_chunks``. A chunk is large, so only one of a batch is a Python object at a time."""
    names = ["kind", *PLACE, "text", "flag"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    try:
        for batch in batches:
            for file, block, chunk, text, quoted, depth in (tuple(v.as_py() for v in row) for row in zip(*batch.columns, strict=True)):
                rows = [(kind, file, block, chunk, own, flag) for kind, own, flag in _cut(text.encode(), bool(quoted), depth)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    finally:
        give_back()


def cut_chunks(chunks: DataFrame) -> DataFrame:
    """Rows ``kind, file, block, chunk, text, flag``.

    ``whole`` and ``tail`` (an entry that does not end here) have the flag "the array began before this chunk"; ``head`` goes on
    with an earlier entry; ``array`` tells whether the last top-level container that begins here is ``jobs``; ``own`` is
    text of the document itself; ``document`` stands for each document that begins here.
    """
    return chunks.select(*PLACE, "text", "quoted", "depth").mapInArrow(_entries, "kind string, file string, block long, chunk long, text string, flag boolean")


def with_states(chunks: DataFrame) -> DataFrame:
    """Chunks with the true state at their start: ``quoted`` and ``depth``."""
    totals = chunks.groupBy("file", "block").agg(F.max_by(F.struct("flipped_after", "outside_after", "inside_after"), "chunk").alias("t"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    began = totals.withColumn("began", F.coalesce(F.sum("t.flipped_after").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("began") == 1, F.col("t.inside_after")).otherwise(F.col("t.outside_after"))
    began = began.withColumn("base", F.coalesce(F.sum(change).over(earlier), F.lit(0)))
    # One short row per byte range: the driver plans each of them as a task, so the table is no larger than its own list.
    states = F.broadcast(stored(began.select("file", "block", "began", "base")))
    joined = chunks.join(states, ["file", "block"])
    inside = F.col("began") == 1
    return joined.withColumns({
        "quoted": (F.col("flipped") + F.col("began")) % 2, "depth": F.col("base") + F.when(inside, F.col("inside")).otherwise(F.col("outside")),
        "quoted_after": (F.col("flipped_after") + F.col("began")) % 2,
        "depth_after": F.col("base") + F.when(inside, F.col("inside_after")).otherwise(F.col("outside_after")),
    })


def entries(spark: SparkSession, path: str | list[str], chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``file, text`` per entry of the ``jobs`` arrays, and ``file, own, damaged`` per file, from one parse."""
    records = spark.read.option("lineSep", "{").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    chunks = with_states(stored(records.mapInArrow(lambda batches: _chunks(batches, chunk), _CHUNK_SCHEMA)))
    cut = stored(cut_chunks(chunks))
    # The array a chunk begins in is the last one that began before it.
    arrays = cut.filter("kind = 'array'").select(*PLACE, F.col("flag").alias("jobs"))
    earlier = Window.partitionBy("file").orderBy("block", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    inherited = chunks.select(*PLACE).join(arrays, PLACE, "left").withColumn("jobs", F.last("jobs", ignorenulls=True).over(earlier))
    foreign = stored(inherited.filter(~F.coalesce("jobs", F.lit(False))).select(*PLACE).withColumn("foreign", F.lit(True)))
    marked = cut.filter("kind in ('whole', 'tail', 'head')").join(foreign, PLACE, "left")
    marked = marked.withColumn("foreign", F.coalesce(F.col("foreign") & F.col("flag"), F.lit(False)))
    whole = marked.filter("kind = 'whole' and not foreign").select("file", "text")
    # Pieces are numbered by places alone; their texts meet in groups of one entry each.
    pieces = marked.filter("kind <> 'whole'").withColumn("rank", (F.col("kind") == "tail").cast("int"))
    running = Window.partitionBy("file").orderBy("block", "chunk", "rank").rowsBetween(Window.unboundedPreceding, 0)
    numbered = pieces.select(*PLACE, "rank").withColumn("entry", F.sum("rank").over(running))
    ordered = F.array_sort(F.collect_list(F.struct("block", "chunk", "rank", "text")))
    joined = pieces.join(numbered, [*PLACE, "rank"]).groupBy("file", "entry").agg(F.max("foreign").alias("foreign"), ordered.alias("parts"))
    joined = joined.filter(~F.col("foreign")).select("file", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))

    last = chunks.groupBy("file").agg(F.max_by(F.struct("quoted_after", "depth_after"), F.struct("block", "chunk")).alias("end"))
    count = cut.filter("kind = 'document'").groupBy("file").agg(F.count("*").alias("documents"))
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "chunk", "text"))), lambda p: p["text"]), "")
    owns = cut.filter("kind = 'own'").groupBy("file").agg(own.alias("own"))
    files = last.join(count, "file", "left").join(owns, "file", "left")
    complete = (F.col("end.quoted_after") == 0) & (F.col("end.depth_after") == 0) & (F.coalesce("documents", F.lit(0)) == 1)
    return whole.union(joined), stored(files.select("file", "own", (~complete).alias("damaged")))


def read_boards(spark: SparkSession, path: str | list[str], chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Posting rows and ``board_token, fetch_status`` of landed snapshot files, from one parse."""
    from .snapshots import posting_columns, status_of

    jobs, files = entries(spark, path, chunk)
    headers = files.withColumn("doc", F.from_json("own", BOARD_HEADER)).select("file", "damaged", "doc.*")
    # One short row per file, which the driver has listed to read them.
    found = jobs.join(F.broadcast(headers.filter(~F.col("damaged")).withColumnRenamed("company", "_company")), "file")
    postings = posting_columns(found.withColumn("job", F.from_json("text", BOARD_JOB)))
    counts = jobs.groupBy("file").agg(F.count("*").alias("jobs"))
    failed = F.coalesce(F.col("fetch_status") == "FETCH_FAILED", F.lit(False)) | F.col("damaged")
    return postings, status_of(headers.join(counts, "file", "left"), failed, F.col("jobs"))
