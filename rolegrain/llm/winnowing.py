"""Document fingerprints by winnowing.

Every ``gram`` consecutive code points have a rolling hash; of every ``window`` consecutive hashes the least is chosen, the
rightmost of equal ones, and kept with its position. So two texts that share ``window + gram - 1`` code points share a
chosen hash, and nothing shorter than ``gram`` is noticed. A text with fewer hashes than a window keeps its least hash; one
shorter than a gram keeps the hash of the whole text; an empty text keeps none. The likeness of two fingerprints is the
Jaccard similarity of their sets of hashes; two empty ones are alike (1.0), an empty one is like no other (0.0).

Defined cases: a null text is an empty one; equal rows have equal fingerprints; a null id comes last in descending order;
rows with equal ids follow one another in the order of their texts' hashes; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import SpanHash, mix, sliding_argmin

GRAM, WINDOW = 20, 30


class Winnower:
    def __init__(self, gram: int = GRAM, window: int = WINDOW) -> None:
        self.gram, self.window, self.hash = gram, window, SpanHash()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Chosen hashes and their positions, in order of position."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = self.hash.running(mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
        grams = self.hash.grams(sums, min(self.gram, len(points)))
        least = sliding_argmin(grams, min(self.window, len(grams)), rightmost=True)
        places = least[np.flatnonzero(np.diff(least, prepend=-1))]
        return grams[places], places


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets of hashes."""
    if not len(one) and not len(other):
        return 1.0
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both)


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """The fingerprint as a short string: equal for equal hashes at equal positions."""
    return xxhash.xxh3_128_hexdigest(hashes.tobytes() + places.tobytes())


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``hashes`` and ``positions`` of every text's fingerprint."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(gram, window)
        for batch in batches:
            found = [winnow(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                ["doc_id", "hashes", "positions"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, hashes array<long>, positions array<long>")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, bucket, guest``, laid out so that a row is followed by that with the next smaller id.

    Buckets are ranges of ids; the first row of a bucket is also sent, as a guest, to the end of the bucket before it, and
    that of the first to the end of the last. One shuffle; the driver sees one id per bucket.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rank = F.coalesce("doc_id", F.lit(-(1 << 63))).cast("double")
    marks = rows.select(F.percentile_approx(rank, [i / buckets for i in range(1, buckets)] or [0.5], 10 * buckets)).first()[0]
    splits = [-float("inf"), *sorted(set(marks or [0.0])), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="rank", outputCol="bucket").transform(rows.withColumn("rank", rank))
    placed = placed.withColumn("bucket", F.col("bucket").cast("int"))
    heads = sorted(placed.select("bucket", "rank").groupBy("bucket").agg(F.max("rank").alias("rank")).collect(), reverse=True)
    guests = [(int(heads[i - 1]["bucket"]), float(h["rank"])) for i, h in enumerate(heads)]
    table = spark.createDataFrame(guests, "host int, at double")  # one row per bucket
    sent = placed.join(F.broadcast(table), placed["rank"] == table["at"], "left").select(
        "doc_id", "text", F.explode(F.filter(F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")))), lambda x: x.isNotNull())).alias("to"),
    ).select("doc_id", "text", "to.bucket", "to.guest")
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))


def compare_edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, part: int = 3) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the first code points of the next document replace the last.

    A ``part``-th of the code points (rounded down) is replaced by as many, or all, of the next document in descending order
    of ids (after the last: the first).
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Winnower(gram, window)
        previous, done = None, []

        def pair(row: tuple, follower: tuple) -> None:
            doc_id, text, own, places, _, _ = row
            cut = len(text) - len(text) // part
            edited = text[:cut] + follower[1][: len(text) - cut]
            hashes, at = winnow(edited)
            mine = np.unique(own)
            done.append((
                doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(own, places),
                digest(hashes, at), likeness(mine, np.unique(hashes)), likeness(mine, np.unique(follower[2])), len(own),
            ))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text, bucket, guest in zip(*(batch.column(i) for i in range(4)), strict=True):
                if previous is not None and previous[5] and guest.as_py():
                    continue  # the bucket's first guest is enough
                text = text.as_py() or ""
                row = (doc_id.as_py(), text, *winnow(text), bucket.as_py(), guest.as_py())
                if previous is not None and previous[4] == row[4] and not previous[5]:
                    pair(previous, row)
                previous = row
            if done:
                yield out()
        yield out()

    return with_next(docs).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long")
