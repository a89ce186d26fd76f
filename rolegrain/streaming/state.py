"""Posting state that a stream of landed snapshots keeps up to date, a few buckets at a time.

State lies in buckets by board, as snapshots arrive by board.  A batch reads the buckets of its boards, merges, and writes
them as a version of its own, ``batch=<number>/bucket=<number>``; all other buckets stay where they are.  A version counts once
Spark has marked it as finished, and a batch only sees versions before its own, so a batch that is run again after a failure
finds what it found the first time and replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..operators import lifecycle as J
from ..sources.board_files import read_boards

#: Buckets of a state, and files per bucket that may be written side by side.
BUCKETS, PARTS = 256, 8
#: Columns that a state needs beside the payload of postings.
STAMPS = "last_seen_at timestamp, is_active boolean, updated_at timestamp, as_of timestamp"


class BucketedState:
    """A table in buckets by ``by`` below ``root``; bucket and version numbers are folder names."""

    def __init__(self, spark: SparkSession, root: str, schema: str, by: Sequence[str] = ("board_token",), buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.by, self.buckets = spark, root.rstrip("/"), list(by), buckets
        self.schema = T._parse_datatype_string(schema)

    def _folders(self, path: str) -> dict[str, str]:
        """Names and paths of the folders directly below a path of any file system that Spark reads."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.listStatus(place) if files.exists(place) else []
        return {s.getPath().getName(): s.getPath().toString() for s in found}

    def versions(self, before: int | None = None) -> dict[int, str]:
        """Bucket -> folder of its newest finished version, of batches before ``before`` if given."""
        newest: dict[int, str] = {}
        batches = sorted((int(name.split("=")[1]), path) for name, path in self._folders(self.root).items() if name.startswith("batch="))
        for number, path in batches:
            inside = self._folders(path)
            if (before is None or number < before) and "_SUCCESS" in inside:
                newest.update({int(n.split("=")[1]): p for n, p in inside.items() if n.startswith("bucket=")})
        return newest

    def read(self, buckets: Sequence[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of some or all buckets."""
        chosen = [path for bucket, path in sorted(self.versions(before).items()) if buckets is None or bucket in buckets]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*chosen)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def update(self, batch: int, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets that ``changes`` touch by ``merge(their old rows, changes)``; returns the buckets."""
        touched = sorted(r[0] for r in changes.select(self.bucket()).distinct().collect())  # at most one row per bucket
        rows = merge(self.read(touched, before=batch), changes).select(*self.schema.names).withColumn("bucket", self.bucket())
        # A bucket is written by several tasks, so a board that holds most postings is no single task's.
        part = F.pmod(F.xxhash64(*self.schema.names), F.lit(PARTS))
        rows.repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/batch={batch}")
        return touched

    def drop_replaced(self) -> int:
        """Deletes versions of buckets that newer ones have replaced; returns how many. Not while a batch is running."""
        current = set(self.versions().values())
        gone = 0
        for name, path in self._folders(self.root).items():
            if not name.startswith("batch="):
                continue
            for bucket, folder in self._folders(path).items():
                if bucket.startswith("bucket=") and folder not in current:
                    place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                    gone += bool(place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True))
        return gone


def merge_snapshots(state: DataFrame, postings: DataFrame) -> DataFrame:
    """State after full snapshots of some boards: postings upserted, those that are gone closed.

    ``postings`` may hold several snapshots of a board, told apart by ``fetched_at``.  A snapshot that is not newer than the
    last one applied to its board is late: it neither reopens nor closes anything.  Of the others all postings become known;
    the newest decides what is live.  Stamps are the snapshots' own times, so merging again gives the same state.  A row
    without a time, board or id is ignored.
    """
    board, key = C.owned(["board_token"], state, postings), C.owned(J.KEY, state, postings)
    applied = state.groupBy(*board).agg(F.max("as_of").alias("_applied"))
    known = postings.withColumn("posting_id", J.posting_key(F.col("posting_id"))).filter(
        F.col("posting_id").isNotNull() & F.col("board_token").isNotNull() & F.col("fetched_at").isNotNull()
    )
    fresh = known.join(applied, board, "left").filter(F.col("_applied").isNull() | (F.col("fetched_at") > F.col("_applied"))).drop("_applied")
    scanned = fresh.groupBy(*board).agg(F.max("fetched_at").alias("_scanned"))
    fresh = C.last_per_key(fresh, key)
    payload = [c for c in state.columns if c not in (*key, "last_seen_at", "is_active", "updated_at", "as_of")]
    seen = fresh.select(*key, "fetched_at", *[F.col(c).alias(f"_new_{c}") for c in payload])
    merged = state.join(seen, key, "full_outer")
    met = F.col("fetched_at").isNotNull()
    # Boards with a fresh snapshot: rows that it does not hold are closed.
    merged = merged.join(scanned, board, "left").withColumn("_live", met & (F.col("fetched_at") == F.col("_scanned")))
    was_active = F.coalesce("is_active", F.lit(True)) & F.col("as_of").isNotNull()
    closed = F.col("_scanned").isNotNull() & ~F.coalesce("_live", F.lit(False))
    touched = met | (closed & was_active)
    return merged.select(
        *key, *[F.when(met, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in payload],
        F.when(met, F.col("fetched_at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(closed, F.lit(False)).when(met, F.lit(True)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(touched, F.col("_scanned")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.coalesce("_scanned", "as_of").alias("as_of"),
    )


def once_per_fetch(postings: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of posting rows without those that the same fetch brought before, within ``delay`` of the newest fetch."""
    key = C.owned([*J.KEY, "fetched_at"], postings)
    return postings.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(key)


def stream_state(spark: SparkSession, path: str, state: BucketedState, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Merges every snapshot file that has landed below ``path`` into ``state``, each once, and stops.

    The stream carries file names only; the files of a batch are cut into postings by many tasks.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    landed = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path).select("path")

    def handle(batch: DataFrame, number: int) -> None:
        names = [r["path"] for r in batch.collect()]  # bounded by files_per_batch
        if names:
            postings, _ = read_boards(spark, names)
            state.update(number, postings, merge_snapshots)

    return landed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
