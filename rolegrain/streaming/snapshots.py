"""Incremental scans: the same plan over newly landed snapshot files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.snapshots import postings_from_documents


def stream_postings(spark: SparkSession, path: str) -> DataFrame:
    """Posting rows of snapshot files as they land, each file once."""
    documents = spark.readStream.format("text").option("wholetext", True).load(path)
    return postings_from_documents(documents)


def run_available(
    postings: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Process everything that has landed and stop; ``handle`` gets each batch and writes the new state.

    Batch numbers repeat after a failure, so ``handle`` should write to a
    place named after the number.
    """
    return (
        postings.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
