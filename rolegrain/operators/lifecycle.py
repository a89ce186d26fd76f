"""Posting table across snapshots: upsert, stale postings, board reports.

Every operator is a function from old state and changes to new state; the
caller decides where the new version is written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .filters import is_active

KEY = ("board_token", "posting_id")


def posting_key(value: Column) -> Column:
    """Posting id as trimmed text; blank becomes null."""
    return F.nullif(C.strip(value.cast("string")), F.lit(""))


def live_ids(snapshot: DataFrame) -> DataFrame:
    """Distinct (board, id) pairs of a snapshot with a usable id, per owner where the snapshot names one."""
    return (
        snapshot.select(*C.owned(["board_token"], snapshot), posting_key(F.col("posting_id")).alias("posting_id"))
        .filter(F.col("posting_id").isNotNull())
        .distinct()
    )


def find_stale(tracked: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Active tracked postings that are gone from their board.

    A board without any live id never makes a posting stale: that is an
    empty or failed fetch, not a closed board.
    """
    live = live_ids(snapshot)
    active = tracked.filter(is_active(F.col("is_active"))).withColumn("_id", posting_key(F.col("posting_id")))
    named = active.filter(F.col("_id").isNotNull())
    board = C.owned(["board_token"], tracked, snapshot)
    on_live_board = named.join(live.select(*board).distinct(), board, "left_semi")
    gone = on_live_board.join(live.withColumnRenamed("posting_id", "_id").select(*board, "_id"), [*board, "_id"], "left_anti")
    return gone.select(*tracked.columns)


def upsert_postings(state: DataFrame, seen: DataFrame, now: Column, key: Sequence[str] = KEY) -> DataFrame:
    """Insert or update by natural key, per owner where both sides name one; a posting seen again is active again.

    ``seen`` carries the state's payload columns; of several rows with one key the last fetched one counts.
    """
    key = C.owned(key, state, seen)
    seen = C.last_per_key(seen, key)
    stamp = {"last_seen_at": now, "is_active": F.lit(True), "updated_at": now}
    payload = [c for c in state.columns if c not in key]
    fresh = seen.select(*key, *[F.col(c).alias(f"_new_{c}") for c in payload if c not in stamp], F.lit(True).alias("_seen"))
    merged = state.join(fresh, list(key), "full_outer")

    def value(name: str) -> Column:
        return stamp[name] if name in stamp else F.col(f"_new_{name}")

    return merged.select(
        *key, *[F.when(F.col("_seen"), value(c)).otherwise(F.col(c)).alias(c) for c in payload],
        F.coalesce("_seen", F.lit(False)).alias("changed"),
    )


def sync_lifecycle(state: DataFrame, snapshot: DataFrame, now: Column, stale: DataFrame | None = None) -> DataFrame:
    """State with stale postings switched off; ``changed`` marks them. ``stale`` saves a second search."""
    key = C.owned(KEY, state)
    stale = (find_stale(state, snapshot) if stale is None else stale).select(*key).distinct().withColumn("_stale", F.lit(True))
    marked = state.join(stale, key, "left").withColumn("changed", F.coalesce("_stale", F.lit(False)))
    return marked.withColumns({
        "is_active": F.when(F.col("changed"), F.lit(False)).otherwise(F.col("is_active")),
        "updated_at": F.when(F.col("changed"), now).otherwise(F.col("updated_at")),
    }).drop("_stale")


def lifecycle_report(state: DataFrame, snapshot: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Per board, and owner where both sides name one: live, tracked active, stale, and whether it was skipped. Writes nothing.

    ``boards`` adds boards that are to be reported although nothing is known of them.
    """
    board = C.owned(["board_token"], state, snapshot)
    live = live_ids(snapshot).select(*board, "posting_id").distinct().withColumn("_live", F.lit(1))
    tracked = state.filter(is_active(F.col("is_active"))).groupBy(
        *board, posting_key(F.col("posting_id")).alias("posting_id"),
    ).agg(F.count("*").alias("_tracked"))
    # One meeting of both sides; each has a row per board and id.
    met = tracked.join(live, [*board, "posting_id"], "full_outer")
    gone = F.col("_live").isNull() & F.col("posting_id").isNotNull()
    report = met.groupBy(*board).agg(
        F.count("_live").alias("live_count"), F.coalesce(F.sum("_tracked"), F.lit(0)).alias("tracked_count"),
        F.coalesce(F.sum(F.when(gone, F.col("_tracked"))), F.lit(0)).alias("_gone"),
    )
    if boards is not None:
        named = [c for c in board if c in boards.columns]
        report = boards.select(*named).distinct().join(report, named, "full_outer")
    skipped = F.coalesce("live_count", F.lit(0)) == 0
    report = report.withColumn("stale_count", F.when(skipped, F.lit(0)).otherwise(F.col("_gone")))
    return report.select(
        *board, F.coalesce("live_count", F.lit(0)).alias("live_count"),
        F.when(skipped, F.lit(0)).otherwise(F.coalesce("tracked_count", F.lit(0))).alias("tracked_active_count"),
        F.coalesce("stale_count", F.lit(0)).alias("stale_count"), skipped.alias("skipped"),
        F.when(skipped, F.lit("EMPTY_LIVE_SET")).alias("reason"),
    )


def lifecycle_totals(report: DataFrame) -> DataFrame:
    """Boards inspected, boards skipped, postings that would close; a row per owner where the report names owners."""
    counts = [
        F.count_if(~F.col("skipped")).alias("boards_inspected"), F.count_if("skipped").alias("boards_skipped"),
        F.coalesce(F.sum("stale_count"), F.lit(0)).alias("would_close"),
    ]
    return report.groupBy(C.OWNER).agg(*counts) if C.OWNER in report.columns else report.agg(*counts)


def resolve_job_ids(wanted: DataFrame, state: DataFrame) -> DataFrame:
    """Internal job id by natural key, per owner where both sides name one; rows without one drop out."""
    key = C.owned(KEY, wanted, state)
    return wanted.join(state.select(*key, "job_id"), key)
