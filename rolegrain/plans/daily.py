"""The daily run behind a scan: fresh queue, guard and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import queues as Q
from ..operators import text as X


def daily_report(
    applications: DataFrame, jobs: DataFrame, evaluations: DataFrame, runs: DataFrame, scan_started: Column,
    order: str = "oldest", limit: int = 3, run_key: str = "daily",
) -> DataFrame:
    """One report row: the fresh scan, the selected candidates, and a status.

    BLOCKED_NO_FRESH_SCAN without a finished scan that found postings,
    BLOCKED_STALE_QUEUE when a selected evaluation is older than the scan.
    """
    queue = Q.work_queue(Q.queue_candidates(applications, jobs, evaluations, runs), order, limit)
    stale = Q.stale_candidates(queue, scan_started).agg(F.count("*").alias("stale"))
    scan = X.export_scan_summary(Q.fresh_scan(runs, scan_started)).agg(F.first(F.struct("*")).alias("scan"))
    # The queue is bounded by its limit, so it folds into one report row.
    candidates = X.export_candidate(queue).agg(F.collect_list(F.struct("*")).alias("candidates"))
    joined = C.beside(scan, candidates, stale)
    status = (
        F.when(F.col("scan").isNull() | (F.coalesce("scan.jobs_discovered", F.lit(0)) <= 0), F.lit("BLOCKED_NO_FRESH_SCAN"))
        .when(F.size("candidates") == 0, F.lit("COMPLETED_NO_CANDIDATES"))
        .when(F.col("stale") > 0, F.lit("BLOCKED_STALE_QUEUE"))
        .otherwise(F.lit("QUEUE_READY"))
    )
    return joined.select(F.lit(run_key).alias("run_key"), status.alias("status"), "scan", "candidates")
