"""Latest rows, work queues and dashboard queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import boards as B
from ..rules import scoring as S
from .filters import is_active


def latest_any_run(evaluations: DataFrame, runs: DataFrame, key: Sequence[str] = ("job_id",)) -> DataFrame:
    """Latest evaluation per job over all runs; unfinished runs come last, ties go to the larger run id."""
    timed = evaluations.join(runs.select("run_id", "completed_at"), "run_id", "left")
    return C.first_by_rank(timed, key, [F.desc_nulls_last("completed_at"), F.desc_nulls_last("run_id")])


def latest_completed(
    evaluations: DataFrame, runs: DataFrame, key: Sequence[str] = ("job_id",), tie: Column | None = None
) -> DataFrame:
    """Latest evaluation per job over finished runs; the earliest of equals stays."""
    done = runs.filter(F.col("completed_at").isNotNull()).select("run_id", "completed_at")
    timed = evaluations.join(done, "run_id")
    return C.first_by_rank(timed, key, [F.desc("completed_at"), F.asc("run_id") if tie is None else tie])


def latest_by(rows: DataFrame, key: Sequence[str], stamp: str, tie: Sequence[Column]) -> DataFrame:
    """Latest row per key by a time column."""
    return C.first_by_rank(rows, key, [F.desc_nulls_last(stamp), *tie])


def queue_candidates(
    applications: DataFrame, jobs: DataFrame, evaluations: DataFrame, runs: DataFrame,
    include_in_progress: bool = False, board_token: str | None = None,
) -> DataFrame:
    """Open agent applications of active jobs whose latest finished evaluation says AGENT_APPLY."""
    statuses = B.OPEN_STATUSES if include_in_progress else B.OPEN_STATUSES[:1]
    waiting = applications.filter(
        (F.col("application_method") == "AGENT") & F.col("status").isin(statuses)
        & ~F.coalesce("needs_assistance", F.lit(False))
    ).select(
        "job_id", "application_id", F.col("status").alias("application_status"),
        F.col("created_at").alias("application_created_at"),
    )
    alive = jobs.filter(is_active(F.col("is_active")))
    if board_token is not None:
        alive = alive.filter(F.col("board_token") == board_token)
    alive = alive.select("job_id", "board_token", "posting_id", "company", "title", "url")
    ready = latest_completed(evaluations, runs).filter(
        (F.col("route") == "AGENT_APPLY") & (F.coalesce("selected_resume_file", F.lit("")) != "")
    ).select(
        "job_id", "route", "score", "selection_score", "confidence", "selected_resume", "selected_resume_file",
        F.col("completed_at").alias("evaluation_completed_at"),
    )
    return waiting.join(alive, "job_id").join(ready, "job_id")


def queue_order(order: str) -> list[Column]:
    created, job = "application_created_at", F.col("job_id").cast("string")
    orders = {
        "fit": [F.desc(F.coalesce("score", F.lit(0.0))), F.asc_nulls_last(created), job.asc()],
        "newest": [F.desc_nulls_last(created), job.desc()],
        "oldest": [F.asc_nulls_last(created), job.asc()],
    }
    if order not in orders:
        raise ValueError("order must be one of: " + ", ".join(orders))
    return orders[order]


def work_queue(candidates: DataFrame, order: str = "oldest", limit: int = 3) -> DataFrame:
    """The head of the queue, numbered by ``place``."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    head = candidates.orderBy(*queue_order(order)).limit(limit)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*queue_order(order))))


def stale_candidates(queue: DataFrame, scan_started: Column) -> DataFrame:
    """Queue rows whose evaluation is missing or older than the scan; none may exist."""
    done = F.col("evaluation_completed_at")
    return queue.filter(done.isNull() | (done < scan_started))


def fresh_scan(runs: DataFrame, started_after: Column, owner: str | None = None) -> DataFrame:
    """The newest finished scan of all boards since a time, of one owner where one is named; empty when there is none."""
    done = runs.filter((F.col("started_at") >= started_after) & F.col("completed_at").isNotNull() & (F.col("board_token") == B.ALL_BOARDS))
    if owner is not None:
        done = done.filter(F.col("owner_id") == owner)
    return done.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def dashboard_view(
    applications: DataFrame, jobs: DataFrame, evaluations: DataFrame, requests: DataFrame
) -> DataFrame:
    """Applications with job, latest evaluation and latest open BROWSER request, none of which need exist."""
    latest = latest_by(evaluations, ["job_id"], "created_at", [F.desc("run_id")]).select(
        "job_id", F.struct([c for c in evaluations.columns if c != "job_id"]).alias("evaluation")
    )
    opened = requests.filter((F.col("source") == "BROWSER") & ~F.coalesce("resolved", F.lit(False)))
    request = latest_by(opened, ["application_id"], "updated_at", [F.desc("id")]).select(
        "application_id",
        F.struct([c for c in requests.columns if c != "application_id"]).alias("browser_request"),
    )
    job = jobs.select("job_id", F.struct([c for c in jobs.columns if c != "job_id"]).alias("job"))
    return applications.join(job, "job_id", "left").join(latest, "job_id", "left").join(
        request, "application_id", "left"
    )


def view_active() -> Column:
    return is_active(F.col("job.is_active"))


def _needs() -> Column:
    return F.coalesce("needs_assistance", F.lit(False))


QUEUES = ("manual", "assistance", "agent", "low_confidence", "closed", "progressed")


def queue_flag(name: str) -> Column:
    """Whether a dashboard row belongs to one of ``QUEUES``."""
    route = F.col("evaluation.route")
    flags = {
        "manual": (route == "MANUAL_PRIORITY") & (F.col("status") == "PENDING") & ~_needs() & view_active(),
        "assistance": _needs() & view_active(),
        "agent": (route == "AGENT_APPLY") & ~_needs() & view_active(),
        "low_confidence": view_active() & (F.col("evaluation.confidence") < S.MANUAL_CONFIDENCE),
        "closed": ~view_active(),
        "progressed": ~F.col("status").isin(B.OPEN_STATUSES),
    }
    return F.coalesce(flags[name], F.lit(False))


def dashboard_queue(view: DataFrame, name: str) -> DataFrame:
    """One dashboard queue in its own order."""
    newest = [F.desc("created_at"), F.desc("application_id")]
    orders = {
        "manual": [F.desc(F.coalesce("evaluation.score", F.lit(0.0))), *newest],
        "low_confidence": [F.asc("evaluation.confidence"), *newest],
    }
    return view.filter(queue_flag(name)).orderBy(*orders.get(name, newest))


def queue_membership(view: DataFrame) -> DataFrame:
    """One row per (queue, application) with its place-giving columns; the queues in a single pass."""
    names = F.array_compact(F.array(*[F.when(queue_flag(q), F.lit(q)) for q in QUEUES]))
    return view.select("*", F.explode(names).alias("queue"))


def route_membership(scored: DataFrame) -> DataFrame:
    """One row per (queue, posting): manual, agent, low confidence, in a single pass.

    Readers order a queue by score and posting id, the low-confidence one by confidence first.
    """
    names = F.array_compact(F.array(
        F.when(F.col("route") == "MANUAL_PRIORITY", F.lit("manual")), F.when(F.col("route") == "AGENT_APPLY", F.lit("agent")),
        F.when(F.col("confidence") < S.MANUAL_CONFIDENCE, F.lit("low_confidence")),
    ))
    return scored.select("*", F.explode(names).alias("queue"))


def recent_runs(runs: DataFrame, limit: int = 30, key: str = "run_id") -> DataFrame:
    """The last runs, oldest first, numbered "Run i"."""
    last = runs.orderBy(F.desc_nulls_last("started_at"), F.desc(key)).limit(limit)
    number = F.row_number().over(Window.orderBy(F.asc_nulls_first("started_at"), F.asc(key)))
    return last.withColumn("run_no", number).withColumn("name", F.concat(F.lit("Run "), F.col("run_no").cast("string")))


def head_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first rows per key with their ``place`` and how many rows the key has beyond them."""
    totals = rows.groupBy(*key).agg(F.greatest(F.count("*") - F.lit(limit), F.lit(0)).alias("more"))
    return C.first_by_rank(rows, key, order, limit, rank="place").join(totals, list(key))
