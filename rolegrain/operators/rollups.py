"""Counts over annotated postings, runs and applications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import boards as B
from ..rules import scoring as S
from . import queues as Q
from . import scoring as P

# --- funnel -----------------------------------------------------------------

STAGES = (
    "discovered", "target_roles", "employment_filtered", "us_compatible", "unknown_location",
    "experience_rejected", "pre_eligibility", "assistance", "blocked", "eligible",
)


def stage_flags() -> dict[str, Column]:
    """Stage conditions over the columns ``plans.scan.annotate`` adds.

    Each stage only looks at postings that passed the one before.
    """
    employed = F.col("is_role") & (F.col("employment.decision") != "REJECT")
    here = employed & (F.col("location_status") == "US")
    early = here & (F.col("experience_status") != "REJECT")
    return {
        "discovered": F.lit(True),
        "target_roles": F.col("is_role"),
        "employment_filtered": F.col("is_role") & (F.col("employment.decision") == "REJECT"),
        "us_compatible": here,
        "unknown_location": employed & (F.col("location_status") == "UNKNOWN"),
        "experience_rejected": here & (F.col("experience_status") == "REJECT"),
        "pre_eligibility": early,
        "assistance": early & (F.col("eligibility.decision") == "NEEDS_ASSISTANCE"),
        "blocked": early & (F.col("eligibility.decision") == "SKIP"),
        "eligible": early & (F.col("eligibility.decision") == "PASS"),
    }


def funnel_counts(names=STAGES) -> list[Column]:
    flags = stage_flags()
    return [F.count_if(flags[n]).alias(n) for n in names]


def run_funnel(annotated: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """One row of stage counts, with the number of stale postings where given."""
    totals = annotated.agg(*funnel_counts())
    if stale is None:
        return totals
    return C.beside(totals, stale.agg(F.count("*").alias("stale")))


def board_summary(
    annotated: DataFrame, companies: DataFrame, fetched: DataFrame | None = None,
    routes: DataFrame | None = None, stale: DataFrame | None = None,
) -> DataFrame:
    """Funnel per company with SUCCESS / NO_JOBS / FETCH_FAILED and zeros where nothing came.

    ``fetched`` has ``board_token`` and ``fetch_status``; ``routes`` and
    ``stale`` are (board_token, route) and board_token rows to count.
    """
    counts = annotated.groupBy("board_token").agg(*funnel_counts())
    out = companies.join(counts, "board_token", "left")
    names = list(STAGES)
    if routes is not None:
        routed = routes.groupBy("board_token").agg(
            F.count_if(F.col("route") == "MANUAL_PRIORITY").alias("manual"),
            F.count_if(F.col("route") == "AGENT_APPLY").alias("agent"),
        )
        out, names = out.join(routed, "board_token", "left"), [*names, "manual", "agent"]
    if stale is not None:
        gone = stale.groupBy("board_token").agg(F.count("*").alias("stale"))
        out, names = out.join(gone, "board_token", "left"), [*names, "stale"]
    status = F.when(F.coalesce("discovered", F.lit(0)) > 0, F.lit("SUCCESS")).otherwise(F.lit("NO_JOBS"))
    if fetched is not None:
        out = out.join(fetched.select("board_token", "fetch_status"), "board_token", "left")
        status = F.when(F.col("fetch_status") == "FETCH_FAILED", F.lit("FETCH_FAILED")).otherwise(status)
    return out.select(
        "company", "board_token", status.alias("status"), *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def with_total(summary: DataFrame, label: str = "TOTAL") -> DataFrame:
    """Summary rows plus one row of sums."""
    key, counts = "board_token", [c for c in summary.columns if c not in ("company", "board_token", "status")]
    total = F.grouping("board_token") == 1
    return summary.rollup(key).agg(
        F.first("company").alias("_company"), F.first("status").alias("_status"),
        *[F.sum(c).alias(c) for c in counts], total.alias("_total"),
    ).select(
        F.when(F.col("_total"), F.lit(label)).otherwise(F.col("_company")).alias("company"),
        F.when(F.col("_total"), F.lit(label)).otherwise(F.col(key)).alias(key),
        F.when(~F.col("_total"), F.col("_status")).alias("status"), *counts,
    )


def board_fit(annotated: DataFrame) -> DataFrame:
    """Is a board worth scanning: recommendation per board from its funnel."""
    counts = annotated.groupBy("board_token").agg(*funnel_counts())
    passed = F.col("pre_eligibility") > 0
    none_employed = (F.col("employment_filtered") > 0) & (F.col("employment_filtered") == F.col("target_roles"))
    return counts.withColumn("recommendation", C.ladder(
        [
            (passed, F.lit("WORTH_ADDING")),
            ((F.col("target_roles") > 0) & none_employed, F.lit("ROLES_NOT_FULL_TIME")),
            (F.col("target_roles") > 0, F.lit("NO_ELIGIBLE_JOBS")),
        ],
        F.lit("NO_TARGET_ROLES"),
    ))


TIMINGS = ("fetch_seconds", "filtering_seconds", "resume_cache_seconds", "scoring_seconds", "total_seconds")


def run_row(funnel: DataFrame, routes: DataFrame, run_id: Column, completed_at: Column, timings: dict[str, Column]):
    """The run table row: counts of the funnel and the routes, timings rounded to milliseconds."""
    routed = routes.agg(
        F.count("*").alias("jobs_eligible"),
        F.count_if(F.col("route") == "MANUAL_PRIORITY").alias("manual_priority_count"),
        F.count_if(F.col("route") == "AGENT_APPLY").alias("agent_apply_count"),
    )
    return C.beside(funnel, routed).select(
        run_id.alias("run_id"), completed_at.alias("completed_at"), F.col("discovered").alias("jobs_discovered"),
        F.col("target_roles").alias("target_role_jobs"), F.col("us_compatible").alias("us_compatible_jobs"),
        "jobs_eligible", "manual_priority_count", "agent_apply_count",
        F.col("experience_rejected").alias("experience_rejected_count"),
        F.col("unknown_location").alias("unknown_location_count"),
        *[C.round_half_even(timings[t].cast("double"), 3).alias(t) for t in TIMINGS],
    )


def routing_summary(scored: DataFrame) -> DataFrame:
    """Evidence and routing counts over scored postings (``score``, ``confidence``, ``route``, ``has_required``)."""
    over, sure = F.col("score") >= S.MANUAL_THRESHOLD, F.col("confidence") >= S.MANUAL_CONFIDENCE
    return scored.agg(
        F.count("*").alias("scored"), F.count_if("has_required").alias("required_evidence"),
        F.count_if(sure).alias("confident"), F.count_if(F.col("confidence") < S.MANUAL_CONFIDENCE).alias("low_confidence"),
        F.count_if(over).alias("fit_over_threshold"),
        F.count_if(over & (F.col("route") != "MANUAL_PRIORITY")).alias("fit_over_but_held"),
    )


# --- queue runs -------------------------------------------------------------

def _result_flags(status: Column, outcome: Column, challenge: Column, modified: Column) -> dict[str, Column]:
    no = F.lit(False)
    return {
        "completed": status == "COMPLETED", "needs_assistance": outcome == "NEEDS_ASSISTANCE",
        "ready_no_submit": outcome == "READY_NO_SUBMIT", "blocked": status == "BLOCKED", "errors": status == "ERROR",
        "challenge_count": F.coalesce(challenge, no), "browser_modified_count": F.coalesce(modified, no),
    }


def queue_run_summary(results: DataFrame, key: str = "run_id") -> DataFrame:
    """Counters per queue run from its result rows."""
    flags = _result_flags(
        F.col("queue_status"), F.col("outcome"), F.col("challenge_detected"), F.col("browser_modified")
    )
    return results.groupBy(key).agg(
        F.count("*").alias("selected"), *[F.count_if(f).alias(n) for n, f in flags.items()],
        F.lit(0).cast("bigint").alias("submitted"),
    )


def run_health(submitted: Column, blocked: Column, errors: Column, assistance: Column) -> Column:
    zero = F.lit(0)
    failures = F.coalesce(blocked, zero) + F.coalesce(errors, zero)
    return C.ladder(
        [
            (F.coalesce(submitted, zero) > 0, F.lit("Safety violation")),
            (failures > 0, F.lit("Blocked / error")),
            (F.coalesce(assistance, zero) > 0, F.lit("Assistance")),
        ],
        F.lit("Clean"),
    )


def safe_result(result: Column) -> Column:
    """Queue result reduced to operational fields with known vocabulary."""
    status, outcome = C.safe_text(result["queue_status"]), C.safe_text(result["outcome"])
    no = F.lit(False)
    return F.struct(
        C.safe_text(result["board_token"]).alias("board_token"),
        C.safe_text(result["posting_id"]).alias("posting_id"),
        C.safe_text(result["company"]).alias("company"), C.safe_text(result["title"]).alias("title"),
        F.when(status.isin(B.QUEUE_STATUSES), status).otherwise(F.lit("ERROR")).alias("queue_status"),
        F.when(outcome.isin(B.QUEUE_OUTCOMES), outcome).alias("outcome"),
        F.coalesce(result["challenge_detected"], no).alias("challenge_detected"),
        C.nonneg_int(result["ready_count"]).alias("ready_count"),
        C.nonneg_int(result["required_human_count"]).alias("required_human_count"),
        F.coalesce(result["browser_modified"], no).alias("browser_modified"),
        C.safe_text(result["application_status_after"]).alias("application_status_after"),
        C.safe_text(result["error_type"]).alias("error_type"),
        no.alias("submit_clicked_by_agent"), no.alias("application_submitted"),
    )


def run_report_problem() -> Column:
    """Why a run report may not be stored, null when it may."""
    no = F.lit(False)
    return F.coalesce(
        F.when(
            F.coalesce("submit_clicked_by_agent", no) | F.coalesce("application_submitted", no),
            F.lit("SUBMISSION_INVARIANT"),
        ),
        F.when(C.safe_text(F.col("run_id")).isNull(), F.lit("RUN_ID_MISSING")),
        F.when(
            ~F.coalesce(C.safe_text(F.col("order")), F.lit("oldest")).isin(B.QUEUE_ORDERS), F.lit("INVALID_ORDER")
        ),
    )


def sanitize_run_reports(reports: DataFrame, now: Column, max_results: int | None = None) -> DataFrame:
    """Storable run rows: fields cleaned, counters over all results, of which ``max_results`` are kept if it is given.

    Rows that ``run_report_problem`` names are left out; select them with it
    to report the violations.
    """
    kept = reports.filter(run_report_problem().isNull()).withColumn(
        "_safe", F.transform(F.coalesce("results", F.array()), safe_result)
    )

    def count(name: str) -> Column:
        def hit(r: Column) -> Column:
            flags = _result_flags(r["queue_status"], r["outcome"], r["challenge_detected"], r["browser_modified"])
            return F.coalesce(flags[name], F.lit(False))

        return F.size(F.filter("_safe", hit))

    return kept.select(
        C.safe_text(F.col("run_id")).alias("run_key"), F.lit(1).alias("runner_version"),
        F.lit("COMPLETED").alias("status"), F.coalesce("persist", F.lit(False)).alias("persist_handoffs"),
        C.safe_text(F.col("board_token_filter")).alias("board_token_filter"),
        F.coalesce(C.safe_text(F.col("order")), F.lit("oldest")).alias("queue_order"),
        C.nonneg_int(F.col("limit"), 1).alias("queue_limit"),
        F.coalesce("include_in_progress", F.lit(False)).alias("include_in_progress"),
        C.safe_text(F.col("started_at")).alias("started_at"),
        C.safe_text(F.col("completed_at")).alias("completed_at"),
        C.nonneg_double(F.col("total_seconds")).alias("total_seconds"),
        F.size("_safe").alias("selected_count"), count("completed").alias("completed_count"),
        count("needs_assistance").alias("needs_assistance_count"),
        count("ready_no_submit").alias("ready_no_submit_count"), count("blocked").alias("blocked_count"),
        count("errors").alias("error_count"), count("challenge_count").alias("challenge_count"),
        count("browser_modified_count").alias("browser_modified_count"), F.lit(0).alias("submitted_count"),
        F.lit(False).alias("submit_clicked_by_agent"), F.lit(False).alias("application_submitted"),
        (F.col("_safe") if max_results is None else F.slice("_safe", 1, max_results)).alias("results"), now.alias("updated_at"),
    )


COUNT_COLUMNS = (
    "selected_count", "completed_count", "needs_assistance_count", "ready_no_submit_count", "blocked_count",
    "error_count", "challenge_count", "browser_modified_count", "submitted_count",
)


def history_violations(history: DataFrame) -> DataFrame:
    """Stored run rows that break a table rule, with the rule's name."""
    negative = F.lit(False)
    for name in (*COUNT_COLUMNS, "total_seconds"):
        negative = negative | (F.col(name) < 0)
    rule = F.coalesce(
        F.when(F.col("status") != "COMPLETED", F.lit("status")),
        F.when(~F.col("queue_order").isin(B.QUEUE_ORDERS), F.lit("order")),
        F.when(~F.col("queue_limit").between(1, 50), F.lit("limit")),
        F.when(negative, F.lit("nonnegative_counts")),
        F.when(
            (F.col("submitted_count") != 0) | F.col("submit_clicked_by_agent") | F.col("application_submitted"),
            F.lit("no_submission"),
        ),
    )
    return history.withColumn("rule", rule).filter(F.col("rule").isNotNull())


def recent_run_totals(runs: DataFrame, limit: int = 30, key: str = "run_key") -> DataFrame:
    """Sums over the last runs; failures are blocked plus errors."""
    last = runs.orderBy(F.desc_nulls_last("started_at"), F.desc(key)).limit(limit)

    def total(*names: str) -> Column:
        value = sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col(names[0]), F.lit(0)))
        return F.coalesce(F.sum(value), F.lit(0))

    return last.agg(
        F.count("*").alias("runs"), total("selected_count").alias("selected"),
        total("completed_count").alias("completed"), total("challenge_count").alias("challenges"),
        total("needs_assistance_count").alias("assistance"), total("ready_no_submit_count").alias("ready_no_submit"),
        total("blocked_count", "error_count").alias("failures"),
    )


# --- dashboard --------------------------------------------------------------


def evidence_stats(view: DataFrame) -> DataFrame:
    """Active latest evaluations that carry confidence and explanation: counts and averages, 0 when none."""
    usable = view.filter(
        Q.view_active() & F.col("evaluation.confidence").isNotNull() & F.col("evaluation.explanation").isNotNull()
    )
    e = "evaluation.explanation."
    return usable.agg(
        F.count("*").alias("evaluations"),
        F.count_if(F.coalesce(e + "required_evidence_gate", F.lit(False))).alias("required_evidence"),
        F.count_if(F.coalesce(e + "manual_ready", F.lit(False))).alias("manual_ready"),
        F.coalesce(F.avg("evaluation.confidence"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.avg(F.coalesce("evaluation.score", F.lit(0.0))), F.lit(0.0)).alias("avg_fit"),
    )


def outcome_funnel(applications: DataFrame) -> DataFrame:
    status = F.col("status")
    return applications.agg(
        F.count("*").alias("total"), F.count_if(status == "APPLIED").alias("applied"),
        F.count_if(status.isin(B.INTERVIEW_STATUSES)).alias("interviews"), F.count_if(status == "OFFER").alias("offers"),
        F.count_if(status == "REJECTED").alias("rejected"),
    )


def method_comparison(applications: DataFrame) -> DataFrame:
    """Positive outcomes per method with the rate in percent, one decimal, 0.0 for an empty method."""
    spark = applications.sparkSession
    good = ["OA", *B.INTERVIEW_STATUSES, "OFFER"]
    counts = applications.groupBy("application_method").agg(
        F.count("*").alias("_total"), F.count_if(F.col("status").isin(good)).alias("_positive")
    )
    methods = spark.createDataFrame([("MANUAL",), ("AGENT",)], "application_method string")
    total, positive = (F.coalesce(c, F.lit(0)) for c in ("_total", "_positive"))
    rate = C.round_half_even(positive.cast("double") / total * 100.0, 1)
    return methods.join(counts, "application_method", "left").select(
        "application_method", total.alias("total"), positive.alias("positive"),
        F.when(total > 0, rate).otherwise(F.lit(0.0)).alias("rate"),
    )


def profile_usage(view: DataFrame) -> DataFrame:
    """How often each profile is the selected one, most used first."""
    chosen = F.col("evaluation.selected_resume")
    used = view.filter(F.coalesce(chosen, F.lit("")) != "").groupBy(chosen.alias("profile")).count()
    return used.orderBy(F.desc("count"), F.asc("profile"))


def headline_metrics(view: DataFrame) -> DataFrame:
    """The dashboard's headline numbers in one pass."""
    return view.agg(
        F.count("*").alias("tracked"), F.count_if(Q.queue_flag("manual")).alias("manual"),
        F.count_if(Q.queue_flag("agent") & (F.col("status") == "PENDING")).alias("agent_pending"),
        F.count_if(Q.queue_flag("assistance")).alias("assistance"),
        F.count_if(Q.queue_flag("low_confidence")).alias("low_confidence"),
        F.count_if(Q.queue_flag("progressed")).alias("progressed"), F.count_if(Q.queue_flag("closed")).alias("closed"),
    )


def missing_evidence(view: DataFrame) -> DataFrame:
    """Review rows: which components the latest evaluation lacks."""
    flags = F.col("evaluation.explanation.component_availability")
    return view.withColumn(
        "missing", P.missing_components({n: flags[n] for n in ("required", "preferred", "experience")})
    )
