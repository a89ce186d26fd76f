"""Runs and queue-run roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import rollups as H
from ...operators import text as X
from ...sources import reports
from .. import daily
from . import applications as A
from . import bindings as b
from . import ranking
from .filters import COUNTS, FUNNEL, annotated
from .sources import QUEUE_REPORTS, queue_reports

SUMMARY = """summary AS (
  SELECT run AS run_no, count(*) AS selected, count(*) FILTER (queue_status = 'COMPLETED') AS completed,
    count(*) FILTER (outcome = 'NEEDS_ASSISTANCE') AS needs_assistance, count(*) FILTER (outcome = 'READY_NO_SUBMIT') AS ready_no_submit,
    count(*) FILTER (queue_status = 'BLOCKED') AS blocked, count(*) FILTER (queue_status = 'ERROR') AS errors,
    count(*) FILTER (challenge_detected) AS challenge_count, count(*) FILTER (browser_modified) AS browser_modified_count,
    CAST(0 AS BIGINT) AS submitted FROM results GROUP BY 1)"""


def _summary(spark, sf_dir):
    rows = reports.queue_results(reports.parse_queue_reports(queue_reports(spark, sf_dir)))
    return H.queue_run_summary(rows.filter(F.col("run_id").isNotNull()))


_KEYED = "SELECT 'run-' || CAST(run_no AS VARCHAR) AS run_id, * EXCLUDE (run_no) FROM summary WHERE run_no % 9 <> 8"


@b.query("h3_run_row", FUNNEL + f""", funnel AS (SELECT {COUNTS} FROM stages)
SELECT 'run-1' AS run_id, discovered AS jobs_discovered, target_roles AS target_role_jobs, us_compatible AS us_compatible_jobs,
  (SELECT count(*) FROM orders) AS jobs_eligible, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS manual_priority_count,
  (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS agent_apply_count, experience_rejected AS experience_rejected_count,
  unknown_location AS unknown_location_count, 1.235::DOUBLE AS fetch_seconds, 0.0::DOUBLE AS filtering_seconds, 2.0::DOUBLE AS resume_cache_seconds,
  3.142::DOUBLE AS scoring_seconds, 10.0::DOUBLE AS total_seconds FROM funnel""")
def h3(spark, sf_dir):
    times = dict(zip(H.TIMINGS, map(F.lit, (1.23456, 0.0001, 2.0, 3.14159, 9.9999))))
    row = H.run_row(
        H.run_funnel(annotated(spark, sf_dir)), b.evaluations(spark, sf_dir), F.lit("run-1"), b.now(), times
    )
    return row.drop("completed_at")


@b.query("h5_queue_run_summary", b.with_ctes(QUEUE_REPORTS, SUMMARY) + _KEYED)
def h5(spark, sf_dir):
    return _summary(spark, sf_dir)


_OK = "CASE WHEN queue_status IN ('COMPLETED', 'BLOCKED', 'ERROR') THEN queue_status ELSE 'ERROR' END"
HISTORY = f"""totals AS (SELECT run, sum(o_totalprice) / 3e5 - 8 AS seconds, CAST(max(o_orderdate) AS DATE) AS started_on FROM results GROUP BY 1),
history AS (
  SELECT 'run-' || CAST(run AS VARCHAR) AS run_key, {b.pick_sql(['oldest', 'fit', 'random', 'oldest'], 'run')} AS queue_order,
    CAST(run % 60 AS BIGINT) AS queue_limit, CASE WHEN seconds >= 0 THEN {b.round2_sql('seconds', 3)} ELSE 0.0 END AS total_seconds,
    CAST(started_on AS VARCHAR) AS started_at, CAST(count(*) AS INTEGER) AS selected_count,
    CAST(count(*) FILTER ({_OK} = 'COMPLETED') AS INTEGER) AS completed_count,
    CAST(count(*) FILTER (outcome = 'NEEDS_ASSISTANCE') AS INTEGER) AS needs_assistance_count,
    CAST(count(*) FILTER (outcome = 'READY_NO_SUBMIT') AS INTEGER) AS ready_no_submit_count,
    CAST(count(*) FILTER ({_OK} = 'BLOCKED') AS INTEGER) AS blocked_count, CAST(count(*) FILTER ({_OK} = 'ERROR') AS INTEGER) AS error_count,
    CAST(count(*) FILTER (challenge_detected) AS INTEGER) AS challenge_count, CAST(sum(greatest(ready_count, 0)) AS BIGINT) AS ready_fields
  FROM results JOIN totals USING (run) WHERE run % 9 <> 8 AND run % 11 <> 10 AND run % 4 <> 2 GROUP BY run, seconds, started_on)"""


def _history(spark, sf_dir):
    parsed = reports.parse_queue_reports(queue_reports(spark, sf_dir))
    return H.sanitize_run_reports(parsed, b.now())


_HISTORY_COLUMNS = [
    "run_key", "queue_order", "queue_limit", "total_seconds", "started_at", "selected_count", "completed_count",
    "needs_assistance_count", "ready_no_submit_count", "blocked_count", "error_count", "challenge_count",
]


@b.query("h6_run_history_rows", b.with_ctes(QUEUE_REPORTS, HISTORY) + "SELECT * FROM history")
def h6(spark, sf_dir):
    ready = F.aggregate("results", F.lit(0).cast("bigint"), lambda total, r: total + r["ready_count"])
    return _history(spark, sf_dir).select(*_HISTORY_COLUMNS, ready.alias("ready_fields"))


@b.query("h6_rejected_reports", b.with_ctes(QUEUE_REPORTS) + """
SELECT run % 11 = 10 AS submitted, CASE WHEN run % 11 = 10 THEN 'SUBMISSION_INVARIANT' WHEN run % 9 = 8 THEN 'RUN_ID_MISSING'
  ELSE 'INVALID_ORDER' END AS problem, count(DISTINCT run) AS reports
FROM results WHERE run % 11 = 10 OR run % 9 = 8 OR run % 4 = 2 GROUP BY 1, 2""")
def h6_rejected(spark, sf_dir):
    parsed = reports.parse_queue_reports(queue_reports(spark, sf_dir)).withColumn("problem", H.run_report_problem())
    return parsed.filter(F.col("problem").isNotNull()).groupBy(F.col("application_submitted").alias("submitted"), "problem").agg(
        F.count("*").alias("reports")
    )


@b.query("h6_history_violations", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'order' WHEN o_orderkey % 60 NOT BETWEEN 1 AND 50 THEN 'limit'
  WHEN o_totalprice < 20000 THEN 'nonnegative_counts' ELSE 'no_submission' END AS rule
FROM orders WHERE o_orderstatus = 'O' OR o_orderkey % 60 NOT BETWEEN 1 AND 50 OR o_totalprice < 20000 OR o_orderpriority = '1-URGENT'""")
def h6_violations(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    counts = {c: F.lit(0) for c in H.COUNT_COLUMNS}
    rows = o.withColumns({
        **counts, "status": F.lit("COMPLETED"), "queue_limit": (F.col("o_orderkey") % 60).cast("int"),
        "queue_order": F.when(F.col("o_orderstatus") == "O", F.lit("random")).otherwise(F.lit("fit")),
        "total_seconds": F.col("o_totalprice") - 20000, "submit_clicked_by_agent": F.col("o_orderpriority") == "1-URGENT",
        "application_submitted": F.lit(False),
    })
    return H.history_violations(rows).select("o_orderkey", "rule")


@b.query("h7_recent_run_totals", b.with_ctes(QUEUE_REPORTS, HISTORY) + """
SELECT count(*) AS runs, CAST(sum(selected_count) AS BIGINT) AS selected, CAST(sum(completed_count) AS BIGINT) AS completed,
  CAST(sum(challenge_count) AS BIGINT) AS challenges, CAST(sum(needs_assistance_count) AS BIGINT) AS assistance,
  CAST(sum(ready_no_submit_count) AS BIGINT) AS ready_no_submit, CAST(sum(blocked_count + error_count) AS BIGINT) AS failures
FROM (SELECT * FROM history ORDER BY started_at DESC, run_key DESC LIMIT 30)""")
def h7(spark, sf_dir):
    return H.recent_run_totals(_history(spark, sf_dir))


@b.query("h8_run_health", b.with_ctes(QUEUE_REPORTS, SUMMARY) + """
SELECT 'run-' || CAST(run_no AS VARCHAR) AS run_id, CASE WHEN blocked + errors > 0 THEN 'Blocked / error'
  WHEN needs_assistance > 0 THEN 'Assistance' ELSE 'Clean' END AS health FROM summary WHERE run_no % 9 <> 8""")
def h8(spark, sf_dir):
    health = H.run_health(F.col("submitted"), F.col("blocked"), F.col("errors"), F.col("needs_assistance"))
    return _summary(spark, sf_dir).select("run_id", health.alias("health"))


@b.query("h2_routed_summary", ranking.ALL + """
SELECT upper(source) AS company, source AS board_token, count(*) FILTER (route = 'MANUAL_PRIORITY') AS manual,
       count(*) FILTER (route = 'AGENT_APPLY') AS agent
FROM (SELECT DISTINCT source FROM documents) LEFT JOIN best ON board_token = source GROUP BY source""")
def h2_routed(spark, sf_dir):
    companies = b.documents(spark, sf_dir).select(
        F.upper("source").alias("company"), F.col("source").alias("board_token")
    ).distinct()
    routes = ranking.best(spark, sf_dir).select("board_token", "route")
    summary = H.board_summary(annotated(spark, sf_dir), companies, routes=routes)
    return summary.select("company", "board_token", "manual", "agent")


@b.query("b15_daily_report", A.QUEUE + """
, head AS (SELECT * FROM candidates ORDER BY score DESC, application_created_at NULLS LAST, CAST(job_id AS VARCHAR) LIMIT 10),
scan AS (SELECT jobs_discovered FROM runs WHERE started_at >= TIMESTAMP '1998-01-01' AND completed_at IS NOT NULL AND board_token = 'multi'
  ORDER BY started_at DESC, run_id DESC LIMIT 1),
facts AS (SELECT (SELECT CAST(jobs_discovered AS BIGINT) FROM scan) AS jobs_discovered, (SELECT CAST(count(*) AS INTEGER) FROM head) AS selected,
  (SELECT count(*) FROM head WHERE completed_at IS NULL OR completed_at < TIMESTAMP '1998-01-01') AS stale)
SELECT 'daily' AS run_key, CASE WHEN coalesce(jobs_discovered, 0) <= 0 THEN 'BLOCKED_NO_FRESH_SCAN' WHEN selected = 0 THEN 'COMPLETED_NO_CANDIDATES'
  WHEN stale > 0 THEN 'BLOCKED_STALE_QUEUE' ELSE 'QUEUE_READY' END AS status, selected, jobs_discovered FROM facts""")
def daily_report(spark, sf_dir):
    report = daily.daily_report(
        b.applications(spark, sf_dir), b.jobs(spark, sf_dir), b.evaluations(spark, sf_dir), b.runs(spark, sf_dir),
        F.to_timestamp(F.lit("1998-01-01")), "fit", 10,
    )
    return report.select("run_key", "status", F.size("candidates").alias("selected"), "scan.jobs_discovered")


@b.query("b15_queue_export", A.QUEUE + """
SELECT board_token, CAST(job_id AS VARCHAR) AS posting_id, title, route, status AS application_status, score FROM candidates""")
def queue_export(spark, sf_dir):
    out = X.export_candidate(A.candidates(spark, sf_dir))
    return out.select("board_token", "posting_id", "title", "route", "application_status", "score")
