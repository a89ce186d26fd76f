"""State tables: life cycle, applications, requests, queues, dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import applications as A
from ...operators import lifecycle as J
from ...operators import queues as Q
from ...operators import rollups as H
from ...rules import boards as R
from ...rules import scoring as S
from . import bindings as b

OPEN = "status IN ('PENDING', 'IN_PROGRESS')"
ACTIVE = "coalesce(is_active, TRUE)"

# --- life cycle -------------------------------------------------------------

STALE = f"""stale AS (SELECT * FROM jobs WHERE {ACTIVE} AND board_token IN (SELECT board_token FROM live)
  AND (board_token, posting_id) NOT IN (SELECT board_token, posting_id FROM live))"""
LIFE = b.with_ctes(b.JOBS, b.SNAPSHOT, STALE)


@b.query("e5_stale_postings", LIFE + "SELECT job_id, board_token, posting_id FROM stale")
def e5(spark, sf_dir):
    return J.find_stale(b.jobs(spark, sf_dir), b.snapshot(spark, sf_dir)).select("job_id", "board_token", "posting_id")


@b.query("e8_job_ids", LIFE + "SELECT job_id, board_token, posting_id FROM live JOIN jobs USING (board_token, posting_id)")
def e8(spark, sf_dir):
    live = J.live_ids(b.snapshot(spark, sf_dir))
    return J.resolve_job_ids(live, b.jobs(spark, sf_dir)).select("job_id", "board_token", "posting_id")


def _seen(spark, sf_dir):
    """Live postings with a new title, and suppliers as postings never seen before."""
    s = b.snapshot(spark, sf_dir)
    old = s.select(
        "board_token", J.posting_key(F.col("posting_id")).alias("posting_id"), F.col("c_custkey").alias("job_id"),
        F.concat(F.lit("New "), "c_name").alias("title"),
    )
    new = b.table(spark, sf_dir, "supplier").select(
        F.lit("suppliers").alias("board_token"), F.col("s_suppkey").cast("string").alias("posting_id"),
        (F.col("s_suppkey") + 5000000).alias("job_id"), F.col("s_name").alias("title"),
    )
    both = old.unionByName(new)
    return both.withColumns({
        "company": F.lit("C"), "location": F.lit("L"), "url": F.lit("U"), "detected_profile": F.lit("P"),
    })


@b.query("j1_upsert_postings", b.with_ctes(b.JOBS, b.SNAPSHOT) + f"""
, seen AS (SELECT board_token, posting_id, c_custkey AS job_id, 'New ' || c_name AS title FROM live
           UNION ALL SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), s_suppkey + 5000000, s_name FROM supplier)
SELECT board_token, posting_id, coalesce(seen.job_id, jobs.job_id) AS job_id, coalesce(seen.title, jobs.title) AS title,
  CASE WHEN seen.job_id IS NOT NULL THEN TRUE ELSE is_active END AS is_active, seen.job_id IS NOT NULL AS changed,
  CASE WHEN seen.job_id IS NOT NULL THEN DATE '2024-06-01' ELSE DATE '1999-01-01' END AS seen_on
FROM jobs FULL JOIN seen USING (board_token, posting_id)""")
def j1(spark, sf_dir):
    state = J.upsert_postings(b.jobs(spark, sf_dir), _seen(spark, sf_dir), b.now())
    return state.select(
        "board_token", "posting_id", "job_id", "title", "is_active", "changed", F.to_date("last_seen_at").alias("seen_on")
    )


@b.query("j2_lifecycle_sync", LIFE + """
SELECT jobs.job_id, CASE WHEN s.job_id IS NOT NULL THEN FALSE ELSE jobs.is_active END AS is_active, s.job_id IS NOT NULL AS changed
FROM jobs LEFT JOIN stale s USING (board_token, posting_id)""")
def j2(spark, sf_dir):
    state = J.sync_lifecycle(b.jobs(spark, sf_dir), b.snapshot(spark, sf_dir), b.now())
    return state.select("job_id", "is_active", "changed")


REPORT = f"""report AS (
  SELECT n AS board_token, coalesce(l, 0) AS live_count, CASE WHEN coalesce(l, 0) = 0 THEN 0 ELSE coalesce(t, 0) END AS tracked_active_count,
    coalesce(s, 0) AS stale_count, coalesce(l, 0) = 0 AS skipped, CASE WHEN coalesce(l, 0) = 0 THEN 'EMPTY_LIVE_SET' END AS reason
  FROM (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS n FROM nation UNION ALL SELECT r_name FROM region) k
  LEFT JOIN (SELECT board_token AS n, count(*) AS l FROM live GROUP BY 1) USING (n)
  LEFT JOIN (SELECT board_token AS n, count(*) AS t FROM jobs WHERE {ACTIVE} GROUP BY 1) USING (n)
  LEFT JOIN (SELECT board_token AS n, count(*) AS s FROM stale GROUP BY 1) USING (n))"""


def _report(spark, sf_dir):
    nations = b.table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("board_token"))
    regions = b.table(spark, sf_dir, "region").select(F.col("r_name").alias("board_token"))
    return J.lifecycle_report(b.jobs(spark, sf_dir), b.snapshot(spark, sf_dir), nations.unionByName(regions))


@b.query("j2_lifecycle_report", b.with_ctes(b.JOBS, b.SNAPSHOT, STALE, REPORT) + "SELECT * FROM report")
def j2_report(spark, sf_dir):
    return _report(spark, sf_dir).withColumns({
        c: F.col(c).cast("bigint") for c in ("live_count", "tracked_active_count", "stale_count")
    })


@b.query("h15_lifecycle_totals", b.with_ctes(b.JOBS, b.SNAPSHOT, STALE, REPORT) + """
SELECT count(*) FILTER (NOT skipped) AS boards_inspected, count(*) FILTER (skipped) AS boards_skipped,
       CAST(sum(stale_count) AS BIGINT) AS would_close FROM report""")
def h15(spark, sf_dir):
    return J.lifecycle_totals(_report(spark, sf_dir))


@b.query("g10_stale_heads", LIFE + """
SELECT board_token, job_id, CAST(place AS INTEGER) AS place, greatest(n - 5, 0) AS more FROM (
  SELECT board_token, job_id, row_number() OVER (PARTITION BY board_token ORDER BY job_id) AS place,
         count(*) OVER (PARTITION BY board_token) AS n FROM stale) WHERE place <= 5""")
def g10(spark, sf_dir):
    stale = J.find_stale(b.jobs(spark, sf_dir), b.snapshot(spark, sf_dir))
    head = Q.head_per_key(stale, ["board_token"], [F.asc("job_id")], 5)
    return head.select("board_token", "job_id", "place", F.col("more").cast("bigint"))


# --- latest rows ------------------------------------------------------------

TIMED = "timed AS (SELECT e.*, r.completed_at FROM evaluations e LEFT JOIN runs r USING (run_id))"
LATEST = b.with_ctes(b.EVALUATIONS, b.RUNS, TIMED)


@b.query("g2_latest_any_run", LATEST + """
SELECT job_id, run_id, route FROM (SELECT *, row_number() OVER (PARTITION BY job_id
  ORDER BY completed_at DESC NULLS LAST, run_id DESC) AS r FROM timed) WHERE r = 1""")
def g2(spark, sf_dir):
    latest = Q.latest_any_run(b.evaluations(spark, sf_dir), b.runs(spark, sf_dir))
    return latest.select("job_id", "run_id", "route")


DONE = """done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY completed_at DESC, run_id) AS r
  FROM timed WHERE completed_at IS NOT NULL) WHERE r = 1)"""


@b.query("g3_latest_completed", b.with_ctes(b.EVALUATIONS, b.RUNS, TIMED, DONE) + "SELECT job_id, run_id, route FROM done")
def g3(spark, sf_dir):
    latest = Q.latest_completed(b.evaluations(spark, sf_dir), b.runs(spark, sf_dir))
    return latest.select("job_id", "run_id", "route")


LAST = """last_eval AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, run_id DESC) AS r
  FROM evaluations) WHERE r = 1),
last_request AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY updated_at DESC, id DESC) AS r
  FROM requests WHERE source = 'BROWSER' AND NOT resolved) WHERE r = 1)"""


@b.query("g4_latest_by_time", b.with_ctes(b.EVALUATIONS, b.REQUESTS, LAST) + "SELECT job_id, run_id, score FROM last_eval")
def g4(spark, sf_dir):
    latest = Q.latest_by(b.evaluations(spark, sf_dir), ["job_id"], "created_at", [F.desc("run_id")])
    return latest.select("job_id", "run_id", "score")


# --- queue ------------------------------------------------------------------

CANDIDATES = f"""candidates AS (
  SELECT a.job_id, application_id, status, a.created_at AS application_created_at, board_token, title, d.route, d.score, d.completed_at
  FROM applications a JOIN jobs j ON a.job_id = j.job_id AND {ACTIVE} JOIN done d ON d.job_id = a.job_id
  WHERE application_method = 'AGENT' AND status = 'PENDING' AND NOT needs_assistance AND route = 'AGENT_APPLY'
    AND selected_resume_file IS NOT NULL)"""
QUEUE = b.with_ctes(b.JOBS, b.EVALUATIONS, b.RUNS, b.APPLICATIONS, TIMED, DONE, CANDIDATES)


def candidates(spark, sf_dir):
    return Q.queue_candidates(
        b.applications(spark, sf_dir), b.jobs(spark, sf_dir), b.evaluations(spark, sf_dir), b.runs(spark, sf_dir)
    )


@b.query("e6_queue_candidates", QUEUE + "SELECT job_id, application_id, board_token, title, route, score FROM candidates")
def e6(spark, sf_dir):
    return candidates(spark, sf_dir).select("job_id", "application_id", "board_token", "title", "route", "score")


@b.query("g5_work_queue", QUEUE + """
, heads AS ((SELECT 'fit' AS kind, job_id, row_number() OVER (ORDER BY score DESC, application_created_at NULLS LAST, CAST(job_id AS VARCHAR)) AS place FROM candidates QUALIFY place <= 60)
UNION ALL (SELECT 'newest', job_id, row_number() OVER (ORDER BY application_created_at DESC NULLS LAST, CAST(job_id AS VARCHAR) DESC) AS place FROM candidates QUALIFY place <= 60)
UNION ALL (SELECT 'oldest', job_id, row_number() OVER (ORDER BY application_created_at NULLS LAST, CAST(job_id AS VARCHAR)) AS place FROM candidates QUALIFY place <= 60))
SELECT kind, job_id, CAST(place AS INTEGER) AS place FROM heads""")
def g5(spark, sf_dir):
    found = candidates(spark, sf_dir)
    heads = [Q.work_queue(found, o, 60).select(F.lit(o).alias("kind"), "job_id", "place") for o in ("fit", "newest", "oldest")]
    return heads[0].unionByName(heads[1]).unionByName(heads[2])


@b.query("e9_fresh_scan", b.with_ctes(b.RUNS) + """
SELECT run_id, jobs_discovered FROM runs
WHERE started_at >= TIMESTAMP '1998-01-01 00:00:00' AND completed_at IS NOT NULL AND board_token = 'multi'
ORDER BY started_at DESC, run_id DESC LIMIT 1""")
def e9(spark, sf_dir):
    return Q.fresh_scan(b.runs(spark, sf_dir), F.to_timestamp(F.lit("1998-01-01"))).select("run_id", "jobs_discovered")


# --- application state ------------------------------------------------------

EVALUATED = b.with_ctes(b.EVALUATIONS, b.RUNS, TIMED, DONE, b.APPLICATIONS)
ROUTED = ", routed AS (SELECT job_id, route FROM done)"


@b.query("j3_save_evaluations", """
WITH parts AS (SELECT l_orderkey AS run_id, l_partkey % 50 AS job_id, max(l_quantity) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
fresh AS (SELECT l_orderkey AS run_id, l_partkey % 50 AS job_id, max(l_quantity) + 100 AS score FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT run_id, job_id, coalesce(fresh.score, parts.score) AS score FROM parts FULL JOIN fresh USING (run_id, job_id)""")
def j3(spark, sf_dir):
    items = b.table(spark, sf_dir, "lineitem").withColumns({"run_id": F.col("l_orderkey"), "job_id": F.col("l_partkey") % 50})

    def rows(condition, bonus):
        return items.filter(condition).groupBy("run_id", "job_id").agg((F.max("l_quantity") + bonus).alias("score"))

    return A.save_evaluations(rows(F.col("l_returnflag") == "R", 0), rows(F.col("l_linestatus") == "F", 100))


@b.query("j4_ensure_applications", EVALUATED + ROUTED + f"""
, m AS (SELECT coalesce(a.job_id, r.job_id) AS job_id, a.*, r.route, a.job_id IS NULL AS fresh,
  CASE WHEN r.route = 'MANUAL_PRIORITY' THEN 'MANUAL' ELSE 'AGENT' END AS method,
  coalesce(a.needs_assistance AND a.assistance_reason LIKE 'ELIGIBILITY:%', FALSE) AS clears
  FROM applications a FULL JOIN routed r ON a.job_id = r.job_id),
d AS (SELECT *, fresh OR (route IS NOT NULL AND coalesce({OPEN}, FALSE) AND (application_method IS DISTINCT FROM method OR clears)) AS changed FROM m)
SELECT job_id, CASE WHEN changed THEN method ELSE application_method END AS application_method, coalesce(status, 'PENDING') AS status,
  CASE WHEN changed AND (fresh OR clears) THEN FALSE ELSE needs_assistance END AS needs_assistance,
  CASE WHEN changed AND clears THEN NULL ELSE assistance_reason END AS assistance_reason, changed
FROM d""")
def j4(spark, sf_dir):
    latest = Q.latest_completed(b.evaluations(spark, sf_dir), b.runs(spark, sf_dir)).select("job_id", "route")
    state = A.ensure_applications(b.applications(spark, sf_dir), latest, b.now())
    return state.select("job_id", "application_method", "status", "needs_assistance", "assistance_reason", "changed")


FLAGGED = ", flagged AS (SELECT job_id, 'Eligibility review required: ' || selected_resume AS reason FROM done WHERE route = 'MANUAL_PRIORITY')"


def _flagged(spark, sf_dir):
    latest = Q.latest_completed(b.evaluations(spark, sf_dir), b.runs(spark, sf_dir))
    return latest.filter(F.col("route") == "MANUAL_PRIORITY").select(
        "job_id", F.concat(F.lit("Eligibility review required: "), "selected_resume").alias("reason")
    )


@b.query("j5_ensure_assistance", EVALUATED + FLAGGED + f"""
, d AS (SELECT coalesce(a.job_id, f.job_id) AS job_id, a.*, 'ELIGIBILITY: ' || f.reason AS tagged, a.job_id IS NULL OR (f.job_id IS NOT NULL
   AND {OPEN} AND (NOT a.needs_assistance OR a.assistance_reason IS DISTINCT FROM 'ELIGIBILITY: ' || f.reason)) AS changed
  FROM applications a FULL JOIN flagged f ON a.job_id = f.job_id)
SELECT job_id, coalesce(application_method, 'AGENT') AS application_method, coalesce(status, 'PENDING') AS status,
  CASE WHEN changed THEN TRUE ELSE needs_assistance END AS needs_assistance,
  CASE WHEN changed THEN tagged ELSE assistance_reason END AS assistance_reason, changed FROM d""")
def j5(spark, sf_dir):
    state = A.ensure_assistance(b.applications(spark, sf_dir), _flagged(spark, sf_dir), b.now())
    return state.select("job_id", "application_method", "status", "needs_assistance", "assistance_reason", "changed")


WANTED = """, wanted AS (SELECT DISTINCT c_custkey + 1000000 AS application_id, 'R' || CAST(c_custkey % 3 AS VARCHAR) AS reason,
  'Q0' AS question, 'H1' AS handoff FROM customer)"""


def _wanted(spark, sf_dir):
    c, key = b.table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        (key + 1000000).alias("application_id"), F.concat(F.lit("R"), F.pmod(key, F.lit(3)).cast("string")).alias("reason"),
        F.lit("Q0").alias("question"), F.lit("H1").alias("handoff"),
    )


@b.query("j6_open_requests", b.with_ctes(b.REQUESTS) + WANTED + f"""
SELECT id, application_id, reason, question, resolved, source, FALSE AS changed FROM requests UNION ALL
SELECT NULL, application_id, reason, {b.q(R.ELIGIBILITY_QUESTION)}, FALSE, 'ELIGIBILITY', TRUE FROM wanted w
WHERE NOT EXISTS (SELECT 1 FROM requests r WHERE r.application_id = w.application_id AND r.reason = w.reason AND NOT r.resolved)""")
def j6(spark, sf_dir):
    out = A.open_assistance_requests(b.requests(spark, sf_dir), _wanted(spark, sf_dir), b.now())
    return out.select("id", "application_id", "reason", "question", "resolved", "source", "changed")


@b.query("j7_browser_requests", b.with_ctes(b.REQUESTS) + WANTED + """
, opened AS (SELECT *, row_number() OVER (PARTITION BY application_id ORDER BY id) AS place FROM requests WHERE source = 'BROWSER' AND NOT resolved),
m AS (SELECT coalesce(o.application_id, w.application_id) AS application_id, o.id, o.place, o.reason AS r0, o.question AS q0, o.handoff AS h0,
   w.reason AS r1, w.question AS q1, w.handoff AS h1, w.application_id IS NOT NULL AS has FROM opened o FULL JOIN wanted w ON o.application_id = w.application_id)
SELECT id, application_id, CASE WHEN has AND coalesce(place, 1) = 1 THEN r1 ELSE r0 END AS reason,
  CASE WHEN has AND coalesce(place, 1) = 1 THEN q1 ELSE q0 END AS question, CASE WHEN has AND coalesce(place, 1) = 1 THEN h1 ELSE h0 END AS handoff,
  has AND coalesce(place, 1) > 1 AS resolved, 'BROWSER' AS source,
  has AND (place IS NULL OR place > 1 OR r0 <> r1 OR q0 <> q1 OR h0 <> h1) AS changed FROM m
UNION ALL SELECT id, application_id, reason, question, handoff, resolved, source, FALSE FROM requests WHERE NOT (source = 'BROWSER' AND NOT resolved)""")
def j7(spark, sf_dir):
    out = A.merge_browser_requests(b.requests(spark, sf_dir), _wanted(spark, sf_dir), b.now())
    return out.select("id", "application_id", "reason", "question", "handoff", "resolved", "source", "changed")


OUTCOMES = ", outcomes AS (SELECT c_custkey AS job_id, CASE WHEN c_acctbal > 4000 THEN 'NEEDS_ASSISTANCE' ELSE 'AGENT_CONTINUE' END AS route, " \
    "'BROWSER: CAPTCHA' AS reason FROM customer WHERE c_nationkey < 20)"


@b.query("j8_apply_handoffs", b.with_ctes(b.APPLICATIONS) + OUTCOMES + f"""
, m AS (SELECT coalesce(a.job_id, o.job_id) AS job_id, a.*, o.route, o.reason, a.job_id IS NULL AS fresh,
   coalesce(a.assistance_reason, '') LIKE 'BROWSER:%' AS own FROM applications a FULL JOIN outcomes o ON a.job_id = o.job_id),
n AS (SELECT *, route = 'NEEDS_ASSISTANCE' AS asks, coalesce(assistance_reason, '') = '' OR own AS free,
   route = 'AGENT_CONTINUE' AND coalesce(needs_assistance, FALSE) AND own AS clears FROM m),
d AS (SELECT *, fresh OR (route IS NOT NULL AND coalesce({OPEN}, FALSE) AND CASE WHEN asks
   THEN NOT needs_assistance OR (free AND assistance_reason IS DISTINCT FROM reason) ELSE clears END) AS changed FROM n)
SELECT job_id, coalesce(status, 'PENDING') AS status, changed,
  CASE WHEN NOT changed THEN needs_assistance WHEN asks THEN TRUE ELSE FALSE END AS needs_assistance,
  CASE WHEN NOT changed THEN assistance_reason WHEN asks THEN CASE WHEN free THEN reason ELSE assistance_reason END END AS assistance_reason
FROM d""")
def j8(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer").filter(F.col("c_nationkey") < 20)
    outcomes = c.select(
        F.col("c_custkey").alias("job_id"),
        F.when(F.col("c_acctbal") > 4000, F.lit("NEEDS_ASSISTANCE")).otherwise(F.lit("AGENT_CONTINUE")).alias("route"),
        F.lit("BROWSER: CAPTCHA").alias("reason"),
    )
    state = A.apply_handoffs(b.applications(spark, sf_dir), outcomes, b.now())
    return state.select("job_id", "status", "changed", "needs_assistance", "assistance_reason")


@b.query("j8_resolve_requests", b.with_ctes(b.REQUESTS) + """
SELECT id, resolved OR (source = 'BROWSER' AND hit) AS resolved, source = 'BROWSER' AND NOT resolved AND hit AS changed
FROM (SELECT *, application_id IN (SELECT c_custkey + 1000000 FROM customer WHERE c_acctbal > 4000) AS hit FROM requests)""")
def j8_resolve(spark, sf_dir):
    rich = b.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 4000)
    continued = rich.select((F.col("c_custkey") + 1000000).alias("application_id"))
    return A.resolve_browser_requests(b.requests(spark, sf_dir), continued, b.now()).select("id", "resolved", "changed")


@b.query("j9_block_reasons", b.with_ctes(b.JOBS, b.EVALUATIONS, b.RUNS, b.APPLICATIONS, TIMED) + f"""
, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY completed_at DESC NULLS LAST, run_id DESC) AS r FROM timed) WHERE r = 1)
SELECT j.job_id, CASE WHEN NOT {ACTIVE} THEN 'INACTIVE' WHEN coalesce(route, '') <> 'AGENT_APPLY' THEN 'ROUTE'
  WHEN a.job_id IS NULL THEN 'NO_APPLICATION' WHEN application_method <> 'AGENT' THEN 'METHOD' WHEN NOT ({OPEN}) THEN 'STATUS'
  WHEN needs_assistance AND coalesce(assistance_reason, '') NOT LIKE 'BROWSER:%' THEN 'OTHER_ASSISTANCE'
  WHEN selected_resume_file IS NULL THEN 'NO_PROFILE_FILE' END AS block_reason
FROM jobs j LEFT JOIN latest l ON j.job_id = l.job_id LEFT JOIN applications a ON a.job_id = j.job_id""")
def j9(spark, sf_dir):
    latest = Q.latest_any_run(b.evaluations(spark, sf_dir), b.runs(spark, sf_dir))
    return A.execution_guard(b.jobs(spark, sf_dir), latest, b.applications(spark, sf_dir)).select("job_id", "block_reason")


@b.query("j10_mark_ready", b.with_ctes(b.APPLICATIONS) + f"""
, r AS (SELECT *, job_id IN (SELECT c_custkey FROM customer WHERE c_nationkey > 5) AS ready FROM applications)
SELECT job_id, CASE WHEN ready AND status = 'PENDING' THEN 'IN_PROGRESS' ELSE status END AS status, ready AND status = 'PENDING' AS changed,
       ready AND NOT ({OPEN}) AS refused FROM r""")
def j10(spark, sf_dir):
    ready = b.table(spark, sf_dir, "customer").filter(F.col("c_nationkey") > 5).select(F.col("c_custkey").alias("job_id"))
    return A.mark_ready(b.applications(spark, sf_dir), ready, b.now()).select("job_id", "status", "changed", "refused")


@b.query("j11_run_history", """
WITH history AS (SELECT 'run-' || CAST(n_nationkey AS VARCHAR) AS run_key, -1 AS run_no, 0.0::DOUBLE AS total_seconds FROM nation),
runs AS (SELECT 'run-' || CAST(o_custkey AS VARCHAR) AS run_key, o_orderkey AS run_no, o_totalprice AS total_seconds FROM orders
         QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT * FROM runs UNION ALL SELECT * FROM history WHERE run_key NOT IN (SELECT run_key FROM runs)""")
def j11(spark, sf_dir):
    history = b.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("run-"), F.col("n_nationkey").cast("string")).alias("run_key"), F.lit(-1).cast("bigint").alias("run_no"),
        F.lit(0.0).alias("total_seconds"), F.lit(None).cast("timestamp").alias("at"),
    )
    runs = b.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_key"), F.col("o_orderkey").alias("run_no"),
        F.col("o_totalprice").alias("total_seconds"), F.col("o_orderdate").alias("at"),
    )
    return A.upsert_run_history(history, runs, [F.desc("at"), F.desc("run_no")]).drop("at")


_STATUS = b.pick_sql(R.STATUSES, "event_id")


@b.query("j12_status_changes", b.with_ctes(b.APPLICATIONS) + f"""
, feed AS (SELECT user_id AS job_id, {_STATUS} AS status, ts, event_id FROM events),
last AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1),
applied AS (SELECT job_id, max(ts) AS applied_at FROM feed WHERE status = 'APPLIED' GROUP BY 1)
SELECT a.job_id, coalesce(l.status, a.status) AS status, l.job_id IS NOT NULL AS changed,
       CAST(epoch_us(p.applied_at) // 1000000 AS BIGINT) AS applied_second
FROM applications a LEFT JOIN last l ON l.job_id = a.job_id LEFT JOIN applied p ON p.job_id = a.job_id""")
def j12(spark, sf_dir):
    feed = b.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), b.pick(R.STATUSES, F.col("event_id")).alias("status"), F.col("ts").alias("changed_at"),
        "event_id",
    )
    state = A.change_statuses(b.applications(spark, sf_dir), feed, [F.desc("changed_at"), F.desc("event_id")])
    return state.select("job_id", "status", "changed", F.unix_timestamp("applied_at").alias("applied_second"))


# --- dashboard --------------------------------------------------------------

VIEW = f"""view AS (
  SELECT a.*, j.is_active, j.title, e.run_id, e.score, e.confidence, e.route, e.selected_resume, e.explained, e.o_orderstatus, q.id AS request_id
  FROM applications a LEFT JOIN jobs j ON j.job_id = a.job_id LEFT JOIN last_eval e ON e.job_id = a.job_id
  LEFT JOIN last_request q ON q.application_id = a.application_id)"""
DASH = b.with_ctes(b.JOBS, b.EVALUATIONS, b.REQUESTS, b.APPLICATIONS, LAST, VIEW)
FLAGS = {
    "manual": f"route = 'MANUAL_PRIORITY' AND status = 'PENDING' AND NOT needs_assistance AND {ACTIVE}",
    "assistance": f"needs_assistance AND {ACTIVE}", "agent": f"route = 'AGENT_APPLY' AND NOT needs_assistance AND {ACTIVE}",
    "low_confidence": f"{ACTIVE} AND confidence < 75", "closed": f"NOT {ACTIVE}", "progressed": f"NOT ({OPEN})",
}


def view(spark, sf_dir):
    return Q.dashboard_view(
        b.applications(spark, sf_dir), b.jobs(spark, sf_dir), b.evaluations(spark, sf_dir), b.requests(spark, sf_dir)
    )


@b.query("e7_dashboard_view", DASH + "SELECT application_id, job_id, title, run_id, route, request_id FROM view")
def e7(spark, sf_dir):
    return view(spark, sf_dir).select(
        "application_id", "job_id", "job.title", "evaluation.run_id", "evaluation.route", F.col("browser_request.id").alias("request_id")
    )


@b.query("g8_dashboard_queues", DASH + " UNION ALL ".join(
    f"SELECT '{n}' AS queue, application_id FROM view WHERE {c}" for n, c in FLAGS.items()
))
def g8(spark, sf_dir):
    return Q.queue_membership(view(spark, sf_dir)).select("queue", "application_id")


@b.query("g8_manual_queue", DASH + f"SELECT application_id, score FROM view WHERE {FLAGS['manual']}")
def g8_manual(spark, sf_dir):
    return Q.dashboard_queue(view(spark, sf_dir), "manual").select("application_id", "evaluation.score")


@b.query("g9_run_trend", b.with_ctes(b.RUNS) + """
SELECT 'Run ' || CAST(row_number() OVER (ORDER BY started_at, run_id) AS VARCHAR) AS name, jobs_discovered, jobs_eligible
FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 30)""")
def g9(spark, sf_dir):
    return Q.recent_runs(b.runs(spark, sf_dir)).select("name", "jobs_discovered", "jobs_eligible")


@b.query("h9_evidence_stats", DASH + f"""
SELECT count(*) AS evaluations, count(*) FILTER (score >= 50) AS required_evidence,
  count(*) FILTER (score >= 85 AND confidence >= 75) AS manual_ready,
  {b.round2_sql('coalesce(avg(confidence), 0.0)', 4)} AS avg_confidence, {b.round2_sql('coalesce(avg(score), 0.0)', 4)} AS avg_fit
FROM view WHERE {ACTIVE} AND confidence IS NOT NULL AND explained""")
def h9(spark, sf_dir):
    from ...functions import columns as C

    stats = H.evidence_stats(view(spark, sf_dir))
    return stats.withColumns({n: C.round_half_even(F.col(n), 4) for n in ("avg_confidence", "avg_fit")})


@b.query("h10_outcome_funnel", b.with_ctes(b.APPLICATIONS) + f"""
SELECT count(*) AS total, count(*) FILTER (status = 'APPLIED') AS applied,
  count(*) FILTER (status IN ({', '.join(map(b.q, R.INTERVIEW_STATUSES))})) AS interviews,
  count(*) FILTER (status = 'OFFER') AS offers, count(*) FILTER (status = 'REJECTED') AS rejected FROM applications""")
def h10(spark, sf_dir):
    return H.outcome_funnel(b.applications(spark, sf_dir))


_GOOD = ", ".join(map(b.q, ["OA", *R.INTERVIEW_STATUSES, "OFFER"]))


@b.query("h11_method_comparison", b.with_ctes(b.APPLICATIONS) + f"""
SELECT application_method, count(*) AS total, count(*) FILTER (status IN ({_GOOD})) AS positive,
  {b.round2_sql(f"CAST(count(*) FILTER (status IN ({_GOOD})) AS DOUBLE) / count(*) * 100.0::DOUBLE", 1)} AS rate
FROM applications GROUP BY 1""")
def h11(spark, sf_dir):
    return H.method_comparison(b.applications(spark, sf_dir))


@b.query("h12_profile_usage", DASH + "SELECT selected_resume AS profile, count(*) AS count FROM view WHERE selected_resume <> '' GROUP BY 1")
def h12(spark, sf_dir):
    return H.profile_usage(view(spark, sf_dir))


@b.query("h13_headline_metrics", DASH + f"""
SELECT count(*) AS tracked, count(*) FILTER ({FLAGS['manual']}) AS manual,
  count(*) FILTER ({FLAGS['agent']} AND status = 'PENDING') AS agent_pending, count(*) FILTER ({FLAGS['assistance']}) AS assistance,
  count(*) FILTER ({FLAGS['low_confidence']}) AS low_confidence, count(*) FILTER ({FLAGS['progressed']}) AS progressed,
  count(*) FILTER ({FLAGS['closed']}) AS closed FROM view""")
def h13(spark, sf_dir):
    return H.headline_metrics(view(spark, sf_dir))


@b.query("i1_accepted_or_review", b.with_ctes(b.EVALUATIONS) + """
SELECT job_id, run_id FROM evaluations WHERE score >= 85 UNION ALL SELECT job_id, run_id FROM evaluations WHERE score < 85 AND confidence < 50""")
def i1(spark, sf_dir):
    e = b.evaluations(spark, sf_dir)
    accepted = e.filter(F.col("score") >= S.MANUAL_THRESHOLD)
    review = e.filter((F.col("score") < S.MANUAL_THRESHOLD) & (F.col("confidence") < 50))
    return accepted.unionByName(review).select("job_id", "run_id")
