import datetime as dt

from pyspark.sql import functions as F

from rolegrain.operators import applications as A
from rolegrain.operators import lifecycle as J

STAMP = "2024-06-01"
OLD = dt.datetime(2024, 1, 1)
APPLICATION = ("job_id int, application_method string, status string, needs_assistance boolean, assistance_reason string, "
               "created_at timestamp, last_updated_at timestamp")


def test_stale_postings(spark):
    tracked = spark.createDataFrame(
        [("a", "123", True), ("a", "456", None), ("a", "789", True), ("a", "1", False), ("a", "", True), ("b", "5", True)],
        "board_token string, posting_id string, is_active boolean",
    )
    live = spark.createDataFrame([("a", "123"), ("a", " 789 "), ("b", None), ("b", " ")], "board_token string, posting_id string")
    assert [(r.board_token, r.posting_id) for r in J.find_stale(tracked, live).collect()] == [("a", "456")]
    report = {r.board_token: r for r in J.lifecycle_report(tracked, live).collect()}
    assert report["b"].reason == "EMPTY_LIVE_SET" and report["a"].stale_count == 1 and report["a"].live_count == 2


def apps(spark, *rows):
    return spark.createDataFrame([(*r, OLD, OLD) for r in rows], APPLICATION)


def by_job(frame):
    return {r.job_id: (r.application_method, r.status, r.needs_assistance, r.assistance_reason, r.changed) for r in frame.collect()}


def test_progressed_applications_are_never_touched(spark):
    state = apps(
        spark, (1, "AGENT", "APPLIED", True, "ELIGIBILITY: X"), (2, "AGENT", "PENDING", True, "ELIGIBILITY: X"),
        (3, "AGENT", "PENDING", True, "BROWSER: X"), (4, "AGENT", "IN_PROGRESS", False, None),
    )
    routed = spark.createDataFrame([(i, "AGENT_APPLY") for i in (1, 2, 3)] + [(5, "MANUAL_PRIORITY")], "job_id int, route string")
    assert by_job(A.ensure_applications(state, routed, F.to_timestamp(F.lit(STAMP)))) == {
        1: ("AGENT", "APPLIED", True, "ELIGIBILITY: X", False), 2: ("AGENT", "PENDING", False, None, True),
        3: ("AGENT", "PENDING", True, "BROWSER: X", False), 4: ("AGENT", "IN_PROGRESS", False, None, False),
        5: ("MANUAL", "PENDING", False, None, True),
    }
    flagged = spark.createDataFrame([(1, "Y"), (2, "X"), (4, "Y"), (6, "Y")], "job_id int, reason string")
    out = by_job(A.ensure_assistance(state, flagged, F.to_timestamp(F.lit(STAMP))))
    assert out[1] == ("AGENT", "APPLIED", True, "ELIGIBILITY: X", False) and out[2][-1] is False
    assert out[4] == ("AGENT", "IN_PROGRESS", True, "ELIGIBILITY: Y", True) and out[6][2:] == (True, "ELIGIBILITY: Y", True)


def test_handoffs_keep_other_reasons(spark):
    state = apps(
        spark, (1, "AGENT", "PENDING", True, "ELIGIBILITY: X"), (2, "AGENT", "PENDING", True, "BROWSER: A"),
        (3, "AGENT", "PENDING", False, None), (4, "AGENT", "OFFER", True, "BROWSER: A"),
    )
    ask = spark.createDataFrame([(i, "NEEDS_ASSISTANCE", "BROWSER: B") for i in (1, 2, 3, 4, 5)], "job_id int, route string, reason string")
    out = by_job(A.apply_handoffs(state, ask, F.to_timestamp(F.lit(STAMP))))
    assert [out[i][3] for i in (1, 2, 3, 4, 5)] == ["ELIGIBILITY: X", "BROWSER: B", "BROWSER: B", "BROWSER: A", "BROWSER: B"]
    go = spark.createDataFrame([(i, "AGENT_CONTINUE", "") for i in (1, 2, 4, 6)], "job_id int, route string, reason string")
    out = by_job(A.apply_handoffs(state, go, F.to_timestamp(F.lit(STAMP))))
    assert out[1][3] == "ELIGIBILITY: X" and out[2][2:] == (False, None, True) and out[4][4] is False and out[6][2] is False


def test_one_open_browser_request(spark):
    schema = ("id int, application_id int, source string, resolved boolean, reason string, question string, handoff string, "
              "handoff_version int, updated_at timestamp")
    requests = spark.createDataFrame(
        [(1, 7, "BROWSER", False, "r", "q", "h", 1, OLD), (2, 7, "BROWSER", False, "r", "q", "h", 1, OLD),
         (3, 7, "ELIGIBILITY", False, "e", "q", None, None, OLD), (4, 8, "BROWSER", True, "r", "q", "h", 1, OLD)], schema)
    new = spark.createDataFrame([(7, "r2", "q", "h"), (8, "r", "q", "h")], "application_id int, reason string, question string, handoff string")
    rows = {(r.id, r.application_id): (r.reason, r.resolved, r.changed) for r in A.merge_browser_requests(requests, new, F.to_timestamp(F.lit(STAMP))).collect()}
    assert rows == {(1, 7): ("r2", False, True), (2, 7): ("r", True, True), (3, 7): ("e", False, False),
                    (4, 8): ("r", True, False), (None, 8): ("r", False, True)}


def test_status_feed(spark):
    state = apps(spark, (1, "AGENT", "PENDING", False, None), (2, "AGENT", "PENDING", False, None)).withColumn(
        "applied_at", F.lit(None).cast("timestamp"))
    at = lambda d: dt.datetime(2024, 2, d)
    feed = spark.createDataFrame([(1, "APPLIED", at(1)), (1, "OA", at(2))], "job_id int, status string, changed_at timestamp")
    out = {r.job_id: (r.status, r.applied_at, r.last_updated_at) for r in A.change_statuses(state, feed).collect()}
    assert out == {1: ("OA", at(1), at(2)), 2: ("PENDING", None, OLD)}


def test_a_posting_seen_twice_is_one_row(spark):
    schema = "board_token string, posting_id string, title string, is_active boolean, last_seen_at timestamp, updated_at timestamp"
    state = spark.createDataFrame([("a", "9", "old", True, OLD, OLD)], schema)
    seen = spark.createDataFrame(
        [("a", "1", "first", dt.datetime(2024, 1, 1)), ("a", "1", "last", dt.datetime(2024, 1, 2)), ("a", "9", "new", dt.datetime(2024, 1, 1))],
        "board_token string, posting_id string, title string, fetched_at timestamp",
    )
    now = F.to_timestamp(F.lit(STAMP))
    for _ in range(2):
        state = J.upsert_postings(state, seen, now).drop("changed")
    assert sorted((r.posting_id, r.title) for r in state.collect()) == [("1", "last"), ("9", "new")]


def test_owners_do_not_meet(spark):
    schema = "owner_id string, board_token string, posting_id string, title string, is_active boolean, last_seen_at timestamp, updated_at timestamp"
    state = spark.createDataFrame([("x", "a", "1", "old", True, OLD, OLD), ("y", "a", "1", "old", True, OLD, OLD)], schema)
    seen = spark.createDataFrame([("x", "a", "1", "new"), ("x", "a", "2", "new")], "owner_id string, board_token string, posting_id string, title string")
    out = J.upsert_postings(state, seen, F.to_timestamp(F.lit(STAMP)))
    assert sorted((r.owner_id, r.posting_id, r.title, r.changed) for r in out.collect()) == [
        ("x", "1", "new", True), ("x", "2", "new", True), ("y", "1", "old", False)]
    gone = spark.createDataFrame([("x", "a", "2"), ("y", "b", "1")], "owner_id string, board_token string, posting_id string")
    assert [(r.owner_id, r.posting_id) for r in J.find_stale(state, gone).collect()] == [("x", "1")]
    history = spark.createDataFrame([("x", "run", 1), ("y", "run", 1)], "owner_id string, run_key string, n int")
    runs = spark.createDataFrame([("x", "run", 2), ("x", "run", 3)], "owner_id string, run_key string, n int")
    rows = A.upsert_run_history(history, runs, [F.desc("n")]).collect()
    assert sorted((r.owner_id, r.n) for r in rows) == [("x", 3), ("y", 1)]
    saved = A.save_evaluations(
        spark.createDataFrame([("x", 1, 1, 5.0), ("y", 1, 1, 5.0)], "owner_id string, run_id int, job_id int, score double"),
        spark.createDataFrame([("x", 1, 1, 7.0), ("x", 1, 1, 6.0)], "owner_id string, run_id int, job_id int, score double"),
    )
    assert sorted((r.owner_id, r.score) for r in saved.collect()) == [("x", 7.0), ("y", 5.0)]


def test_fresh_scan_is_a_finished_scan_of_all_boards(spark):
    from rolegrain.operators import queues as Q

    at = lambda d: dt.datetime(2024, 2, d)
    rows = [("x", i, "multi", at(i), at(i) if i < 3 else None) for i in range(1, 12)] + [("x", 20, "acme", at(20), at(20)), ("y", 21, "multi", at(21), at(21))]
    runs = spark.createDataFrame(rows, "owner_id string, run_id int, board_token string, started_at timestamp, completed_at timestamp")
    since = F.to_timestamp(F.lit("2024-01-01"))
    assert [r.run_id for r in Q.fresh_scan(runs, since, "x").collect()] == [2]
    assert [r.run_id for r in Q.fresh_scan(runs, since).collect()] == [21]
    assert Q.fresh_scan(runs, F.to_timestamp(F.lit("2024-03-01"))).count() == 0


def test_reports_and_ids_per_owner(spark):
    tracked = spark.createDataFrame(
        [("x", "a", "1", True, 11), ("x", "a", "2", True, 12), ("y", "a", "1", True, 21), ("y", "b", "1", True, 22)],
        "owner_id string, board_token string, posting_id string, is_active boolean, job_id int",
    )
    live = spark.createDataFrame([("x", "a", "1"), ("y", "a", "1"), ("y", "a", "3")], "owner_id string, board_token string, posting_id string")
    report = J.lifecycle_report(tracked, live)
    rows = {(r.owner_id, r.board_token): (r.live_count, r.tracked_active_count, r.stale_count, r.skipped) for r in report.collect()}
    assert rows == {("x", "a"): (1, 2, 1, False), ("y", "a"): (2, 1, 0, False), ("y", "b"): (0, 0, 0, True)}
    totals = {r.owner_id: (r.boards_inspected, r.boards_skipped, r.would_close) for r in J.lifecycle_totals(report).collect()}
    assert totals == {"x": (1, 0, 1), "y": (1, 1, 0)}
    assert sorted((r.owner_id, r.job_id) for r in J.resolve_job_ids(live, tracked).collect()) == [("x", 11), ("y", 21)]
    # Without owners on one side the report counts boards alone, each id once.
    alone = J.lifecycle_report(tracked.drop("owner_id"), live)
    assert {r.board_token: (r.live_count, r.tracked_active_count) for r in alone.collect()} == {"a": (2, 3), "b": (0, 0)}


def test_last_per_key_reads_texts_as_one_hash(spark):
    from rolegrain.functions import columns as C

    df = spark.createDataFrame([(1, OLD, 5, "long" * 99), (1, OLD, 7, "b"), (1, OLD, 7, "b"), (2, None, 1, None)], "k int, fetched_at timestamp, n int, t string")
    kept = C.last_per_key(df, ["k"])
    assert sorted((r.k, r.n) for r in kept.collect()) == [(1, 7), (2, 1)]
    assert "xxhash64" in kept._jdf.queryExecution().optimizedPlan().toString()
