import json

import pytest
from pyspark.sql import functions as F

from rolegrain.operators import text as X
from rolegrain.plans import scan
from rolegrain.plans.queries import bindings as b
from rolegrain.plans.queries import ranking
from rolegrain.sources import companies, reports, snapshots
from rolegrain.streaming import snapshots as stream


def test_company_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"name": " A ", "board_token": "x"}, {"name": "B", "board_token": "X"}, {"name": "", "enabled": False}]))
    assert [(r.name, r.board_token) for r in companies.load_companies(spark, str(path)).collect()] == [("A", "x")]
    path.write_text(json.dumps([{"name": "A", "board_token": " "}]))
    with pytest.raises(Exception, match="board_token"):
        companies.load_companies(spark, str(path))
    assert companies.company_problems(companies.parse_companies(spark.read.text(str(path), wholetext=True))).count() == 1


def landed(path, board, ids):
    jobs = [{"id": i, "title": "Software Engineer", "absolute_url": "u", "content": "&lt;p&gt;Experience with Python.&lt;/p&gt;",
             "location": {"name": "Austin, Texas"}, "offices": [{"name": "HQ", "location": {"name": "Paris"}}, {"name": None, "location": "Rome"}],
             "metadata": [{"name": "Employment Type", "value": ["Full Time", "x"]}, {"name": "N", "value": 5}]} for i in ids]
    path.write_text(json.dumps({"board_token": board, "company": "C", "run_id": "r", "jobs": jobs}))


def test_snapshot_files_and_stream(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    landed(source / "a.json", "a", [1, "2"])
    rows = snapshots.read_snapshots(spark, str(source)).orderBy("posting_id").collect()
    assert [r.posting_id for r in rows] == ["1", "2"]
    assert [o.location_values for o in rows[0].offices] == [["Paris"], ["Rome"]]
    assert [m.value for m in rows[0].metadata] == [["Full Time", "x"], ["5"]]

    def handle(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out-{number}"))

    for number, board in enumerate("ab"):
        landed(source / f"{board}.json", board, [number])
        query = stream.run_available(stream.stream_postings(spark, str(source)), handle, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
    assert [r.board_token for r in spark.read.parquet(str(tmp_path / "out-1")).collect()] == ["b"]


def test_report_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"run_id": "x", "limit": 3, "results": [{"queue_status": "ERROR"}, {"outcome": "READY_NO_SUBMIT"}]}))
    assert reports.queue_results(reports.read_queue_reports(spark, str(tmp_path / "r.json"))).count() == 2
    (tmp_path / "i.json").write_text(json.dumps({"page_title": "t", "fields": [{"label": "a"}, {"label": "b", "required": True}]}))
    fields = reports.form_fields(reports.read_inspections(spark, str(tmp_path / "i.json")))
    assert [(r.field_no, r.label) for r in fields.orderBy("field_no").collect()] == [(0, "a"), (1, "b")]


def test_whole_scan(spark, sf_dir):
    """One scan over all postings of the small data; a second one changes nothing but stamps."""
    postings = b.postings(spark, sf_dir).withColumn("run_id", F.lit("r1"))
    keys = ["board_token", "posting_id"]
    vectors = b.table(spark, sf_dir, "embeddings")
    chunks = postings.select(*keys, "doc_id").join(
        vectors.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("chunk_no"), F.col("embedding").alias("vec")), "doc_id"
    ).drop("doc_id")
    profile_chunks = vectors.filter("vec_id < 16").select(b.pick(ranking.S.PROFILES, F.col("vec_id")).alias("profile"), F.col("embedding").alias("vec"))
    jobs = b.jobs(spark, sf_dir).withColumn("job_id", F.col("job_id").cast("string")).limit(0)
    applications = b.applications(spark, sf_dir).withColumn("job_id", F.col("job_id").cast("string")).limit(0)
    evaluations = spark.createDataFrame([], "run_id string, job_id string")
    requests = b.requests(spark, sf_dir).withColumn("application_id", F.col("application_id").cast("string")).limit(0)
    out = scan.run(
        postings, ranking.profiles(spark), profile_chunks, chunks, jobs, evaluations, applications, requests, "r1", b.now()
    )
    passed = scan.survivors(out["annotated"]).groupBy("eligibility.decision").count().collect()
    counts = {r.decision: r["count"] for r in passed}
    assert out["best"].count() == counts["PASS"] == out["evaluations"].count()
    state = out["applications"].groupBy("needs_assistance").count().collect()
    assert {r.needs_assistance: r["count"] for r in state} == {False: counts["PASS"], True: counts["NEEDS_ASSISTANCE"]}
    assert out["jobs"].count() == sum(counts.values()) and out["requests"].count() == counts["NEEDS_ASSISTANCE"]
    assert out["best"].filter("final_score > 100 or final_score < 0").count() == 0
    plain = scan.annotate(postings, text="body").filter(scan.passes_short_rules()).select(*keys, "experience_status")
    parsed = out["annotated"].filter(scan.passes_short_rules()).select(*keys, "experience_status")
    # The heading stands in front of the parsed page, so only its own effect may differ.
    assert plain.count() == parsed.count()


def scan_tables(spark, sf_dir, owners=False):
    """Empty state tables."""
    jobs = b.jobs(spark, sf_dir).withColumn("job_id", F.col("job_id").cast("string")).limit(0)
    applications = b.applications(spark, sf_dir).withColumn("job_id", F.col("job_id").cast("string")).limit(0)
    evaluations = spark.createDataFrame([], "run_id string, job_id string")
    requests = b.requests(spark, sf_dir).withColumn("application_id", F.col("application_id").cast("string")).limit(0)
    tables = [jobs, evaluations, applications, requests]
    return [t.withColumn("owner_id", F.lit("x")) for t in tables] if owners else tables


def test_owners_stay_apart_in_a_scan(spark, sf_dir):
    schema = ("owner_id string, board_token string, posting_id string, company string, title string, url string, content string, "
              "location struct<name: string>, offices array<struct<name: string, location_values: array<string>>>, "
              "metadata array<struct<name: string, value: array<string>>>")
    page = "&lt;p&gt;You must have experience with Python.&lt;/p&gt;"
    rows = [(o, "acme", i, "c", "Software Engineer", "u", page, ("Austin, Texas",), [], []) for o in "xy" for i in ("1", "2", None, " ", "1")]
    rows = [r for r in rows if r[:3] != ("y", "acme", "2")]
    postings = spark.createDataFrame(rows, schema)
    vectors = spark.createDataFrame([("acme", "1", [1.0, 0.0])], "board_token string, posting_id string, vec array<double>")
    profile = spark.createDataFrame([(ranking.S.PROFILES[0], [1.0, 0.0])], "profile string, vec array<double>")
    state = scan_tables(spark, sf_dir, owners=True)
    out = scan.run(postings, ranking.profiles(spark), profile, vectors, *state, "r1", b.now())
    assert sorted((r.owner_id, str(r.posting_id)) for r in out["annotated"].collect()) == [
        ("x", "1"), ("x", "2"), ("x", "None"), ("x", "None"), ("y", "1"), ("y", "None"), ("y", "None")]
    first = {(r.owner_id, r.posting_id): r.job_id for r in out["jobs"].collect()}
    assert set(first) == {("x", "1"), ("x", "2"), ("y", "1")} and len(set(first.values())) == 3
    for name in ("evaluations", "applications"):
        assert sorted((r.owner_id, r.job_id) for r in out[name].collect()) == sorted((o, j) for (o, _), j in first.items())
    assert {(r.owner_id, r.posting_id): r.semantic_raw for r in out["best"].collect()}[("x", "2")] == 0.0
    # The second scan: one owner's posting is gone, the other's is not touched.
    later = postings.filter("not (owner_id = 'x' and posting_id = '1')")
    state = [out[n] for n in ("jobs", "evaluations", "applications", "requests")]
    again = scan.run(later, ranking.profiles(spark), profile, vectors, *state, "r2", b.now())
    rows = {(r.owner_id, r.posting_id): (r.is_active, r.job_id) for r in again["jobs"].collect()}
    assert rows == {k: (k != ("x", "1"), j) for k, j in first.items()}
    with pytest.raises(ValueError, match="owner_id"):
        scan.run(postings, ranking.profiles(spark), profile, vectors, *scan_tables(spark, sf_dir), "r1", b.now())


def test_html_goes_only_to_survivors(spark, sf_dir):
    annotated = scan.annotate(b.postings(spark, sf_dir))
    assert annotated.filter(~scan.passes_short_rules() & (F.length("parsed.text") > 0)).count() == 0
