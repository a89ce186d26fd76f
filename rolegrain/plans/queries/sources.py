"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ...operators import text as X
from ...session import scratch_path
from ...sources import board_files, companies, reports, snapshots
from . import bindings as b

_BLOCK = 100  # entries per landed company list
_PAGE = 1000  # postings per landed board file


@b.query("a1_companies", """
WITH entries AS (
  SELECT c_custkey AS n, c_name AS name,
         CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END || '-'
           || CAST(c_custkey % 50 AS VARCHAR) AS board_token,
         CASE WHEN c_acctbal < 0 THEN FALSE WHEN c_acctbal < 5000 THEN TRUE END AS enabled
  FROM customer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lower(board_token) ORDER BY n) AS r FROM entries
           WHERE coalesce(enabled, TRUE))
SELECT name, board_token FROM ranked WHERE r = 1""")
def a1(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    token = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    entry = F.struct(
        F.col("c_custkey").alias("n"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"),
        F.concat(token, F.lit("-"), (F.col("c_custkey") % 50).cast("string"), F.lit(" ")).alias("board_token"),
        F.when(F.col("c_acctbal") < 0, F.lit(False)).when(F.col("c_acctbal") < 5000, F.lit(True)).alias("enabled"),
    )
    documents = c.groupBy(F.floor(F.col("c_custkey") / _BLOCK).alias("document")).agg(
        F.to_json(F.array_sort(F.collect_list(entry))).alias("value")
    )
    return companies.enabled_companies(companies.parse_companies(documents)).select("name", "board_token")


def _landed(spark, sf_dir):
    """Folder of board files of up to 1,000 jobs, as a fetcher lands them: one document without line breaks inside the array."""
    p = b.postings(spark, sf_dir)
    office = F.get("offices", F.lit(0))
    job = F.struct(
        F.col("posting_id").alias("id"), "title", F.col("url").alias("absolute_url"), "content",
        F.col("company").alias("company_name"), "location",
        F.array(F.struct(
            office["name"].alias("name"),
            F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.get(office["location_values"], F.lit(0)).alias("name"))))
            .otherwise(F.get(office["location_values"], F.lit(0))).alias("location"),
        )).alias("offices"),
        F.transform("metadata", lambda m: F.struct(
            m["name"].alias("name"),
            F.when(F.col("doc_id") % 3 == 0, F.get(m["value"], F.lit(0))).otherwise(F.to_json(m["value"])).alias("value"),
        )).alias("metadata"),
    )
    page = F.floor(F.col("doc_id") / _PAGE)
    rows = p.select("board_token", page.alias("page"), "doc_id", F.to_json(job).alias("job")).withColumn("board", F.sha2(F.coalesce("board_token", F.lit("")), 256))
    within = Window.partitionBy("board", "page")
    ordered = within.orderBy("doc_id")
    head = F.to_json(F.struct("board_token", F.lit("run-1").alias("run_id")))
    begin = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(', "fetch_status": "SUCCESS", "jobs": ['))
    line = F.concat(
        F.when(F.row_number().over(ordered) == 1, begin).otherwise(F.lit(",")), "job",
        F.when(F.row_number().over(ordered) == F.count("*").over(within), F.lit(']}')).otherwise(F.lit("")),
    )
    path = scratch_path(spark, f"landed-{uuid.uuid4().hex}")
    lines = rows.withColumn("head", head).select("board", "page", "doc_id", line.alias("value"))
    lines.sortWithinPartitions("board", "page", "doc_id").select("board", "page", "value").write.partitionBy("board", "page").option("lineSep", " ").text(path)
    return path


@b.query("a2_snapshot_postings", b.with_ctes(b.POSTINGS) + """
SELECT board_token, company, posting_id, title, url, location, len(text) AS text_chars, office, office_location,
       field, CASE WHEN doc_id % 3 = 0 THEN value_1 ELSE value_1 || '|' || value_2 END AS field_values
FROM p""")
def a2(spark, sf_dir):
    p = snapshots.read_snapshots(spark, _landed(spark, sf_dir))
    start = F.length(F.substring_index("content", "&lt;p&gt;", 1)) + F.length(F.lit("&lt;p&gt;"))
    office, field = F.get("offices", F.lit(0)), F.get("metadata", F.lit(0))
    return p.select(
        "board_token", "company", "posting_id", "title", "url", F.col("location.name").alias("location"),
        (F.length("content") - start - F.length(F.lit("&lt;/p&gt;"))).cast("bigint").alias("text_chars"),
        office["name"].alias("office"), F.get(office["location_values"], F.lit(0)).alias("office_location"),
        field["name"].alias("field"), F.array_join(field["value"], "|").alias("field_values"),
    )


@b.query("a2_fetch_status", "SELECT DISTINCT source AS board_token, 'SUCCESS' AS fetch_status FROM documents")
def a2_status(spark, sf_dir):
    return board_files.read_boards(spark, _landed(spark, sf_dir))[1]


@b.query("a3_profile_corpus", """
SELECT doc_id, len(text) AS characters,
       len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words
FROM documents""")
def a3(spark, sf_dir):
    corpus = snapshots.profile_corpus(b.documents(spark, sf_dir))
    return corpus.select("doc_id", F.col("characters").cast("bigint"), F.col("words").cast("bigint"))


_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"


@b.query("a4_board_tokens", f"""
SELECT page_id, CASE page_id % 4
  WHEN 0 THEN nullif(coalesce(list_filter(string_split({_PATH}, '/'),
       lambda x: x <> '' AND lower(x) NOT IN ('embed', 'job_board', 'jobs'))[1], ''), '')
  WHEN 1 THEN 'b' || CAST(page_id AS VARCHAR)
  WHEN 2 THEN 'token-' || CAST(page_id AS VARCHAR) END AS board_token
FROM pages""")
def a4(spark, sf_dir):
    pages, page = b.table(spark, sf_dir, "pages"), F.col("page_id")
    path = F.regexp_extract("url", "^https?://[^/?#]+([^?#]*)", 1)
    value = (
        F.when(page % 4 == 0, F.concat(F.lit("https://Boards.Greenhouse.io/embed/JOBS"), path))
        .when(page % 4 == 1, F.concat(F.lit(" https://boards.greenhouse.io/embed/job_board?x=1&for=b"), page.cast("string")))
        .when(page % 4 == 2, F.concat(F.lit("/token-"), page.cast("string"), F.lit("/ ")))
        .otherwise(F.col("url"))
    )
    return pages.select("page_id", X.board_token(value).alias("board_token"))


FORM_LABELS = [
    "First Name*", "Email*", "Are you legally authorized to work in the US?*",
    "Will you now or in the future require sponsorship?*", "How did you hear about us?*", "Gender",
]


@b.query("a5_form_fields", f"""
SELECT c_custkey, 'Job Application for ' || c_mktsegment || ' at ' || c_name AS page_title, n AS field_no,
       {b.sql_list(FORM_LABELS)}[n + 1] AS label, n < 5 AS required, CAST(n AS VARCHAR) || '|x' AS options
FROM customer, (SELECT CAST(unnest(range({len(FORM_LABELS)})) AS INTEGER) AS n)""")
def a5(spark, sf_dir):
    c = b.table(spark, sf_dir, "customer")
    fields = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit("text").alias("type"), F.lit(n < 5).alias("required"),
            F.array(F.lit(str(n)), F.lit("x")).alias("options"),
        )
        for n, label in enumerate(FORM_LABELS)
    ])
    title = F.concat(F.lit("Job Application for "), "c_mktsegment", F.lit(" at "), "c_name")
    documents = c.select("c_custkey", F.to_json(F.struct(title.alias("page_title"), fields.alias("fields"))).alias("value"))
    rows = reports.form_fields(reports.parse_inspections(documents))
    return rows.select(
        "c_custkey", "page_title", "field_no", "label", "required", F.array_join("options", "|").alias("options")
    )


def queue_reports(spark, sf_dir):
    """Run reports out of orders: at most 20 results each."""
    o, key = b.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    result = F.struct(
        key.alias("n"), F.col("o_orderpriority").alias("board_token"), F.col("o_custkey").cast("string").alias("posting_id"),
        F.lit(" Company ").alias("company"), F.lit("Title").alias("title"),
        b.pick(["COMPLETED", "BLOCKED", "ERROR", "COMPLETED", "LOST"], key).alias("queue_status"),
        b.pick(["NEEDS_ASSISTANCE", "READY_NO_SUBMIT", None, "OTHER"], key).alias("outcome"),
        (F.col("o_orderstatus") == "F").alias("challenge_detected"), (key % 7 - 1).cast("int").alias("ready_count"),
        (key % 3).cast("int").alias("required_human_count"), (F.col("o_orderstatus") == "O").alias("browser_modified"),
    )
    run = F.floor(key / 20)
    return o.groupBy(run.alias("run")).agg(
        F.array_sort(F.collect_list(result)).alias("results"), F.max("o_orderdate").alias("at"),
        F.sum("o_totalprice").alias("price"),
    ).select(
        F.to_json(F.struct(
            F.when(F.col("run") % 9 != 8, F.concat(F.lit("run-"), F.col("run").cast("string"))).alias("run_id"),
            F.date_format("at", "yyyy-MM-dd").alias("started_at"), (F.col("price") / 3e5 - 8).alias("total_seconds"),
            (F.col("run") % 60).cast("int").alias("limit"),
            b.pick(["oldest", "fit", "random", None], F.col("run")).alias("order"),
            (F.col("run") % 11 == 10).alias("application_submitted"), "results",
        )).alias("value")
    )


QUEUE_REPORTS = f"""results AS (
  SELECT o_orderkey // 20 AS run, o_orderkey, o_orderkey % 20 AS result_no, o_orderpriority AS board_token,
         CAST(o_custkey AS VARCHAR) AS posting_id,
         {b.pick_sql(['COMPLETED', 'BLOCKED', 'ERROR', 'COMPLETED', 'LOST'], 'o_orderkey')} AS queue_status,
         {b.pick_sql(['NEEDS_ASSISTANCE', 'READY_NO_SUBMIT', None, 'OTHER'], 'o_orderkey')} AS outcome,
         o_orderstatus = 'F' AS challenge_detected, CAST(o_orderkey % 7 - 1 AS INTEGER) AS ready_count,
         CAST(o_orderkey % 3 AS INTEGER) AS required_human_count, o_orderstatus = 'O' AS browser_modified,
         o_orderdate, o_totalprice
  FROM orders)"""


@b.query("a6_queue_results", b.with_ctes(QUEUE_REPORTS) + """
SELECT CASE WHEN run % 9 <> 8 THEN 'run-' || CAST(run AS VARCHAR) END AS run_id, CAST(result_no AS INTEGER) AS result_no,
       board_token, posting_id, queue_status, outcome, challenge_detected, ready_count, required_human_count,
       browser_modified
FROM results""")
def a6(spark, sf_dir):
    rows = reports.queue_results(reports.parse_queue_reports(queue_reports(spark, sf_dir)))
    return rows.select(
        "run_id", "result_no", "board_token", "posting_id", "queue_status", "outcome", "challenge_detected",
        "ready_count", "required_human_count", "browser_modified",
    )


@b.query("a7_report_sink", """
SELECT o_orderpriority AS run_key, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS run_date, count(*) AS postings
FROM orders GROUP BY ALL""")
def a7(spark, sf_dir):
    quarter = F.date_trunc("quarter", "o_orderdate").alias("completed_at")
    summary = b.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run_key"), quarter).agg(
        F.count("*").alias("postings")
    )
    target = scratch_path(spark, f"reports-{uuid.uuid4().hex}")
    reports.write_reports(summary, target, F.col("completed_at"))
    return spark.read.parquet(target).select("run_key", F.col("run_date").cast("date"), "postings")
