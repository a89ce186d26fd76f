"""How the operators read the given tables, in Spark and in SQL.

Postings are derived from ``documents``: two requirement lines by document
number in front of the whole text.  Jobs, evaluations, applications and
requests come from ``customer`` and ``orders``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators import text as X
from ...rules import boards as B
from ...rules import scoring as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


#: Keys of the tables with long texts, and the number of files below which they are dealt out by key.
LONG_TEXTS, FEW_FILES = {"documents": "doc_id", "pages": "page_id"}, 8


def query(name: str, sql: str | None = None):
    """Register a query with the SQL that must give the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # The given long-text tables may come as one file of one row group, which no reader setting can split.
    # A table of at least as many files as there are cores is read as it lies.
    key, cores = LONG_TEXTS.get(name), spark.sparkContext.defaultParallelism
    return frame.repartition(cores, key) if key and len(frame.inputFiles()) < min(cores, FEW_FILES) else frame


def dealt(frame: DataFrame, key: str) -> DataFrame:
    """Short rows that each become many: laid out by key over the shuffle partitions, so what they become is spread like them.

    All that is grouped or joined by this key behind it needs no shuffle of its own. The number is fixed, as their size tells nothing.
    """
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# --- literals ---------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: Sequence) -> str:
    return "[" + ", ".join(q(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in values) + "]"


def pick_sql(values: Sequence, index: str) -> str:
    return f"list_extract({sql_list(values)}, CAST(({index}) % {len(values)} AS INTEGER) + 1)"


def pick(values: Sequence, index: Column) -> Column:
    array = F.array(*[F.lit(v) for v in values])
    return F.element_at(array, (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def matches_sql(text: str, patterns: Sequence[str]) -> str:
    return f"regexp_matches({text}, {q('(?i)(?:' + '|'.join(patterns) + ')')})"


def contains_sql(text: str, phrases: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def squash_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def first_match_sql(text: str, patterns: Sequence[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {q('(?i)' + p)}), '')" for p in patterns) + ")"


def round2_sql(value: str, digits: int = 2) -> str:
    return f"CAST(printf('%.{digits}f', {value}) AS DOUBLE)"


def case_sql(rungs: Sequence[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rungs) + f" ELSE {default} END"


# --- postings ---------------------------------------------------------------

TITLES = [
    "Software Engineer, Platform", "Senior Software Engineer", "Backend Engineer - Payments", "Frontend Engineer",
    "Machine Learning Engineer, Radar", "Full Stack Engineer", "DevOps Engineer, Infrastructure & Security",
    "Site Reliability Engineer", "Software Engineer Intern", "Software Engineer - 6 Month Contract",
    "Smart Contract Software Engineer (Contract)", "Production Support Engineer", "IT Systems Engineer",
    "Product Designer", "Staff Backend Engineer", "Software Engineer, Gen AI",
]
LOCATIONS = [
    "San Francisco, CA", "Remote - US", "London, United Kingdom", "", "N/A", "Toronto, Canada", "New York",
    "Berlin, Germany", "Austin, Texas", "Remote", "Chicago", "Dublin, Ireland", "Seattle, WA", "Springfield, IL",
]
OFFICES = ["New York Office", "Berlin", "Remote", "Canada", ""]
EMPLOYMENT = ["Full Time", "full_time", "Part-time", "Regular", "Contract", ""]
FIELDS = ["Employment Type", "Department", "Time Type"]
HEADINGS = ["Requirements", "What you'll do", "Nice to have", "About us", "What we look for"]
LINES = [
    "Minimum 3 years of professional experience with Python and SQL.",
    "At least 5 years of software engineering experience required.",
    "2-5 years of hands-on experience building backend services in Java or Go.",
    "Experience with AWS, Kubernetes (Docker, Terraform or Ansible) and Kafka.",
    "Preferred: experience with React or TypeScript.",
    "Must have an active secret clearance.",
    "No security clearance required for this position.",
    "U.S. citizenship is required for this position.",
    "We are unable to provide visa sponsorship for this role.",
    "Build machine learning platforms using PyTorch, such as training jobs on Spark.",
    "4+ years of experience preferred in distributed systems.",
    "At least two of the following: Python, Ruby, Java, Node.js.",
]
_SECOND = "(doc_id // 12) * 5 + doc_id + 3"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posting rows out of ``documents``; ``body`` is plain text, ``content`` the same as escaped HTML."""
    d = F.col("doc_id")
    second = F.floor(d / 12) * 5 + d + 3
    frame = documents(spark, sf_dir).withColumns({
        "posting_id": d.cast("string"), "board_token": F.col("source"), "company": F.upper("source"),
        "title": pick(TITLES, d), "url": F.concat(F.lit("https://example.com/"), d.cast("string")),
        "heading": pick(HEADINGS, d), "line_1": pick(LINES, d), "line_2": pick(LINES, second),
        "location": F.struct(pick(LOCATIONS, d).alias("name")),
        "offices": F.array(F.struct(
            pick(OFFICES, d).alias("name"), F.array(pick(LOCATIONS, d * 3)).alias("location_values")
        )),
        "metadata": F.array(F.struct(
            pick(FIELDS, d).alias("name"), F.array(pick(EMPLOYMENT, d), pick(EMPLOYMENT, d * 5 + 1)).alias("value")
        )),
    })
    tagged = F.concat(
        F.lit("&lt;h3&gt;"), "heading", F.lit("&lt;/h3&gt;&lt;ul&gt;&lt;li&gt;"), "line_1",
        F.lit("&lt;/li&gt;&lt;li&gt;"), "line_2", F.lit("&lt;/li&gt;&lt;/ul&gt;&lt;p&gt;"), "text",
        F.lit("&lt;/p&gt;"),
    )
    flat = F.trim(F.regexp_replace(F.concat_ws(" ", "line_1", "line_2", "text"), r"\s+", " "))
    return frame.withColumns({"content": tagged, "body": flat})


POSTINGS = f"""p AS (
  SELECT doc_id, text, source, CAST(doc_id AS VARCHAR) AS posting_id, source AS board_token, upper(source) AS company,
         {pick_sql(TITLES, 'doc_id')} AS title, 'https://example.com/' || CAST(doc_id AS VARCHAR) AS url,
         {pick_sql(HEADINGS, 'doc_id')} AS heading,
         {pick_sql(LINES, 'doc_id')} AS line_1, {pick_sql(LINES, _SECOND)} AS line_2,
         {pick_sql(LOCATIONS, 'doc_id')} AS location,
         {pick_sql(OFFICES, 'doc_id')} AS office, {pick_sql(LOCATIONS, 'doc_id * 3')} AS office_location,
         {pick_sql(FIELDS, 'doc_id')} AS field, {pick_sql(EMPLOYMENT, 'doc_id')} AS value_1,
         {pick_sql(EMPLOYMENT, 'doc_id * 5 + 1')} AS value_2,
         {squash_sql(f"{pick_sql(LINES, 'doc_id')} || ' ' || {pick_sql(LINES, _SECOND)} || ' ' || text")} AS body
  FROM documents)"""


# --- jobs, evaluations, applications, requests ------------------------------

CUT_OFF = "2000-01-01"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("job_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("board_token"),
        key.cast("string").alias("posting_id"), F.col("c_mktsegment").alias("company"), F.col("c_name").alias("title"),
        F.lit("Remote").alias("location"), F.concat(F.lit("https://example.com/"), key.cast("string")).alias("url"),
        pick(S.PROFILES, key).alias("detected_profile"),
        F.when(F.col("c_acctbal") < 0, F.lit(False)).when(F.col("c_acctbal") < 9000, F.lit(True)).alias("is_active"),
        F.to_timestamp(F.lit("1999-01-01")).alias("last_seen_at"), F.to_timestamp(F.lit("1999-01-01")).alias("updated_at"),
    )


JOBS = f"""jobs AS (
  SELECT c_custkey AS job_id, 'n' || CAST(c_nationkey AS VARCHAR) AS board_token, CAST(c_custkey AS VARCHAR) AS posting_id,
         c_mktsegment AS company, c_name AS title, 'Remote' AS location,
         'https://example.com/' || CAST(c_custkey AS VARCHAR) AS url,
         {pick_sql(S.PROFILES, 'c_custkey')} AS detected_profile,
         CASE WHEN c_acctbal < 0 THEN FALSE WHEN c_acctbal < 9000 THEN TRUE END AS is_active
  FROM customer)"""


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live postings: customers with an order since the cut-off; boards are nations."""
    recent = table(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.to_timestamp(F.lit(CUT_OFF)))
    c = table(spark, sf_dir, "customer").join(
        recent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi"
    )
    return c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("board_token"),
        F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("posting_id"), "c_custkey", "c_name",
    )


SNAPSHOT = f"""live AS (
  SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS board_token, CAST(c_custkey AS VARCHAR) AS posting_id, c_custkey, c_name
  FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT_OFF} 00:00:00'))"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    score = F.floor(F.col("o_totalprice") / 50.0) / 100.0
    sure = F.pmod(key * 7, F.lit(101)).cast("double")
    chosen = pick(S.PROFILES, key)
    return o.select(
        key.alias("run_id"), F.col("o_custkey").alias("job_id"), score.alias("score"), sure.alias("confidence"),
        (score / 2).alias("selection_score"),
        F.when(F.col("o_orderstatus") == "F", F.lit("MANUAL_PRIORITY")).otherwise(F.lit("AGENT_APPLY")).alias("route"),
        chosen.alias("selected_resume"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(chosen, F.lit(".txt"))).alias("selected_resume_file"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.struct(
            (score >= 50).alias("required_evidence_gate"), ((score >= 85) & (sure >= 75)).alias("manual_ready"),
            F.struct(
                (score >= 50).alias("required"), (sure >= 50).alias("preferred"), F.lit(True).alias("semantic"),
                (F.col("o_orderstatus") == "O").alias("experience"),
            ).alias("component_availability"),
        )).alias("explanation"),
        F.col("o_orderdate").alias("created_at"),
    )


EVALUATIONS = f"""evaluations AS (
  SELECT o_orderkey AS run_id, o_custkey AS job_id, floor(o_totalprice / 50.0) / 100.0 AS score,
         CAST((o_orderkey * 7) % 101 AS DOUBLE) AS confidence, floor(o_totalprice / 50.0) / 100.0 / 2 AS selection_score,
         CASE WHEN o_orderstatus = 'F' THEN 'MANUAL_PRIORITY' ELSE 'AGENT_APPLY' END AS route,
         {pick_sql(S.PROFILES, 'o_orderkey')} AS selected_resume,
         CASE WHEN o_orderpriority <> '5-LOW' THEN {pick_sql(S.PROFILES, 'o_orderkey')} || '.txt' END AS selected_resume_file,
         o_orderpriority <> '1-URGENT' AS explained, o_orderstatus, o_orderdate AS created_at
  FROM orders)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 5 == 0, F.lit("single")).otherwise(F.lit("multi")).alias("board_token"), F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderdate")).alias("completed_at"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("jobs_discovered"),
        F.pmod("o_orderkey", F.lit(50)).cast("int").alias("target_role_jobs"),
        F.pmod("o_orderkey", F.lit(40)).cast("int").alias("us_compatible_jobs"),
        F.pmod("o_orderkey", F.lit(30)).cast("int").alias("jobs_eligible"),
        F.pmod("o_orderkey", F.lit(9)).cast("int").alias("manual_priority_count"),
        F.pmod("o_orderkey", F.lit(21)).cast("int").alias("agent_apply_count"),
        F.pmod("o_orderkey", F.lit(5)).cast("int").alias("experience_rejected_count"),
        F.when(F.col("o_orderstatus") != "P", F.pmod("o_orderkey", F.lit(3)).cast("int")).alias("unknown_location_count"),
        (F.col("o_totalprice") / 1000).alias("total_seconds"),
    )


RUNS = """runs AS (
  SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'single' ELSE 'multi' END AS board_token, o_orderdate AS started_at,
         CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderdate END AS completed_at,
         CAST(floor(o_totalprice / 1000) AS INTEGER) AS jobs_discovered, CAST(o_orderkey % 50 AS INTEGER) AS target_role_jobs,
         CAST(o_orderkey % 40 AS INTEGER) AS us_compatible_jobs, CAST(o_orderkey % 30 AS INTEGER) AS jobs_eligible,
         CAST(o_orderkey % 9 AS INTEGER) AS manual_priority_count, CAST(o_orderkey % 21 AS INTEGER) AS agent_apply_count,
         CAST(o_orderkey % 5 AS INTEGER) AS experience_rejected_count,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderkey % 3 AS INTEGER) END AS unknown_location_count,
         o_totalprice / 1000 AS total_seconds
  FROM orders)"""

REASONS = [None, "ELIGIBILITY: CITIZENSHIP", "BROWSER: CAPTCHA", "OTHER: call back"]


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One application per customer with a balance of at least 1000."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    created = F.timestamp_seconds(F.lit(1704067200) + F.pmod(key * 37, F.lit(1000)) * 3600)
    return c.filter(F.col("c_acctbal") >= 1000).select(
        (key + 1000000).alias("application_id"), key.alias("job_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("MANUAL")).otherwise(F.lit("AGENT")).alias("application_method"),
        pick([*B.STATUSES, "PENDING", "PENDING", "PENDING", "IN_PROGRESS", "PENDING"], key).alias("status"),
        (F.pmod(key, F.lit(4)) == 1).alias("needs_assistance"), pick(REASONS, F.floor(key / 2)).alias("assistance_reason"),
        F.when(F.col("c_mktsegment") != "MACHINERY", created).alias("created_at"),
        F.when(F.col("c_mktsegment") != "MACHINERY", created).alias("last_updated_at"),
        F.lit(None).cast("timestamp").alias("applied_at"),
    )


APPLICATIONS = f"""applications AS (
  SELECT c_custkey + 1000000 AS application_id, c_custkey AS job_id,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'MANUAL' ELSE 'AGENT' END AS application_method,
         {pick_sql([*B.STATUSES, 'PENDING', 'PENDING', 'PENDING', 'IN_PROGRESS', 'PENDING'], 'c_custkey')} AS status,
         c_custkey % 4 = 1 AS needs_assistance, {pick_sql(REASONS, 'c_custkey // 2')} AS assistance_reason,
         CASE WHEN c_mktsegment <> 'MACHINERY'
              THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((c_custkey * 37) % 1000 AS INTEGER)) END AS created_at,
         CASE WHEN c_mktsegment <> 'MACHINERY'
              THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((c_custkey * 37) % 1000 AS INTEGER)) END AS last_updated_at
  FROM customer WHERE c_acctbal >= 1000)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("id"), (F.col("o_custkey") + 1000000).alias("application_id"),
        F.when(F.col("o_orderpriority") < "3", F.lit("BROWSER")).otherwise(F.lit("ELIGIBILITY")).alias("source"),
        (F.col("o_orderstatus") == "F").alias("resolved"),
        F.concat(F.lit("R"), F.pmod(key, F.lit(3)).cast("string")).alias("reason"),
        F.concat(F.lit("Q"), F.pmod(key, F.lit(2)).cast("string")).alias("question"),
        F.concat(F.lit("H"), F.pmod(key, F.lit(2)).cast("string")).alias("handoff"), F.lit(1).alias("handoff_version"),
        F.col("o_orderdate").alias("updated_at"),
    )


REQUESTS = """requests AS (
  SELECT o_orderkey AS id, o_custkey + 1000000 AS application_id,
         CASE WHEN o_orderpriority < '3' THEN 'BROWSER' ELSE 'ELIGIBILITY' END AS source, o_orderstatus = 'F' AS resolved,
         'R' || CAST(o_orderkey % 3 AS VARCHAR) AS reason, 'Q' || CAST(o_orderkey % 2 AS VARCHAR) AS question,
         'H' || CAST(o_orderkey % 2 AS VARCHAR) AS handoff, 1 AS handoff_version, o_orderdate AS updated_at
  FROM orders)"""

NOW = "2024-06-01 00:00:00"


def now() -> Column:
    return F.to_timestamp(F.lit(NOW))


def with_ctes(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def text_of(frame: DataFrame) -> DataFrame:
    return X.with_parsed_html(frame)
