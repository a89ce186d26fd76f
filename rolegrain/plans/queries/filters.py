"""Classifiers, experience mentions and the funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import experience as E
from ...operators import filters as L
from ...operators import queues as Q
from ...operators import rollups as H
from ...rules import experience as ER
from ...rules import locations as LR
from ...rules import titles as T
from .. import scan
from . import bindings as b
from .eligibility import DECISION_CTES

P = b.with_ctes(b.POSTINGS)


@b.query("c1_target_role", P + f"SELECT doc_id, title, {b.matches_sql('title', T.TARGET_ROLES)} AS is_role FROM p")
def c1(spark, sf_dir):
    return b.postings(spark, sf_dir).select("doc_id", "title", L.is_target_role(F.col("title")).alias("is_role"))


ROLE = f"({b.matches_sql('title', T.TARGET_ROLES)} AND NOT {b.matches_sql('title', T.SENIORITY)})"


@b.query("c2_role_filter", P + f"SELECT doc_id, board_token, title FROM p WHERE {ROLE}")
def c2(spark, sf_dir):
    return L.filter_by_role(b.postings(spark, sf_dir)).select("doc_id", "board_token", "title")


EXCLUSION = (
    f"coalesce({b.first_match_sql('lower(title)', T.NON_FULL_TIME_TITLES)}, "
    f"CASE WHEN NOT {b.matches_sql('title', T.SMART_CONTRACT_TITLES)} "
    f"THEN {b.first_match_sql('lower(title)', T.CONTRACT_TITLES)} END)"
)


@b.query("c3_title_exclusion", P + f"SELECT doc_id, title, {EXCLUSION} AS evidence FROM p")
def c3(spark, sf_dir):
    return b.postings(spark, sf_dir).select("doc_id", "title", L.title_exclusion(F.col("title")).alias("evidence"))


_VALUE = "lower(trim(replace(v, '_', ' ')))"
STRUCTURED = f"""structured AS (
  SELECT doc_id, arg_min(status, n) AS status, arg_min(lower(field) || ': ' || lower(v), n) AS evidence FROM (
    SELECT doc_id, field, n, v, CASE WHEN {_VALUE} IN ({', '.join(map(b.q, T.FULL_TIME_VALUES))}) THEN 'FULL_TIME'
           WHEN {_VALUE} IN ({', '.join(map(b.q, T.NON_FULL_TIME_VALUES))}) THEN 'NON_FULL_TIME' END AS status
    FROM (SELECT doc_id, field, unnest([1, 2]) AS n, unnest([value_1, value_2]) AS v FROM p)
    WHERE lower(field) IN ({', '.join(map(b.q, T.EMPLOYMENT_FIELDS))})) WHERE status IS NOT NULL GROUP BY doc_id)"""


@b.query("c4_structured_employment", b.with_ctes(b.POSTINGS, STRUCTURED) + """
SELECT p.doc_id, coalesce(s.status, 'UNKNOWN') AS status, s.evidence FROM p LEFT JOIN structured s USING (doc_id)""")
def c4(spark, sf_dir):
    found = L.structured_employment(F.col("metadata"))
    return b.postings(spark, sf_dir).withColumn("f", found).select("doc_id", "f.status", "f.evidence")


EMPLOYMENT = f"""employment AS (
  SELECT p.*, {EXCLUSION} AS word, s.status, s.evidence AS found,
    CASE WHEN {EXCLUSION} IS NOT NULL OR s.status = 'NON_FULL_TIME' THEN 'REJECT'
         WHEN s.status = 'FULL_TIME' THEN 'ACCEPT' ELSE 'ACCEPT_UNKNOWN' END AS decision
  FROM p LEFT JOIN structured s USING (doc_id))"""


@b.query("c5_employment_decision", b.with_ctes(b.POSTINGS, STRUCTURED, EMPLOYMENT) + f"""
SELECT doc_id, decision,
  CASE decision WHEN 'REJECT' THEN 'NON_FULL_TIME' WHEN 'ACCEPT' THEN 'FULL_TIME' ELSE 'UNKNOWN' END AS employment_type,
  CASE WHEN word IS NOT NULL THEN {b.q(T.EMPLOYMENT_REASONS['title'])}
       WHEN status = 'NON_FULL_TIME' THEN {b.q(T.EMPLOYMENT_REASONS['non_full_time'])}
       WHEN status = 'FULL_TIME' THEN {b.q(T.EMPLOYMENT_REASONS['full_time'])}
       ELSE {b.q(T.EMPLOYMENT_REASONS['unknown'])} END AS reason,
  coalesce(word, found) AS evidence
FROM employment""")
def c5(spark, sf_dir):
    decision = L.classify_employment(F.col("title"), F.col("metadata"))
    return b.postings(spark, sf_dir).withColumn("e", decision).select("doc_id", "e.*")


def location_sql(text: str) -> str:
    raw = b.strip_sql(f"coalesce({text}, '')")
    low = f"lower({raw})"
    words = "|".join(p.replace(".", "\\.") for p in LR.US_CITIES + LR.US_STATES)
    codes = ", ".join(map(b.q, LR.US_STATE_CODES))
    return b.case_sql(
        [
            (f"{low} IN ({', '.join(map(b.q, LR.UNKNOWN_VALUES))})", "'UNKNOWN'"),
            (f"{low} IN ({', '.join(map(b.q, LR.US_EXACT))})", "'US'"),
            (b.contains_sql(low, LR.US_PHRASES), "'US'"),
            (f"regexp_matches({low}, {b.q(chr(92) + 'b(?:' + words + ')' + chr(92) + 'b')})", "'US'"),
            (f"len(list_filter(regexp_split_to_array({raw}, '[,/|]'), lambda x: upper(trim(x)) IN ({codes}))) > 0", "'US'"),
            (b.contains_sql(low, LR.NON_US_PHRASES), "'NON_US'"),
        ],
        "'UNKNOWN'",
    )


@b.query("c6_location_text", P + f"SELECT doc_id, location, {location_sql('location')} AS status FROM p")
def c6(spark, sf_dir):
    p = b.postings(spark, sf_dir)
    return p.select(
        "doc_id", F.col("location.name").alias("location"), L.classify_location_text(F.col("location.name")).alias("status")
    )


LOCATED = f"""located AS (
  SELECT doc_id, CASE WHEN own <> 'UNKNOWN' THEN own WHEN 'US' IN (by_name, by_place) THEN 'US'
         WHEN 'NON_US' IN (by_name, by_place) THEN 'NON_US' ELSE 'UNKNOWN' END AS location_status
  FROM (SELECT doc_id, {location_sql('location')} AS own, {location_sql('office')} AS by_name,
               {location_sql('office_location')} AS by_place FROM p))"""


@b.query("c7_posting_location", b.with_ctes(b.POSTINGS, LOCATED) + "SELECT doc_id, location_status FROM located")
def c7(spark, sf_dir):
    status = L.classify_location(F.col("location"), F.col("offices"))
    return b.postings(spark, sf_dir).select("doc_id", status.alias("location_status"))


@b.query("c7_location_split", b.with_ctes(b.POSTINGS, LOCATED) + """
SELECT location_status AS bucket, count(*) AS postings FROM located GROUP BY 1""")
def c7_split(spark, sf_dir):
    marked = L.with_location_status(b.postings(spark, sf_dir))
    return marked.groupBy(F.col("location_status").alias("bucket")).agg(F.count("*").alias("postings"))


def _mention_ctes() -> list[str]:
    """Mentions in SQL: spans per kind, then each kind against the spans accepted before it."""
    r, ctes, taken = ER, [], []
    for n, (kind, pattern) in enumerate(r.MENTION_KINDS):
        regex = b.q("(?i)" + pattern)
        second = f"CAST(regexp_extract(m, {regex}, 2) AS INTEGER)" if kind == "range" else "first_no"
        ctes.append(f"""spans{n} AS (
  SELECT doc_id, body, m, s, s + len(m) AS e, CAST(regexp_extract(m, {regex}, 1) AS INTEGER) AS first_no FROM (
    SELECT doc_id, body, ms[i] AS m,
           list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0) AS s
    FROM (SELECT doc_id, body, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, body, regexp_extract_all(body, {regex}) AS ms, regexp_split_to_array(body, {regex}) AS ps FROM p))))""")
        free = "".join(
            f" AND NOT EXISTS (SELECT 1 FROM kind{k} t WHERE t.doc_id = c.doc_id AND c.s < t.e AND c.e > t.s)" for k in taken
        )
        ctes.append(f"""kind{n} AS (
  SELECT doc_id, '{kind}' AS type, m AS match, least(first_no, {second}) AS min_years, greatest(first_no, {second}) AS max_years,
         {b.contains_sql('lower(ctx)', r.PREFERRED_WORDS)} AS preferred, ctx AS text, s, e
  FROM (SELECT *, {b.strip_sql(f'substr(body, CAST(greatest(s - {r.CONTEXT_RADIUS}, 0) + 1 AS BIGINT), CAST(e + {r.CONTEXT_RADIUS} - greatest(s - {r.CONTEXT_RADIUS}, 0) AS BIGINT))')} AS ctx,
               substr(body, CAST(greatest(s - {r.DEGREE_LOOKBACK}, 0) + 1 AS BIGINT), CAST(e + {r.DEGREE_LOOKAHEAD} - greatest(s - {r.DEGREE_LOOKBACK}, 0) AS BIGINT)) AS near FROM spans{n}) c
  WHERE contains(lower(ctx), 'experience')
    AND NOT ({b.contains_sql('lower(ctx)', r.DEGREE_TERMS)} AND NOT contains(lower(near), 'experience')){free})""")
        taken.append(n)
    ctes.append("mentions AS (" + " UNION ALL ".join(f"SELECT * FROM kind{k}" for k in taken) + ")")
    ctes.append(f"""experience AS (
  SELECT p.doc_id, CASE WHEN coalesce(bool_or(NOT preferred AND min_years >= {r.REJECT_YEARS}), FALSE) THEN 'REJECT'
         WHEN coalesce(bool_or(NOT preferred AND min_years = {r.REVIEW_YEARS}), FALSE) THEN 'REVIEW' ELSE 'ACCEPT' END AS experience_status,
         max(CASE WHEN NOT preferred THEN min_years END) AS required_min
  FROM p LEFT JOIN mentions m USING (doc_id) GROUP BY p.doc_id)""")
    return ctes


MENTION_CTES = _mention_ctes()


@b.query("c8_experience_mentions", b.with_ctes(b.POSTINGS, *MENTION_CTES) + """
SELECT doc_id, type, match, min_years, max_years, preferred, text, CAST(s AS INTEGER) AS span_start,
       CAST(e AS INTEGER) AS span_end FROM mentions""")
def c8(spark, sf_dir):
    p = E.with_mentions(b.postings(spark, sf_dir).select("doc_id", "body"), "body")
    return p.select("doc_id", F.inline("mentions")).withColumnsRenamed({"start": "span_start", "end": "span_end"})


@b.query("c9_experience_gate", b.with_ctes(b.POSTINGS, *MENTION_CTES) + """
SELECT doc_id, experience_status FROM experience""")
def c9(spark, sf_dir):
    p = E.with_mentions(b.postings(spark, sf_dir).select("doc_id", "body"), "body")
    return p.select("doc_id", E.classify_experience(F.col("mentions")).alias("experience_status"))


@b.query("c9_experience_split", b.with_ctes(b.POSTINGS, *MENTION_CTES) + """
SELECT doc_id, experience_status AS part FROM experience""")
def c9_split(spark, sf_dir):
    parts = E.split_by_experience(b.postings(spark, sf_dir).select("doc_id", "body"), "body")
    frames = [f.select("doc_id", F.lit(n).alias("part")) for n, f in zip(("ACCEPT", "REVIEW", "REJECT"), parts, strict=True)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@b.query("c5_employment_split", b.with_ctes(b.POSTINGS, STRUCTURED, EMPLOYMENT) + """
SELECT doc_id, decision <> 'REJECT' AS kept FROM employment""")
def c5_split(spark, sf_dir):
    kept, rejected = L.split_by_employment(b.postings(spark, sf_dir))
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(rejected.select("doc_id", F.lit(False).alias("kept")))


@b.query("c14_profile", P + f"""
SELECT doc_id, {b.case_sql([(b.matches_sql('title', pack), b.q(name)) for name, pack in T.PROFILE_PACKS], b.q(T.DEFAULT_PROFILE))} AS job_profile
FROM p""")
def c14(spark, sf_dir):
    return b.postings(spark, sf_dir).select("doc_id", L.classify_profile(F.col("title")).alias("job_profile"))


STAGES = f"""stages AS (
  SELECT e.doc_id, e.board_token, e.company, is_role, decision, location_status, experience_status, eligibility,
    is_role AS s1, is_role AND decision = 'REJECT' AS s2, is_role AND decision <> 'REJECT' AND location_status = 'US' AS s3,
    is_role AND decision <> 'REJECT' AND location_status = 'UNKNOWN' AS s4
  FROM (SELECT *, {ROLE} AS is_role FROM employment) e JOIN located USING (doc_id) JOIN experience USING (doc_id)
  JOIN decisions USING (doc_id))"""
COUNTS = """count(*) AS discovered, count(*) FILTER (s1) AS target_roles, count(*) FILTER (s2) AS employment_filtered,
  count(*) FILTER (s3) AS us_compatible, count(*) FILTER (s4) AS unknown_location,
  count(*) FILTER (s3 AND experience_status = 'REJECT') AS experience_rejected,
  count(*) FILTER (s3 AND experience_status <> 'REJECT') AS pre_eligibility,
  count(*) FILTER (s3 AND experience_status <> 'REJECT' AND eligibility = 'NEEDS_ASSISTANCE') AS assistance,
  CAST(0 AS BIGINT) AS blocked, count(*) FILTER (s3 AND experience_status <> 'REJECT' AND eligibility = 'PASS') AS eligible"""
FUNNEL = b.with_ctes(b.POSTINGS, STRUCTURED, EMPLOYMENT, LOCATED, *MENTION_CTES, *DECISION_CTES, STAGES)


def annotated(spark, sf_dir):
    return scan.annotate(b.postings(spark, sf_dir), text="body")


@b.query("c15_funnel_postings", FUNNEL + """
SELECT doc_id, board_token, experience_status, eligibility FROM stages WHERE s3 AND experience_status <> 'REJECT'""")
def c15(spark, sf_dir):
    return scan.survivors(annotated(spark, sf_dir)).select(
        "doc_id", "board_token", "experience_status", F.col("eligibility.decision").alias("eligibility")
    )


@b.query("c16_board_fit", FUNNEL + f""", counts AS (SELECT board_token, {COUNTS} FROM stages GROUP BY 1)
SELECT board_token, target_roles, employment_filtered, pre_eligibility,
  CASE WHEN pre_eligibility > 0 THEN 'WORTH_ADDING'
       WHEN target_roles > 0 AND employment_filtered > 0 AND employment_filtered = target_roles THEN 'ROLES_NOT_FULL_TIME'
       WHEN target_roles > 0 THEN 'NO_ELIGIBLE_JOBS' ELSE 'NO_TARGET_ROLES' END AS recommendation
FROM counts""")
def c16(spark, sf_dir):
    fit = H.board_fit(annotated(spark, sf_dir))
    return fit.select("board_token", "target_roles", "employment_filtered", "pre_eligibility", "recommendation")


@b.query("c17_freshness_guard", """
SELECT o_orderkey FROM orders WHERE o_orderpriority = '3-MEDIUM' OR o_orderdate < TIMESTAMP '2000-06-01 00:00:00'""")
def c17(spark, sf_dir):
    done = F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderdate"))
    queue = b.table(spark, sf_dir, "orders").withColumn("evaluation_completed_at", done)
    return Q.stale_candidates(queue, F.to_timestamp(F.lit("2000-06-01"))).select("o_orderkey")


@b.query("c18_active", b.with_ctes(b.JOBS) + "SELECT job_id, coalesce(is_active, TRUE) AS active FROM jobs")
def c18(spark, sf_dir):
    return b.jobs(spark, sf_dir).select("job_id", L.is_active(F.col("is_active")).alias("active"))


@b.query("f2_required_years", b.with_ctes(b.POSTINGS, *MENTION_CTES) + "SELECT doc_id, required_min FROM experience")
def f2(spark, sf_dir):
    p = E.with_mentions(b.postings(spark, sf_dir).select("doc_id", "body"), "body")
    return p.select("doc_id", E.required_years(F.col("mentions")).alias("required_min"))


@b.query("h1_run_funnel", FUNNEL + f"SELECT {COUNTS} FROM stages")
def h1(spark, sf_dir):
    return H.run_funnel(annotated(spark, sf_dir))


@b.query("h2_board_summary", FUNNEL + f""", counts AS (SELECT board_token, {COUNTS} FROM stages GROUP BY 1),
companies AS (SELECT DISTINCT source AS board_token, upper(source) AS company FROM documents
              UNION ALL SELECT n_name, n_name FROM nation),
summary AS (SELECT c.company, c.board_token, CASE WHEN coalesce(discovered, 0) > 0 THEN 'SUCCESS' ELSE 'NO_JOBS' END AS status,
  {', '.join(f'coalesce({s}, 0) AS {s}' for s in H.STAGES)} FROM companies c LEFT JOIN counts USING (board_token))
SELECT * FROM summary UNION ALL
SELECT 'TOTAL', 'TOTAL', NULL, {', '.join(f'CAST(sum({s}) AS BIGINT)' for s in H.STAGES)} FROM summary""")
def h2(spark, sf_dir):
    boards = b.documents(spark, sf_dir).select(F.col("source").alias("board_token"), F.upper("source").alias("company"))
    extra = b.table(spark, sf_dir, "nation").select(F.col("n_name").alias("board_token"), F.col("n_name").alias("company"))
    companies = boards.distinct().unionByName(extra)
    return H.with_total(H.board_summary(annotated(spark, sf_dir), companies))
