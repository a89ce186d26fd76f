"""Eligibility findings and decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import eligibility as G
from ...rules import eligibility as R
from . import bindings as b

_LIGHT = "lower({0})".format(
    b.squash_sql("replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&')")
)
COMBINED = f"combined AS (SELECT doc_id, {_LIGHT.replace('{0}', 'title')} || '. ' || {_LIGHT.replace('{0}', 'body')} AS body FROM p)"


def _hit(patterns, exceptions) -> str:
    cleared = f" AND NOT {b.matches_sql('body', exceptions)}" if exceptions else ""
    return f"{b.matches_sql('body', patterns)}{cleared}"


FLAGS = "flags AS (SELECT doc_id, body, " + ", ".join(
    f"{_hit(patterns, exceptions)} AS {category.lower()}" for category, _, patterns, exceptions in R.CATEGORIES
) + " FROM combined)"
_NAMES = sorted(category for category, *_ in R.CATEGORIES)
DECISIONS = "decisions AS (SELECT doc_id, cats, CASE WHEN len(cats) > 0 THEN 'NEEDS_ASSISTANCE' ELSE 'PASS' END AS eligibility, " \
    f"CASE WHEN len(cats) > 0 THEN {b.q(R.REVIEW_PREFIX)} || array_to_string(cats, ', ') END AS reason " \
    "FROM (SELECT doc_id, list_filter([" + ", ".join(f"CASE WHEN {n.lower()} THEN '{n}' END" for n in _NAMES) + \
    "], lambda x: x IS NOT NULL) AS cats FROM flags))"
DECISION_CTES = [COMBINED, FLAGS, DECISIONS]


def _spans(n: int, category: str, reason: str, k: int, pattern: str, exceptions) -> str:
    regex = b.q("(?i)" + pattern)
    where = f" WHERE NOT {b.matches_sql('body', exceptions)}" if exceptions else ""
    r = R.EVIDENCE_RADIUS
    return f"""SELECT doc_id, {n} AS cat_no, {k} AS rule_no, i AS place, '{category}' AS category, {b.q(reason)} AS reason,
  {b.strip_sql(f"substr(body, CAST(greatest(s - {r}, 0) + 1 AS BIGINT), CAST(s + len(m) + {r} - greatest(s - {r}, 0) AS BIGINT))")} AS evidence FROM (
  SELECT doc_id, body, i, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: len(x)))
    + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0) AS s
  FROM (SELECT doc_id, body, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
    SELECT doc_id, body, regexp_extract_all(body, {regex}) AS ms, regexp_split_to_array(body, {regex}) AS ps FROM combined{where})))"""


FINDINGS = "findings AS (" + " UNION ALL ".join(
    _spans(n, category, reason, k, pattern, exceptions)
    for n, (category, reason, patterns, exceptions) in enumerate(R.CATEGORIES)
    for k, pattern in enumerate(patterns)
) + ")"


def _combined(spark, sf_dir):
    p = b.postings(spark, sf_dir)
    return p.select("doc_id", G.combined_text(F.col("title"), F.col("body")).alias("all"))


@b.query("c10_findings", b.with_ctes(b.POSTINGS, COMBINED, FINDINGS) + "SELECT doc_id, category, reason, evidence FROM findings")
def c10(spark, sf_dir):
    return _combined(spark, sf_dir).select("doc_id", F.inline(G.all_findings(F.col("all"))))


@b.query("c11_exceptions", b.with_ctes(b.POSTINGS, COMBINED) + f"""
SELECT doc_id, {b.matches_sql('body', R.CLEARANCE_EXCEPTIONS)} AS clearance_cleared,
       {b.matches_sql('body', R.CLEARANCE)} AND NOT {b.matches_sql('body', R.CLEARANCE_EXCEPTIONS)} AS clearance,
       {b.matches_sql('body', R.CITIZENSHIP)} AND NOT {b.matches_sql('body', R.CITIZENSHIP_EXCEPTIONS)} AS citizenship
FROM combined""")
def c11(spark, sf_dir):
    text = F.col("all")
    return _combined(spark, sf_dir).select(
        "doc_id", G.has_exception(text, R.CLEARANCE_EXCEPTIONS).alias("clearance_cleared"),
        G.category_hit(text, R.CLEARANCE, R.CLEARANCE_EXCEPTIONS).alias("clearance"),
        G.category_hit(text, R.CITIZENSHIP, R.CITIZENSHIP_EXCEPTIONS).alias("citizenship"),
    )


@b.query("c12_first_findings", b.with_ctes(b.POSTINGS, COMBINED, FINDINGS) + """
SELECT doc_id, category, reason, evidence FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY rule_no, place) AS r FROM findings) WHERE r = 1""")
def c12(spark, sf_dir):
    return _combined(spark, sf_dir).select("doc_id", F.inline(G.first_findings(F.col("all"))))


@b.query("c13_eligibility", b.with_ctes(b.POSTINGS, *DECISION_CTES) + """
SELECT doc_id, eligibility AS decision, reason, len(cats) AS findings FROM decisions""")
def c13(spark, sf_dir):
    marked = G.with_eligibility(b.postings(spark, sf_dir), "title", "body")
    return marked.select("doc_id", "eligibility.*", F.size("findings").cast("bigint").alias("findings"))
