"""Registered queries against the SQL they claim to equal.

By default a part of them; set ``ALL_QUERIES=1`` for every one.
"""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from rolegrain.plans.queries import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
ROWS_ONLY = {
    "b1_clean_html", "b4_logical_lines", "k1_grouped_fields",
}
QUICK = [
    "b11_list_rendering", "b13_safe_values", "b14_parse_utc", "e9_fresh_scan", "c7_location_split", "k6_safe_packets", "k7_assistance_texts",
    "j11_run_history", "b15_export_projection", "j7_browser_requests",
    "a1_companies", "a2_snapshot_postings", "b6_word_chunks", "c5_employment_decision", "c8_experience_mentions", "c13_eligibility",
    "a2_fetch_status", "d8_parenthetical_groups", "d9_inline_examples", "d10_line_structure", "d14_requirements", "d14_counters",
    "g1_best_profile_paired", "h14_model_comparison", "i2_review_set", "d13_evidence", "e3_semantic_scores", "e3_semantic_scores_shuffled", "g1_best_profile", "g5_work_queue", "h6_run_history_rows",
    "h13_headline_metrics", "j1_upsert_postings", "j4_ensure_applications", "j12_status_changes", "k3_resolved_fields",
]
NAMES = sorted(QUERIES) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normal(rows):
    plain = [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows]
    return sorted(plain, key=lambda row: [(v is None, str(v)) for v in row])


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert not set(driver.oracle_sql()) - set(driver.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_dir, name):
    frame = driver.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    if name in ROWS_ONLY:
        assert rows
        return
    result = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    order = [columns.index(c) for c in frame.columns]
    assert normal(rows) == normal([tuple(r[i] for i in order) for r in result.fetchall()])


def test_entry(spark):
    assert driver.entry(spark).count() > 0
