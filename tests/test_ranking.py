"""Scoring inside a posting's row, and similarity without moving vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolegrain.operators import ranking as R
from rolegrain.operators import similarity as M
from rolegrain.plans.queries import ranking as q


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_no_exchange_behind_the_requirements(spark, sf_dir):
    postings = spark.read.schema(q.required_postings(spark, sf_dir).schema).parquet(_written(spark, sf_dir))
    best = R.best_of_profiles(postings, q.profiles(spark), q.KEYS, q.raw_similarity)
    main = plan_of(best).split("Subqueries")[0]
    assert "hashpartitioning" not in main and "Join" not in main and "Window" not in main


def _written(spark, sf_dir):
    from rolegrain.session import scratch_path

    path = scratch_path(spark, "ranked-postings")
    q.required_postings(spark, sf_dir).write.mode("overwrite").parquet(path)
    return path


def test_row_and_pair_scores_agree(spark, sf_dir):
    postings = q.required_postings(spark, sf_dir)
    inside = R.best_of_profiles(postings, q.profiles(spark), q.KEYS, q.raw_similarity)
    paired = R.best_of_profiles(postings, q.profiles(spark), q.KEYS, q.raw_similarity, limit=0)
    names = sorted(set(inside.columns) - {"_rank"})
    rows = lambda f: sorted(map(str, f.select(*names).collect()))
    assert rows(inside) == rows(paired) and inside.count() == postings.count()
    assert R.best_of_profiles(postings, q.profiles(spark).limit(0), q.KEYS, q.raw_similarity).count() == 0


def test_ties_keep_the_profile_order(spark, sf_dir):
    postings = q.required_postings(spark, sf_dir).limit(3)
    same = q.profiles(spark).withColumns({"skills": F.array(F.lit("Java")), "profile": F.concat(F.lit("p"), F.col("profile_order").cast("string"))})
    rows = R.best_of_profiles(postings, same, q.KEYS, lambda p: F.lit(30.0)).collect()
    assert {r.profile_order for r in rows} == {0}


@pytest.mark.parametrize("slice_size", [M.VECTORS, 4])
def test_similarity_against_a_loop(spark, slice_size, monkeypatch):
    monkeypatch.setattr(M, "HELD", 3)
    rng = np.random.default_rng(8)
    chunks = [(f"b{i % 3}", str(i % 17), rng.standard_normal(6).round(3).tolist()) for i in range(200)] + [("b0", None, [0.0] * 6), ("b9", "1", [1.0] * 6)]
    profiles = [(f"p{i % 4}", rng.standard_normal(6).round(3).tolist()) for i in range(11)]
    frame = spark.createDataFrame(chunks, "board_token string, posting_id string, vec array<double>").repartition(5)
    other = spark.createDataFrame(profiles, "profile string, vec array<double>")
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    expected = {}
    for key in {c[:2] for c in chunks}:
        for name in {p[0] for p in profiles}:
            best = sorted((max(float(unit(c[2]) @ unit(p[1])) for p in profiles if p[0] == name) for c in chunks if c[:2] == key), reverse=True)[:5]
            expected[(*key, name)] = sum(best) / len(best) * 100
    rows = {(r.board_token, r.posting_id, r.profile): r.semantic_raw for r in M.semantic_scores(frame, other, ["board_token", "posting_id"], per_slice=slice_size).collect()}
    assert set(rows) == set(expected) and all(abs(rows[k] - expected[k]) < 0.0051 for k in rows)
    by_posting = M.semantic_by_posting(frame, other, ["board_token", "posting_id"], per_slice=slice_size).collect()
    assert {(r.board_token, r.posting_id, s.profile): s.semantic_raw for r in by_posting for s in r.semantic} == rows


def test_vectors_are_not_shuffled_for_a_short_list(spark, sf_dir):
    frame, other = q.chunk_frames(spark, sf_dir)
    plan = plan_of(M.semantic_scores(frame, other, ["posting_id"]))
    exchange = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchange) == 1 and plan.index("Exchange hashpartitioning") < plan.index("MapInArrow")
    assert M.semantic_by_posting(frame, other.limit(0), ["posting_id"]).select(F.max(F.size("semantic"))).first()[0] == 0


def test_sample_of_one_pass_against_sorted_lists(spark):
    from rolegrain.operators import calibration as K

    rng = np.random.default_rng(2)
    data = [(f"b{i % 4}", str(i), float(rng.integers(60, 100)), float(rng.integers(60, 90)), int(rng.integers(0, 4))) for i in range(150)]
    frame = spark.createDataFrame(data, "board_token string, posting_id string, score double, confidence double, warning_count int").repartition(6)
    up = lambda r: (r[0], r[1])
    downwards = sorted(sorted(data, key=up, reverse=True), key=lambda r: r[2])[:3][::-1]
    lists = [
        sorted(data, key=lambda r: (-r[2], up(r)))[:3], sorted(data, key=lambda r: (abs(r[2] - 85), up(r)))[:5], downwards,
        sorted((r for r in data if r[4] > 0), key=lambda r: (-r[4], -r[2], up(r)))[:5], sorted((r for r in data if r[3] < 75), key=lambda r: (r[3], -r[2], up(r)))[:5],
    ]
    expected = {}
    for part, head in enumerate(lists):
        for place, r in enumerate(head, 1):
            expected.setdefault(up(r), (part, place))
    sample = K.select_examples(frame)
    assert {(r.board_token, r.posting_id): (r.part, r.place) for r in sample.collect()} == expected
    assert plan_of(sample).count("Scan ExistingRDD") == 1
    routes = frame.withColumns({"route": F.lit("AGENT_APPLY"), "current_route": F.when(F.col("warning_count") == 3, F.lit("X")).otherwise(F.lit("AGENT_APPLY"))})
    want = {}
    for part, head in enumerate([[r for r in data if r[4] == 3], [r for r in data if r[2] >= 85], sorted(data, key=lambda r: (-r[2], up(r)))[:5]]):
        for r in head:
            want.setdefault(up(r), part)
    found = K.review_set(routes)
    assert {(r.board_token, r.posting_id): r.part for r in found.collect()} == want and plan_of(found).count("Scan ExistingRDD") == 1
