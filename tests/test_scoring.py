import random

import pytest
from pyspark.sql import functions as F

from rolegrain.functions import columns as C
from rolegrain.operators import ranking as K
from rolegrain.operators import scoring as P
from rolegrain.operators import similarity as M
from rolegrain.rules import scoring as S

# (required, preferred, semantic, experience, has required, has preferred, has experience) -> score, confidence, route
VECTORS = [
    ((0, 0, 60, 0, False, False, False), (60.0, 30.0, "AGENT_APPLY")),
    ((100, 0, 75, 0, True, False, False), (90.0, 75.0, "MANUAL_PRIORITY")),
    ((100, 100, 100, 100, False, True, True), (100.0, 55.0, "AGENT_APPLY")),
    ((85, 85, 85, 85, True, True, True), (85.0, 100.0, "MANUAL_PRIORITY")),
    ((84.99, 84.99, 84.99, 84.99, True, True, True), (84.99, 100.0, "AGENT_APPLY")),
]


@pytest.mark.parametrize("given, expected", VECTORS)
def test_known_scores(spark, given, expected):
    names = ["required", "preferred", "semantic", "experience"]
    scores = {n: F.lit(float(v)) for n, v in zip(names, given)}
    flags = {"required": F.lit(given[4]), "preferred": F.lit(given[5]), "semantic": F.lit(True), "experience": F.lit(given[6])}
    row = spark.range(1).select(P.fit_score(scores, flags).alias("f")).select(
        "f.score", "f.confidence", P.route(F.col("f.score"), F.col("f.confidence"), flags["required"]).alias("route")
    ).first()
    assert tuple(row) == expected


def test_groups_need_their_count(spark):
    group = F.struct(
        F.lit("required").alias("section"), F.array(*map(F.lit, ["Next.js", "Node.js", "Python", "Ruby"])).alias("skills"),
        F.lit(2).alias("min_matches"), F.lit("minimum_count").alias("kind"), F.lit("t").alias("text"),
    )
    for skills, score in ((["Python", "Ruby"], 100.0), (["Python"], 0.0)):
        c = P.coverage(F.array().cast("array<string>"), F.array(group), F.array(*map(F.lit, skills)), "required")
        got = spark.range(1).select(c.alias("c")).select(P.requirement_score(F.col("c.units"), F.col("c.satisfied"))).first()[0]
        assert got == score


def test_similarity_paths_agree_with_plain_python(spark):
    rng = random.Random(6)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    chunks = [(p, c, vec()) for p in range(6) for c in range(rng.randint(1, 8))]
    profiles = [(f"p{i % 3}", vec()) for i in range(9)] + [("zero", [0.0] * 8)]
    left = spark.createDataFrame(chunks, "posting_id int, chunk_no int, vec array<double>")
    right = spark.createDataFrame(profiles, "profile string, vec array<double>")

    def cosine(a, b):
        na, nb = (sum(x * x for x in v) ** 0.5 or 1.0 for v in (a, b))
        return sum(x * y for x, y in zip(a, b)) / na / nb

    expected = {}
    for p in range(6):
        for name in {n for n, _ in profiles}:
            best = sorted((max(cosine(v, w) for n, w in profiles if n == name) for q, _, v in chunks if q == p), reverse=True)[:5]
            expected[p, name] = sum(best) / len(best) * 100
    for size in (100, 3):
        rows = M.semantic_scores(left, right, ["posting_id"], per_bucket=size, per_slice=size).collect()
        assert len(rows) == len(expected)
        for r in rows:
            assert abs(r.semantic_raw - expected[r.posting_id, r.profile]) <= 0.0051


def test_pairing_is_the_same_beyond_the_broadcast_limit(spark):
    postings = spark.createDataFrame([(i, "backend_engineer") for i in range(20)], "id int, job_profile string")
    profiles = spark.createDataFrame([("backend_engineer", 0), ("other", 1)], "profile string, profile_order int")
    small = K.pair_with_profiles(postings, profiles, ["id"])
    large = K.pair_with_profiles(postings, profiles, ["id"], limit=1)
    key = lambda f: sorted((r.id, r.profile, r.role_score) for r in f.collect())
    assert key(small) == key(large)
    assert len(key(small)) == 40 and ("other" in {k[1] for k in key(small)}) and (0, "other", 50.0) in key(small)


def test_a_list_of_requirements_is_computed_once_in_a_row_of_profiles(spark):
    assert str(P.coverage(F.col("normal"), F.col("groups_of_row"), F.col("known"), "required")).count("groups_of_row") == 1
    score = P.fit_score({n: F.col(n) for n in S.FIT_WEIGHTS}, {n: F.col(f"has_{n}") for n in S.FIT_WEIGHTS}, C.let)
    assert str(score).count("has_semantic") <= 4
