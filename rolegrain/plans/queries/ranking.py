"""Pairing, similarity, scoring, ranking, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import columns as C
from ...operators import calibration as K
from ...operators import experience as E
from ...operators import filters as L
from ...operators import queues as Q
from ...operators import ranking as R
from ...operators import rollups as H
from ...operators import scoring as P
from ...operators import similarity as M
from ...rules import scoring as S
from ...rules import titles as T
from . import bindings as b
from .requirements import UNIVERSE, some, some_sql

KEYS = ["board_token", "posting_id"]


def profiles(spark):
    """The fixed profiles with a skill list each."""
    o = F.col("profile_order")
    names = F.array(*map(F.lit, S.PROFILES))
    listed = spark.range(1).select(F.posexplode(names).alias("profile_order", "profile"))
    skills = F.filter(F.array(*map(F.lit, UNIVERSE)), lambda s, i: F.pmod(o + i * 3, F.lit(4)) != 0)
    return listed.select("profile", "profile_order", F.concat("profile", F.lit(".txt")).alias("filename"), skills.alias("skills"))


def required_postings(spark, sf_dir):
    """Postings with requirement sets, groups and mentions by document number."""
    p, d, one = b.postings(spark, sf_dir), F.col("doc_id"), F.lit(1)
    none = F.array().cast("array<string>")

    def group(section, skills, count, present):
        g = F.struct(
            F.lit(section).alias("section"), skills.alias("skills"), count.cast("int").alias("min_matches"),
            F.lit("alternative").alias("kind"), F.col("title").alias("text"),
        )
        return F.when(present, g)

    groups = F.array_compact(F.array(
        group("required", some(1, 4, 1), one + d % 3, d % 5 != 0), group("preferred", some(2, 6, 3), one, d % 2 == 1)
    ))
    mention = F.struct((d % 7).cast("int").alias("min_years"), (d % 3 == 1).alias("preferred"))
    return p.select(
        *KEYS, "doc_id", "title", L.classify_profile(F.col("title")).alias("job_profile"),
        F.when(d % 4 == 0, none).otherwise(some(3, 5, 0)).alias("required_skills"),
        F.when(d % 3 == 0, none).otherwise(some(5, 7, 0)).alias("preferred_skills"),
        groups.alias("requirement_groups"),
        F.when(d % 6 == 0, F.array().cast("array<struct<min_years: int, preferred: boolean>>"))
        .otherwise(F.array(mention)).alias("mentions"),
    )


def raw_similarity(profile):
    return F.pmod(F.col("doc_id") * 31 + profile["profile_order"] * 17, F.lit(500)) / 10.0 + 20.0


def pairs(spark, sf_dir):
    paired = R.pair_with_profiles(required_postings(spark, sf_dir), profiles(spark), KEYS)
    return paired.withColumn("semantic_raw", raw_similarity(F.struct("profile_order")))


def scored(spark, sf_dir):
    return R.score_pairs(pairs(spark, sf_dir))


_ROLE = "CASE " + " ".join(
    f"WHEN job_profile = '{j}' THEN CAST(list_extract({row}, CAST(profile_order AS INTEGER) + 1) AS DOUBLE)"
    for j, row in S.ROLE_ALIGNMENT.items()
) + " END"
_PROFILE = b.case_sql([(b.matches_sql("title", pack), b.q(n)) for n, pack in T.PROFILE_PACKS], b.q(T.DEFAULT_PROFILE))
_KNOWN = "lambda x: list_contains(skills, x)"
W = S.FIT_WEIGHTS


def _weighted(parts) -> tuple[str, str]:
    points = " + ".join(f"CASE WHEN {a} THEN {s} * {w} ELSE 0.0 END" for s, a, w in parts)
    active = " + ".join(f"CASE WHEN {a} THEN {w} ELSE 0.0 END" for _, a, w in parts)
    return f"CAST({points} AS DOUBLE)", f"CAST({active} AS DOUBLE)"


_FIT = [("required_score", "required_units > 0", "45.0::DOUBLE"), ("preferred_score", "preferred_units > 0", "10.0::DOUBLE"),
        ("semantic_score", "TRUE", "30.0::DOUBLE"), ("experience_score", "required_min IS NOT NULL", "15.0::DOUBLE")]
_SEL = [("role_score", "TRUE", "55.0::DOUBLE"), ("semantic_score", "TRUE", "25.0::DOUBLE"), ("required_score", "required_units > 0", "20.0::DOUBLE")]
_FP, _FA = _weighted(_FIT)
_SP, _SA = _weighted(_SEL)

SCORED = [b.POSTINGS, f"""pairs AS (
  SELECT board_token, posting_id, doc_id, title, {_PROFILE} AS job_profile, profile_order, {b.sql_list(S.PROFILES)}[profile_order + 1] AS profile,
    list_filter({b.sql_list(UNIVERSE)}, lambda s: (profile_order + (list_position({b.sql_list(UNIVERSE)}, s) - 1) * 3) % 4 <> 0) AS skills,
    CASE WHEN doc_id % 4 = 0 THEN [] ELSE {some_sql(3, 5, 0)} END AS req,
    CASE WHEN doc_id % 3 = 0 THEN [] ELSE {some_sql(5, 7, 0)} END AS pref,
    doc_id % 5 <> 0 AS has_g1, {some_sql(1, 4, 1)} AS g1, 1 + doc_id % 3 AS g1_min, doc_id % 2 = 1 AS has_g2, {some_sql(2, 6, 3)} AS g2,
    CASE WHEN doc_id % 6 <> 0 AND doc_id % 3 <> 1 THEN CAST(doc_id % 7 AS INTEGER) END AS required_min,
    CAST((doc_id * 31 + profile_order * 17) % 500 AS DOUBLE) / 10.0 + 20.0 AS semantic_raw
  FROM p, (SELECT CAST(unnest(range(8)) AS INTEGER) AS profile_order))""", f"""units AS (
  SELECT *, {_ROLE} AS role_score,
    list_filter(req, {_KNOWN}) AS matched, list_filter(g1, {_KNOWN}) AS g1_hits, least(g1_min, len(g1)) AS g1_need,
    len(req) + has_g1::INT AS required_units,
    len(list_filter(req, {_KNOWN})) + (has_g1 AND len(list_filter(g1, {_KNOWN})) >= greatest(1, least(g1_min, len(g1))))::INT AS required_hits,
    len(pref) + has_g2::INT AS preferred_units,
    len(list_filter(pref, {_KNOWN})) + (has_g2 AND len(list_filter(g2, {_KNOWN})) >= 1)::INT AS preferred_hits
  FROM pairs)""", f"""scores AS (
  SELECT *, CASE WHEN required_units = 0 THEN 100.0::DOUBLE ELSE {b.round2_sql('CAST(required_hits AS DOUBLE) / required_units * 100.0::DOUBLE')} END AS required_score,
    CASE WHEN preferred_units = 0 THEN 100.0::DOUBLE ELSE {b.round2_sql('CAST(preferred_hits AS DOUBLE) / preferred_units * 100.0::DOUBLE')} END AS preferred_score,
    {b.round2_sql('greatest(0.0::DOUBLE, least((semantic_raw - 25.0::DOUBLE) / 35.0::DOUBLE * 100.0::DOUBLE, 100.0::DOUBLE))')} AS semantic_score,
    CASE WHEN required_min IS NULL OR required_min <= 3 THEN 100.0::DOUBLE WHEN required_min <= 4 THEN 65.0::DOUBLE ELSE 0.0::DOUBLE END AS experience_score
  FROM units)""", f"""fits AS (
  SELECT *, {_FA} AS active_weight, {b.round2_sql(f'({_FP}) / ({_FA})')} AS final_score,
    {b.round2_sql(f'({_FA}) / 100.0::DOUBLE * 100.0::DOUBLE')} AS confidence, {b.round2_sql(f'({_SP}) / ({_SA})')} AS selection_score,
    CASE WHEN required_units > 0 THEN {b.round2_sql(f'required_score * 45.0::DOUBLE / ({_FA})')} ELSE 0.0 END AS required_share
  FROM scores)""", """scored AS (
  SELECT *, CASE WHEN final_score >= 85 AND confidence >= 75 AND required_units > 0 THEN 'MANUAL_PRIORITY' ELSE 'AGENT_APPLY' END AS route
  FROM fits)""", """best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board_token, posting_id
    ORDER BY selection_score DESC, final_score DESC, profile_order) AS rank FROM scored) WHERE rank = 1)"""]
ALL = b.with_ctes(*SCORED)


@b.query("e1_posting_profile_pairs", ALL + "SELECT doc_id, job_profile, profile FROM pairs")
def e1(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", "job_profile", "profile")


@b.query("e2_role_alignment", ALL + "SELECT doc_id, profile, role_score FROM units UNION ALL SELECT doc_id, 'archivist', 50.0::DOUBLE FROM p")
def e2(spark, sf_dir):
    known = pairs(spark, sf_dir).select("doc_id", "profile", "role_score")
    other = required_postings(spark, sf_dir).withColumn("profile", F.lit("archivist"))
    return known.unionByName(R.with_role_score(other).select("doc_id", "profile", "role_score"))


def chunk_frames(spark, sf_dir, per_posting: int = 8):
    """Posting chunks and profile vectors out of ``embeddings``: a profile is the mean vector of a label, in three parts."""
    e = b.table(spark, sf_dir, "embeddings")
    chunks = e.select(
        F.floor(F.col("vec_id") / per_posting).alias("posting_id"), F.pmod("vec_id", F.lit(per_posting)).alias("chunk_no"),
        F.col("embedding").alias("vec"),
    )
    part = F.pmod("vec_id", F.lit(3)).alias("part")
    means = e.select("label", part, F.posexplode("embedding").alias("i", "x")).groupBy("label", "part", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x")
    )
    vectors = means.groupBy("label", "part").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    named = vectors.select(
        F.concat(F.lit("profile-"), F.col("label").cast("string")).alias("profile"),
        F.transform("v", lambda v: v["x"]).alias("vec"),
    )
    return chunks, named


_E3 = """WITH means AS (
  SELECT label, part, i, avg(x) AS x FROM (SELECT label, vec_id % 3 AS part, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY ALL),
profile AS (SELECT label AS name, list(x ORDER BY i) AS v FROM means GROUP BY label, part),
best AS (SELECT vec_id // 8 AS posting_id, vec_id % 8 AS chunk_no, name, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v)) AS sim
         FROM embeddings, profile GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY posting_id, name ORDER BY sim DESC, chunk_no) AS r FROM best)
SELECT posting_id, 'profile-' || CAST(name AS VARCHAR) AS profile, """ + b.round2_sql("avg(sim) * 100.0::DOUBLE") + """ AS semantic_raw
FROM top WHERE r <= 5 GROUP BY posting_id, name"""


@b.query("e3_semantic_scores", _E3)
def e3(spark, sf_dir):
    return M.semantic_scores(*chunk_frames(spark, sf_dir), ["posting_id"])


@b.query("e3_semantic_scores_shuffled", _E3)
def e3_shuffled(spark, sf_dir):
    return M.semantic_scores(*chunk_frames(spark, sf_dir), ["posting_id"], per_bucket=64, per_slice=4)


@b.query("e4_group_match", ALL + """
SELECT doc_id, profile, len(g1_hits) >= greatest(1, g1_need) AS satisfied, array_to_string(g1_hits, '|') AS matching,
       array_to_string(list_filter(g1, lambda x: NOT list_contains(g1_hits, x)), '|') AS missing, CAST(greatest(1, g1_need) AS INTEGER) AS need
FROM units WHERE has_g1""")
def e4(spark, sf_dir):
    grouped = pairs(spark, sf_dir).select("doc_id", "profile", "skills", F.explode("requirement_groups").alias("g"))
    own = grouped.filter(F.col("g.section") == "required").withColumn("r", P.group_result(F.col("g"), F.col("skills")))
    return own.select(
        "doc_id", "profile", "r.satisfied", F.array_join("r.matching_options", "|").alias("matching"),
        F.array_join("r.missing_options", "|").alias("missing"), F.col("r.min_matches").alias("need"),
    )


@b.query("f1_requirement_coverage", ALL + "SELECT doc_id, profile, required_score, preferred_score, array_to_string(matched, '|') AS matched FROM scored")
def f1(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "doc_id", "profile", "required_score", "preferred_score", F.array_join("required.matched", "|").alias("matched")
    )


@b.query("f3_experience_score", ALL + "SELECT doc_id, profile, required_min, experience_score FROM scored")
def f3(spark, sf_dir):
    years = E.required_years(F.col("mentions"))
    out = pairs(spark, sf_dir).withColumn("required_min", years)
    return out.select("doc_id", "profile", "required_min", E.experience_score(F.col("required_min")).alias("experience_score"))


@b.query("f4_semantic_score", ALL + "SELECT doc_id, profile, semantic_score FROM scored")
def f4(spark, sf_dir):
    return pairs(spark, sf_dir).select("doc_id", "profile", P.normalize_semantic(F.col("semantic_raw")).alias("semantic_score"))


@b.query("f5_weighted_score", ALL + "SELECT doc_id, profile, active_weight, confidence, required_share FROM scored")
def f5(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "doc_id", "profile", "fit.active_weight", "confidence", F.col("fit.contributions.required").alias("required_share")
    )


@b.query("f6_availability", ALL + """
SELECT doc_id, profile, required_units > 0 AS required, preferred_units > 0 AS preferred, TRUE AS semantic,
       required_min IS NOT NULL AS experience FROM scored""")
def f6(spark, sf_dir):
    s = scored(spark, sf_dir)
    names = ("required", "preferred", "experience")
    return s.select(
        "doc_id", "profile", *[P.component_available(F.col("available"), n).alias(n) for n in names],
        P.component_available(F.col("available"), "semantic").alias("semantic"),
    )


@b.query("f7_selection_score", ALL + "SELECT doc_id, profile, selection_score FROM scored")
def f7(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "profile", "selection_score")


@b.query("f8_fit_score", ALL + "SELECT doc_id, profile, final_score FROM scored")
def f8(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "profile", "final_score")


@b.query("f9_route", ALL + "SELECT doc_id, profile, route FROM scored")
def f9(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "profile", "route")


@b.query("f10_bands", ALL + """
SELECT doc_id, profile, CASE WHEN final_score >= 90 THEN 'VERY_STRONG' WHEN final_score >= 85 THEN 'STRONG' WHEN final_score >= 75
  THEN 'MODERATE' WHEN final_score >= 60 THEN 'WEAK' ELSE 'VERY_WEAK' END AS band,
  CASE WHEN final_score >= 85 THEN 'high' WHEN final_score >= 75 THEN 'medium' ELSE 'low' END AS fit_badge,
  CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END AS confidence_badge
FROM scored""")
def f10(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "doc_id", "profile", P.score_band(F.col("final_score")).alias("band"),
        P.fit_badge(F.col("final_score")).alias("fit_badge"), P.confidence_badge(F.col("confidence")).alias("confidence_badge"),
    )


_HELD = "final_score >= 85 AND NOT (confidence >= 75 AND required_units > 0)"


def _texts(rungs) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {b.q(t)} END" for c, t in rungs) + "], lambda x: x IS NOT NULL), '|')"


@b.query("f11_explanation", ALL + f"""
SELECT doc_id, profile, {b.round2_sql('final_score - 85.0::DOUBLE')} AS threshold_distance,
  final_score >= 85 AND confidence >= 75 AND required_units > 0 AS manual_ready,
  {_texts([('final_score < 85', S.GATE_TEXTS['score']), ('confidence < 75', S.GATE_TEXTS['confidence']), ('required_units = 0', S.GATE_TEXTS['evidence'])])} AS gate_failures,
  {_texts([('required_units = 0', S.WARNING_TEXTS['required']), ('preferred_units = 0', S.WARNING_TEXTS['preferred']),
           ('required_min IS NULL', S.WARNING_TEXTS['experience']), ('required_units > 0 AND required_score < 60', S.WARNING_TEXTS['coverage']),
           ('experience_score = 65', S.WARNING_TEXTS['one_year_short']), ('required_min IS NOT NULL AND experience_score = 0', S.WARNING_TEXTS['experience_zero']),
           (_HELD, S.WARNING_TEXTS['held'])])} AS warnings
FROM scored""")
def f11(spark, sf_dir):
    e = "explanation."
    return scored(spark, sf_dir).select(
        "doc_id", "profile", e + "threshold_distance", e + "manual_ready",
        F.array_join(e + "gate_failures", "|").alias("gate_failures"), F.array_join(e + "warnings", "|").alias("warnings"),
    )


def _neutral(frame):
    flags = {n: F.col("available")[n] for n in S.FIT_WEIGHTS}
    fit = P.neutral_fit({n: F.col(f"{n}_score") for n in S.FIT_WEIGHTS}, flags)
    chosen = P.neutral_selection(F.col("role_score"), F.col("semantic_score"), F.col("required_score"), flags["required"])
    return frame.withColumns({"n": fit, "n_selection": chosen})


def _share(score: str, available: str, weight: float) -> str:
    return b.round2_sql(f"(CASE WHEN {available} THEN {score} ELSE 50.0::DOUBLE END) * {weight}::DOUBLE / 100.0::DOUBLE")


NEUTRAL = "neutral AS (SELECT *, " + b.round2_sql("0.0::DOUBLE + " + " + ".join(
    _share(s, a, w) for (s, a, _), w in zip(_FIT, S.FIT_WEIGHTS.values())
)) + " AS n_score, " + b.round2_sql(
    "role_score * 0.55::DOUBLE + semantic_score * 0.25::DOUBLE + (CASE WHEN required_units > 0 THEN required_score ELSE 50.0::DOUBLE END) * 0.2::DOUBLE"
) + " AS n_selection FROM scored)"


@b.query("f12_neutral_model", b.with_ctes(*SCORED, NEUTRAL) + """
SELECT doc_id, profile, n_score AS final_score, CASE WHEN n_score >= 85 THEN 'MANUAL_PRIORITY' ELSE 'AGENT_APPLY' END AS route,
       confidence, n_selection AS selection FROM neutral""")
def f12(spark, sf_dir):
    return _neutral(scored(spark, sf_dir)).select(
        "doc_id", "profile", "n.final_score", "n.route", "n.confidence", F.col("n_selection").alias("selection")
    )


@b.query("g1_ranked_profiles", ALL + """
SELECT doc_id, profile, CAST(row_number() OVER (PARTITION BY board_token, posting_id
  ORDER BY selection_score DESC, final_score DESC, profile_order) AS INTEGER) AS rank FROM scored""")
def g1(spark, sf_dir):
    return R.rank_profiles(scored(spark, sf_dir), KEYS).select("doc_id", "profile", "rank")


@b.query("g1_best_profile", ALL + "SELECT doc_id, profile, selection_score, final_score, route FROM best")
def g1_best(spark, sf_dir):
    return chosen_rows(spark, sf_dir).select("doc_id", "profile", "selection_score", "final_score", "route")


@b.query("g1_best_profile_paired", ALL + "SELECT doc_id, profile, selection_score, final_score, route FROM best")
def g1_best_paired(spark, sf_dir):
    """The same for a list that does not fit a task: paired, scored and ranked."""
    ranked = R.best_of_profiles(required_postings(spark, sf_dir), profiles(spark), KEYS, raw_similarity, limit=0)
    return ranked.select("doc_id", "profile", "selection_score", "final_score", "route")


def chosen_rows(spark, sf_dir):
    return R.best_of_profiles(required_postings(spark, sf_dir), profiles(spark), KEYS, raw_similarity)


def best(spark, sf_dir):
    return R.with_explanation(chosen_rows(spark, sf_dir)).select(
        *KEYS, "doc_id", "profile", F.col("final_score").alias("score"), "confidence", "route",
        F.size("explanation.warnings").alias("warning_count"), F.col("available.required").alias("has_required"),
        "explanation.component_availability", "role_score", "semantic_score",
    )


_WARN = "(required_units = 0)::INT + (preferred_units = 0)::INT + (required_min IS NULL)::INT + (required_units > 0 AND required_score < 60)::INT " \
    f"+ (experience_score = 65)::INT + (required_min IS NOT NULL AND experience_score = 0)::INT + ({_HELD})::INT"
CHOSEN = f"chosen AS (SELECT *, final_score AS score, {_WARN} AS warning_count FROM best)"


@b.query("g6_calibration_sample", b.with_ctes(*SCORED, CHOSEN) + """
, parts AS (
  SELECT *, 0 AS part, row_number() OVER (ORDER BY score DESC, board_token, posting_id) AS r, 3 AS n FROM chosen UNION ALL
  SELECT *, 1, row_number() OVER (ORDER BY abs(score - 85), board_token, posting_id), 5 FROM chosen UNION ALL
  SELECT *, 2, row_number() OVER (ORDER BY score, board_token DESC, posting_id DESC), 3 FROM chosen UNION ALL
  SELECT *, 3, row_number() OVER (ORDER BY warning_count DESC, score DESC, board_token, posting_id), 5 FROM chosen WHERE warning_count > 0 UNION ALL
  SELECT *, 4, row_number() OVER (ORDER BY confidence, score DESC, board_token, posting_id), 5 FROM chosen WHERE confidence < 75),
kept AS (SELECT *, CASE WHEN part = 2 THEN 4 - r ELSE r END AS place FROM parts WHERE r <= n)
SELECT board_token, posting_id, part, CAST(place AS INTEGER) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY board_token, posting_id ORDER BY part, place) AS first_no FROM kept) WHERE first_no = 1""")
def g6(spark, sf_dir):
    return K.select_examples(best(spark, sf_dir)).select("board_token", "posting_id", "part", "place")


@b.query("g7_route_queues", b.with_ctes(*SCORED) + """
, q AS (SELECT 'manual' AS queue, posting_id, final_score, confidence FROM best WHERE route = 'MANUAL_PRIORITY' UNION ALL
  SELECT 'agent', posting_id, final_score, confidence FROM best WHERE route = 'AGENT_APPLY' UNION ALL
  SELECT 'low_confidence', posting_id, final_score, confidence FROM best WHERE confidence < 75)
SELECT queue, posting_id, final_score AS score, confidence FROM q""")
def g7(spark, sf_dir):
    return Q.route_membership(best(spark, sf_dir)).select("queue", "posting_id", "score", "confidence")


@b.query("h4_routing_summary", b.with_ctes(*SCORED) + """
SELECT count(*) AS scored, count(*) FILTER (required_units > 0) AS required_evidence, count(*) FILTER (confidence >= 75) AS confident,
  count(*) FILTER (confidence < 75) AS low_confidence, count(*) FILTER (final_score >= 85) AS fit_over_threshold,
  count(*) FILTER (final_score >= 85 AND route <> 'MANUAL_PRIORITY') AS fit_over_but_held FROM best""")
def h4(spark, sf_dir):
    return H.routing_summary(best(spark, sf_dir))


@b.query("h4_missing_components", b.with_ctes(*SCORED) + f"""
SELECT doc_id, {_texts([('required_units = 0', 'required'), ('preferred_units = 0', 'preferred'), ('required_min IS NULL', 'experience')])} AS missing
FROM best""")
def h4_missing(spark, sf_dir):
    flags = {n: F.col("component_availability")[n] for n in ("required", "preferred", "experience")}
    return best(spark, sf_dir).select("doc_id", F.array_join(P.missing_components(flags), "|").alias("missing"))


def _models(spark, sf_dir):
    """The neutral model as current, the evidence model as proposed, each with its own profile, in one row per posting."""

    def neutral(r):
        flags = {n: r["available"][n] for n in S.FIT_WEIGHTS}
        fit = P.neutral_fit({n: r[f"{n}_score"] for n in S.FIT_WEIGHTS}, flags, C.let)
        return {"n": fit, "n_score": fit["final_score"], "n_selection": P.neutral_selection(r["role_score"], r["semantic_score"], r["required_score"], flags["required"])}

    rows = R.with_scored_profiles(required_postings(spark, sf_dir), profiles(spark), raw_similarity, neutral)
    rows = C.pinned(rows, {"old": R.chosen(F.col("scored"), ("n_selection", "n_score")), "new": R.chosen(F.col("scored"))})
    return rows.select(
        *KEYS, F.col("old.n.route").alias("current_route"), F.col("old.profile").alias("current_profile"),
        "new.profile", "new.route", "new.confidence", F.col("new.final_score").alias("score"),
    )


_MODELS = b.with_ctes(*SCORED, NEUTRAL) + """, old AS (SELECT board_token, posting_id, profile AS old_profile,
    CASE WHEN n_score >= 85 THEN 'MANUAL_PRIORITY' ELSE 'AGENT_APPLY' END AS old_route FROM (
    SELECT *, row_number() OVER (PARTITION BY board_token, posting_id ORDER BY n_selection DESC, n_score DESC, profile_order) AS r FROM neutral) WHERE r = 1),
both_models AS (SELECT best.*, old_profile, old_route FROM best JOIN old USING (board_token, posting_id))"""


@b.query("h14_model_comparison", _MODELS + """
SELECT count(*) AS compared, count(*) FILTER (old_route = 'MANUAL_PRIORITY') AS current_manual,
  count(*) FILTER (route = 'MANUAL_PRIORITY') AS proposed_manual, count(*) FILTER (final_score >= 85) AS fit_above_threshold,
  count(*) FILTER (old_route <> route) AS route_changes, count(*) FILTER (old_profile <> profile) AS profile_changes,
  count(*) FILTER (final_score >= 85 AND route <> 'MANUAL_PRIORITY') AS evidence_held,
  count(*) FILTER (confidence < 75) AS low_confidence FROM both_models""")
def h14(spark, sf_dir):
    return K.count_changes(_models(spark, sf_dir))


@b.query("i2_review_set", _MODELS + """
, parts AS (SELECT board_token, posting_id, 0 AS part FROM both_models WHERE old_route <> route UNION ALL
  SELECT board_token, posting_id, 1 FROM both_models WHERE final_score >= 85 AND route <> 'MANUAL_PRIORITY' UNION ALL
  (SELECT board_token, posting_id, 2 FROM both_models ORDER BY final_score DESC, board_token, posting_id LIMIT 5))
SELECT board_token, posting_id, min(part) AS part FROM parts GROUP BY 1, 2""")
def i2(spark, sf_dir):
    return K.review_set(_models(spark, sf_dir)).select(*KEYS, "part")
