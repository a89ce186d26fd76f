"""Pairing of postings with profiles, scoring and ranking of the pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import scoring as S
from ..session import BROADCAST_ROWS, fits
from . import experience as E
from . import scoring as P

SALTS = 64
#: Fields of a scored row.
FIELDS = (
    "profile", "profile_order", "filename", "skills", "role_score", "semantic_raw", "required", "preferred", "required_min", "required_score",
    "preferred_score", "semantic_score", "experience_score", "available", "fit", "selection_score", "final_score", "confidence", "route",
)


def role_alignment(spark: SparkSession) -> DataFrame:
    """Fixed table: job_profile, profile, role_score."""
    rows = [
        (job, profile, float(score))
        for job, scores in S.ROLE_ALIGNMENT.items()
        for profile, score in zip(S.PROFILES, scores)
    ]
    return spark.createDataFrame(rows, "job_profile string, profile string, role_score double")


def with_role_score(pairs: DataFrame, default: float = S.DEFAULT_ROLE_SCORE) -> DataFrame:
    """Look the role score up by (job_profile, profile)."""
    table = F.broadcast(role_alignment(pairs.sparkSession))
    return pairs.join(table, ["job_profile", "profile"], "left").withColumn(
        "role_score", F.coalesce("role_score", F.lit(default))
    )


def pair_with_profiles(
    postings: DataFrame, profiles: DataFrame, keys: Sequence[str], limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Every posting with every profile, with the role score of the pair.

    The pairing is an equi-join on the posting's own profile: each candidate
    profile is listed once under every posting profile.  A list beyond
    ``limit`` is not broadcast; as there are only a few posting profiles, it
    is then joined on a salt as well, so that no single task gets them all.
    """
    jobs = F.explode(F.array(*map(F.lit, S.ROLE_ALIGNMENT))).alias("job_profile")
    listed = with_role_score(profiles.select("*", jobs))
    # What is sent is measured: every profile once per posting profile.
    if fits(listed, limit * len(S.ROLE_ALIGNMENT)):
        return postings.join(F.broadcast(listed), "job_profile")
    salted = postings.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int"))
    spread = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["job_profile", "_salt"]).drop("_salt")


def with_explanation(scored: DataFrame) -> DataFrame:
    """Add the explanation to scored rows."""
    return scored.withColumn("explanation", P.explanation({name: F.col(name) for name in scored.columns}))


def score_pairs(pairs: DataFrame, explain: bool = True) -> DataFrame:
    """Add every score, the route and (unless only winners get one) the explanation to (posting, profile) rows.

    Needs ``required_skills``, ``preferred_skills``, ``requirement_groups``,
    ``mentions``, ``skills`` (of the profile), ``role_score`` and
    ``semantic_raw``.
    """
    c = F.col
    scored = C.pinned(pairs, {
        "required": P.coverage(c("required_skills"), c("requirement_groups"), c("skills"), "required"),
        "preferred": P.coverage(c("preferred_skills"), c("requirement_groups"), c("skills"), "preferred"),
        "required_min": E.required_years(c("mentions")),
    })
    flags = P.availability(c("required.units"), c("preferred.units"), c("required_min"))
    scored = scored.withColumns({
        "required_score": P.requirement_score(c("required.units"), c("required.satisfied")),
        "preferred_score": P.requirement_score(c("preferred.units"), c("preferred.satisfied")),
        "semantic_score": P.normalize_semantic(c("semantic_raw")),
        "experience_score": E.experience_score(c("required_min")),
        "available": F.struct(*[flag.alias(name) for name, flag in flags.items()]),
    })
    available = {name: c("available")[name] for name in flags}
    scores = {name: c(f"{name}_score") for name in S.FIT_WEIGHTS}
    scored = C.pinned(scored, {
        "fit": P.fit_score(scores, available),
        "selection_score": P.selection_score(
            c("role_score"), c("semantic_score"), c("required_score"), available["required"]
        ),
    })
    scored = scored.withColumns({"final_score": c("fit.score"), "confidence": c("fit.confidence")})
    scored = scored.withColumn("route", P.route(c("final_score"), c("confidence"), available["required"]))
    return with_explanation(scored) if explain else scored


def _scored_row(p: Column, raw: Column, extra: Callable[[Column], dict[str, Column]]) -> Column:
    """The columns of ``score_pairs`` for the posting of the row and one profile, as a struct; every step is computed once."""
    c = F.col
    roles = F.create_map(*[
        F.lit(x) for job, scores in S.ROLE_ALIGNMENT.items() for profile, score in zip(S.PROFILES, scores, strict=True)
        for x in (f"{job}/{profile}", float(score))
    ])
    found = F.struct(
        p["profile"].alias("profile"), p["profile_order"].alias("profile_order"), p["filename"].alias("filename"), p["skills"].alias("skills"),
        F.coalesce(F.try_element_at(roles, F.concat("job_profile", F.lit("/"), p["profile"])), F.lit(S.DEFAULT_ROLE_SCORE)).alias("role_score"),
        raw.cast("double").alias("semantic_raw"),
        P.coverage(c("required_skills"), c("requirement_groups"), p["skills"], "required").alias("required"),
        P.coverage(c("preferred_skills"), c("requirement_groups"), p["skills"], "preferred").alias("preferred"),
        E.required_years(c("mentions")).alias("required_min"),
    )

    def scores(r: Column) -> Column:
        flags = P.availability(r["required"]["units"], r["preferred"]["units"], r["required_min"])
        values = F.struct(
            P.requirement_score(r["required"]["units"], r["required"]["satisfied"]).alias("required_score"),
            P.requirement_score(r["preferred"]["units"], r["preferred"]["satisfied"]).alias("preferred_score"),
            P.normalize_semantic(r["semantic_raw"]).alias("semantic_score"), E.experience_score(r["required_min"]).alias("experience_score"),
            F.struct(*[flag.alias(name) for name, flag in flags.items()]).alias("available"),
        )
        return C.let(values, lambda v: weigh(r, v))

    def weigh(r: Column, v: Column) -> Column:
        available = {name: v["available"][name] for name in (*S.FIT_WEIGHTS,)}
        both = F.struct(
            P.fit_score({name: v[f"{name}_score"] for name in S.FIT_WEIGHTS}, available, C.let).alias("fit"),
            P.selection_score(r["role_score"], v["semantic_score"], v["required_score"], available["required"], C.let).alias("selection_score"),
        )
        return C.let(both, lambda w: row(r, v, w))

    def row(r: Column, v: Column, w: Column) -> Column:
        final, confidence = w["fit"]["score"], w["fit"]["confidence"]
        parts = [r[n].alias(n) for n in FIELDS[:9]] + [v[n].alias(n) for n in FIELDS[9:14]] + [
            w["fit"].alias("fit"), w["selection_score"].alias("selection_score"), final.alias("final_score"), confidence.alias("confidence"),
            P.route(final, confidence, v["available"]["required"]).alias("route"),
        ]
        return F.struct(*parts)

    def extended(whole: Column) -> Column:
        more = extra(whole)
        return F.struct(*[whole[name].alias(name) for name in FIELDS], *[value.alias(name) for name, value in more.items()]) if more else whole

    return C.let(C.let(found, scores), extended)


def with_scored_profiles(
    postings: DataFrame, profiles: DataFrame, raw: Callable[[Column], Column], extra: Callable[[Column], dict[str, Column]] = lambda row: {},
    into: str = "scored",
) -> DataFrame:
    """Add an array with one scored row per profile; the profile list is a value of the plan, so nothing is joined or shuffled.

    ``raw`` gives the raw similarity of the posting to a profile struct, ``extra`` further fields of a scored row.
    """
    listed = profiles.agg(F.array_sort(F.collect_list(F.struct("profile_order", "profile", "filename", "skills"))).alias("listed"))
    known = C.pinned(postings, {"_listed": listed.scalar()})
    return C.pinned(known, {into: F.transform("_listed", lambda p: _scored_row(p, raw(p), extra))}).drop("_listed")


def chosen(scored: Column, by: Sequence[str] = ("selection_score", "final_score")) -> Column:
    """The scored row that is first by these fields, then by profile order."""
    places = F.transform(scored, lambda s, i: F.struct(*[s[name].alias(name) for name in by], (-s["profile_order"]).alias("order"), i.alias("place")))
    return F.get(scored, F.array_max(places)["place"])


def best_of_profiles(
    postings: DataFrame, profiles: DataFrame, keys: Sequence[str], raw: Callable[[Column], Column], limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """The posting's columns with the scored row of the profile to use.

    Profiles are scored and chosen inside the posting's row; a list that does not fit is paired, scored and ranked instead.
    """
    if fits(profiles, limit):
        ranked = with_scored_profiles(postings, profiles, raw, into="_scored")
        return C.pinned(ranked, {"_best": chosen(F.col("_scored"))}).drop("_scored").select(*postings.columns, "_best.*").filter(F.col("profile").isNotNull())
    pairs = pair_with_profiles(postings, profiles, keys, limit)
    return best_profile(score_pairs(pairs.withColumn("semantic_raw", raw(F.struct(*profiles.columns))), explain=False), keys)


def rank_profiles(scored: DataFrame, keys: Sequence[str], order: str = "profile_order") -> DataFrame:
    """Add ``rank``: selection score, then fit, then profile order. Rank 1 is the profile to use."""
    window = Window.partitionBy(*keys).orderBy(F.desc("selection_score"), F.desc("final_score"), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(window))


def best_profile(scored: DataFrame, keys: Sequence[str], order: str = "profile_order") -> DataFrame:
    """The profile to use per posting; its own fit is kept, not the largest fit."""
    return C.first_by_rank(
        scored, keys, [F.desc("selection_score"), F.desc("final_score"), F.asc(order)]
    )
