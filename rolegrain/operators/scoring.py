"""Scores of one (posting, profile) row. Column expressions only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import scoring as S

#: How a value that an expression uses several times is computed once.
Bind = Callable[[Column, Callable[[Column], Column]], Column]
_RESULT = (
    "struct<skills: array<string>, min_matches: int, matched_count: int, satisfied: boolean, "
    "matching_options: array<string>, missing_options: array<string>, kind: string, text: string>"
)


def group_result(group: Column, profile_skills: Column) -> Column:
    """One requirement group against a profile's skills."""
    unique = F.array_sort(F.array_distinct(group["skills"]))
    hits = F.array_intersect(unique, profile_skills)
    need = F.greatest(F.lit(1), F.least(group["min_matches"], F.greatest(F.size(unique), F.lit(1))))
    return F.struct(
        group["skills"].alias("skills"), need.cast("int").alias("min_matches"), F.size(hits).alias("matched_count"),
        (F.size(hits) >= need).alias("satisfied"), hits.alias("matching_options"),
        F.array_except(unique, hits).alias("missing_options"), group["kind"].alias("kind"),
        group["text"].alias("text"),
    ).cast(_RESULT)


def coverage(normal: Column, groups: Column, profile_skills: Column, section: str) -> Column:
    """``struct<units, satisfied, matched, missing, groups>`` of one section."""
    results = F.transform(
        F.filter(groups, lambda g: g["section"] == section), lambda g: group_result(g, profile_skills)
    )
    # Lists are bound before they are used several times: inside a row of profiles nothing else computes them once.
    own = F.struct(F.array_sort(F.array_distinct(normal)).alias("own"), results.alias("results"))

    def with_matched(x: Column) -> Column:
        return C.let(F.array_intersect(x["own"], profile_skills), lambda matched: counted(x["own"], x["results"], matched))

    def counted(own: Column, results: Column, matched: Column) -> Column:
        return F.struct(
            (F.size(own) + F.size(results)).alias("units"),
            (F.size(matched) + F.size(F.filter(results, lambda r: r["satisfied"]))).alias("satisfied"),
            matched.alias("matched"), F.array_except(own, matched).alias("missing"), results.alias("groups"),
        )

    return C.let(own, with_matched)


def repeated(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` for columns of generated code, where Spark itself computes a repeated expression once."""
    return body(value)


def requirement_score(units: Column, satisfied: Column) -> Column:
    """Share of satisfied units in percent, 100 without units."""
    share = satisfied.cast("double") / units * 100.0
    return F.when(units == 0, F.lit(100.0)).otherwise(C.round2(share))


def normalize_semantic(raw: Column) -> Column:
    """Raw similarity stretched to 0..100."""
    stretched = (raw - S.SEMANTIC_FLOOR) / S.SEMANTIC_SPAN * 100.0
    return C.round2(F.greatest(F.lit(0.0), F.least(stretched, F.lit(100.0))))


def weighted_score(
    scores: Mapping[str, Column], available: Mapping[str, Column], weights: Mapping[str, float], bind: Bind = repeated,
) -> Column:
    """Score over the components that have evidence, and how much evidence that is.

    A missing component leaves numerator and denominator and lowers the
    confidence.  Returns ``struct<score, confidence, active_weight,
    total_weight, weighted_sum, contributions>``.  ``bind`` is ``C.let`` inside lambdas.
    """
    zero = F.lit(0.0)
    points, active = zero, zero
    for name, weight in weights.items():
        points = points + F.when(available[name], scores[name] * F.lit(weight)).otherwise(zero)
        active = active + F.when(available[name], F.lit(weight)).otherwise(zero)
    total = float(sum(weights.values()))

    def parts(points: Column, active: Column) -> Column:
        shares = F.struct(*[
            F.when(available[n] & (active > 0), C.round2(scores[n] * F.lit(w) / active)).otherwise(zero).alias(n)
            for n, w in weights.items()
        ])
        return F.struct(
            F.when(active > 0, C.round2(points / active)).otherwise(zero).alias("score"),
            C.round2(active / F.lit(total) * 100.0).alias("confidence"),
            C.round2(active).alias("active_weight"), C.round2(F.lit(total)).alias("total_weight"),
            C.round2(points).alias("weighted_sum"), shares.alias("contributions"),
        )

    return bind(F.struct(points.alias("points"), active.alias("active")), lambda x: parts(x["points"], x["active"]))


def availability(required_units: Column, preferred_units: Column, required_min: Column) -> dict[str, Column]:
    return {
        "required": required_units > 0,
        "preferred": preferred_units > 0,
        "semantic": F.lit(True),
        "experience": required_min.isNotNull(),
    }


def component_available(flags: Column, component: str, semantic_score: Column | None = None) -> Column:
    """Stored availability flag; semantic counts as present where the flag is missing."""
    if component != "semantic":
        return F.coalesce(flags[component], F.lit(False))
    return F.coalesce(flags[component], F.lit(True) if semantic_score is None else semantic_score.isNotNull())


def selection_score(role: Column, semantic: Column, required: Column, required_available: Column, bind: Bind = repeated) -> Column:
    """How well a profile represents the applicant for a posting."""
    yes = F.lit(True)
    return weighted_score(
        {"role": role, "semantic": semantic, "required": required},
        {"role": yes, "semantic": yes, "required": required_available},
        S.SELECTION_WEIGHTS, bind,
    )["score"]


def fit_score(scores: Mapping[str, Column], available: Mapping[str, Column], bind: Bind = repeated) -> Column:
    """How strong the match is on the evidence there is."""
    return weighted_score(scores, available, S.FIT_WEIGHTS, bind)


def route(score: Column, confidence: Column, required_evidence: Column) -> Column:
    manual = (score >= S.MANUAL_THRESHOLD) & (confidence >= S.MANUAL_CONFIDENCE) & required_evidence
    return F.when(manual, F.lit("MANUAL_PRIORITY")).otherwise(F.lit("AGENT_APPLY"))


def score_band(score: Column) -> Column:
    return C.ladder([(score >= floor, F.lit(band)) for floor, band in S.SCORE_BANDS], F.lit(S.LOWEST_BAND))


def fit_badge(score: Column) -> Column:
    """high / medium / low, null without a score."""
    return F.when(score >= S.MANUAL_THRESHOLD, F.lit("high")).when(score >= 75, F.lit("medium")).when(
        score.isNotNull(), F.lit("low")
    )


def confidence_badge(confidence: Column) -> Column:
    return F.when(confidence >= S.MANUAL_CONFIDENCE, F.lit("high")).when(confidence >= 60, F.lit("medium")).when(
        confidence.isNotNull(), F.lit("low")
    )


def missing_components(available: Mapping[str, Column]) -> Column:
    names = ("required", "preferred", "experience")
    return C.compact(*[F.when(~F.coalesce(available[n], F.lit(False)), F.lit(n)) for n in names])


def gates(score: Column, confidence: Column, required_evidence: Column) -> Column:
    """``struct<score_gate, confidence_gate, required_evidence_gate, manual_ready, gate_failures>``."""
    enough, sure = score >= S.MANUAL_THRESHOLD, confidence >= S.MANUAL_CONFIDENCE
    texts = S.GATE_TEXTS
    return F.struct(
        enough.alias("score_gate"), sure.alias("confidence_gate"), required_evidence.alias("required_evidence_gate"),
        (enough & sure & required_evidence).alias("manual_ready"),
        C.compact(
            F.when(~enough, F.lit(texts["score"])),
            F.when(~sure, F.lit(texts["confidence"])),
            F.when(~required_evidence, F.lit(texts["evidence"])),
        ).alias("gate_failures"),
    )


def warnings(
    score: Column, confidence: Column, required_score: Column, experience: Column, available: Mapping[str, Column]
) -> Column:
    texts = S.WARNING_TEXTS
    held = (score >= S.MANUAL_THRESHOLD) & ~((confidence >= S.MANUAL_CONFIDENCE) & available["required"])
    return C.compact(
        F.when(~available["required"], F.lit(texts["required"])),
        F.when(~available["preferred"], F.lit(texts["preferred"])),
        F.when(~available["experience"], F.lit(texts["experience"])),
        F.when(available["required"] & (required_score < 60), F.lit(texts["coverage"])),
        F.when(experience == 65, F.lit(texts["one_year_short"])),
        F.when(available["experience"] & (experience == 0), F.lit(texts["experience_zero"])),
        F.when(held, F.lit(texts["held"])),
    )


def explanation(row: Mapping[str, Column]) -> Column:
    """Everything that led to a score, as one struct.

    ``row`` names the columns of a scored (posting, profile) row, as
    ``ranking.score_pairs`` produces them.
    """
    available = {n: row["available"][n] for n in ("required", "preferred", "experience")}
    gate = gates(row["final_score"], row["confidence"], available["required"])
    weights = F.struct(F.lit(0.0).alias("role"), *[F.lit(w).alias(n) for n, w in S.FIT_WEIGHTS.items()])
    shares = row["fit"]["contributions"]
    required, preferred = row["required"], row["preferred"]

    def unsatisfied(results: Column) -> Column:
        return F.filter(results, lambda r: ~r["satisfied"])

    return F.struct(
        row["job_profile"].alias("job_profile"), row["profile"].alias("resume_name"),
        score_band(row["final_score"]).alias("score_band"),
        row["selection_score"].alias("resume_selection_score"),
        F.struct(*[F.lit(w).alias(n) for n, w in S.SELECTION_WEIGHTS.items()]).alias("resume_selection_weights"),
        F.lit(S.MANUAL_THRESHOLD).alias("manual_threshold"), F.lit(S.MANUAL_CONFIDENCE).alias("minimum_confidence"),
        C.round2(row["final_score"] - S.MANUAL_THRESHOLD).alias("threshold_distance"),
        row["confidence"].alias("confidence"), row["fit"]["active_weight"].alias("active_weight"),
        row["fit"]["total_weight"].alias("total_weight"), weights.alias("weights"),
        F.struct(F.lit(0.0).alias("role"), *[shares[n].alias(n) for n in S.FIT_WEIGHTS]).alias("weighted_contributions"),
        row["final_score"].alias("weighted_total"),
        F.struct(
            available["required"].alias("required"), available["preferred"].alias("preferred"),
            F.lit(True).alias("semantic"), available["experience"].alias("experience"),
        ).alias("component_availability"),
        gate["score_gate"].alias("score_gate"), gate["confidence_gate"].alias("confidence_gate"),
        gate["required_evidence_gate"].alias("required_evidence_gate"), gate["manual_ready"].alias("manual_ready"),
        gate["gate_failures"].alias("gate_failures"),
        required["units"].alias("required_units"), required["satisfied"].alias("required_satisfied"),
        preferred["units"].alias("preferred_units"), preferred["satisfied"].alias("preferred_satisfied"),
        row["required_min"].alias("required_minimum_years"), F.lit(S.APPLICANT_YEARS).alias("applicant_years"),
        row["semantic_raw"].alias("semantic_raw"), row["semantic_score"].alias("semantic_normalized"),
        required["matched"].alias("matched_required"), required["missing"].alias("missing_required"),
        required["groups"].alias("required_groups"),
        unsatisfied(required["groups"]).alias("unsatisfied_required_groups"),
        preferred["matched"].alias("matched_preferred"), preferred["missing"].alias("missing_preferred"),
        preferred["groups"].alias("preferred_groups"),
        unsatisfied(preferred["groups"]).alias("unsatisfied_preferred_groups"),
        warnings(
            row["final_score"], row["confidence"], row["required_score"], row["experience_score"], available
        ).alias("warnings"),
    )


# --- the alternative model: missing components count as neutral --------------


def neutral_selection(role: Column, semantic: Column, required: Column, required_available: Column) -> Column:
    w = S.SELECTION_WEIGHTS
    effective = F.when(required_available, required).otherwise(F.lit(S.NEUTRAL_SCORE))
    return C.round2(
        role * F.lit(w["role"] / 100.0) + semantic * F.lit(w["semantic"] / 100.0)
        + effective * F.lit(w["required"] / 100.0)
    )


def neutral_fit(scores: Mapping[str, Column], available: Mapping[str, Column], bind: Bind = repeated) -> Column:
    """``struct<final_score, confidence, route>``: rounded contributions, routed by score alone."""
    total, evidence = F.lit(0.0), F.lit(0.0)
    for name, weight in S.FIT_WEIGHTS.items():
        effective = F.when(available[name], scores[name]).otherwise(F.lit(S.NEUTRAL_SCORE))
        total = total + C.round2(effective * F.lit(weight) / 100.0)
        evidence = evidence + F.when(available[name], F.lit(weight)).otherwise(F.lit(0.0))

    def routed(final: Column) -> Column:
        return F.struct(
            final.alias("final_score"), C.round2(evidence).alias("confidence"),
            F.when(final >= S.MANUAL_THRESHOLD, F.lit("MANUAL_PRIORITY")).otherwise(F.lit("AGENT_APPLY")).alias("route"),
        )

    return bind(total, lambda sum_: bind(C.round2(sum_), routed))
