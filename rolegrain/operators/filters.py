"""Rule classifiers and filters on one posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import locations as L
from ..rules import titles as T
from . import text as X


def is_target_role(title: Column) -> Column:
    return C.any_of(title, T.TARGET_ROLES)


def is_too_senior(title: Column) -> Column:
    return C.any_of(title, T.SENIORITY)


def keep_role(title: Column) -> Column:
    return is_target_role(title) & ~is_too_senior(title)


def title_exclusion(title: Column) -> Column:
    """Text that marks a title as not full-time, else null."""
    lowered = F.lower(C.strip(F.coalesce(title, F.lit(""))))
    contract = F.when(~C.any_of(lowered, T.SMART_CONTRACT_TITLES), C.first_match(lowered, T.CONTRACT_TITLES))
    return F.coalesce(C.first_match(lowered, T.NON_FULL_TIME_TITLES), contract)


def structured_employment(metadata: Column) -> Column:
    """``struct<status, evidence>`` from the first employment field with a known value."""

    def known(pair: Column) -> Column:
        value = F.trim(F.replace(pair["value"], F.lit("_"), F.lit(" ")))
        return F.when(value.isin(T.FULL_TIME_VALUES), F.lit("FULL_TIME")).when(
            value.isin(T.NON_FULL_TIME_VALUES), F.lit("NON_FULL_TIME")
        )

    hits = F.filter(
        F.transform(
            F.filter(X.metadata_pairs(metadata), lambda p: p["name"].isin(T.EMPLOYMENT_FIELDS)),
            lambda p: F.struct(
                known(p).alias("status"), F.concat(p["name"], F.lit(": "), p["value"]).alias("evidence")
            ),
        ),
        lambda h: h["status"].isNotNull(),
    )
    none = F.struct(F.lit("UNKNOWN").alias("status"), F.lit(None).cast("string").alias("evidence"))
    return F.coalesce(F.get(hits, F.lit(0)), none)


def classify_employment(title: Column, metadata: Column) -> Column:
    """``struct<decision, employment_type, reason, evidence>``: title first, then metadata."""
    word, found = title_exclusion(title), structured_employment(metadata)

    def outcome(decision: str, kind: str, reason: str, evidence: Column) -> Column:
        return F.struct(
            F.lit(decision).alias("decision"), F.lit(kind).alias("employment_type"),
            F.lit(T.EMPLOYMENT_REASONS[reason]).alias("reason"), evidence.alias("evidence"),
        )

    return C.ladder(
        [
            (word.isNotNull(), outcome("REJECT", "NON_FULL_TIME", "title", word)),
            (found["status"] == "NON_FULL_TIME",
             outcome("REJECT", "NON_FULL_TIME", "non_full_time", found["evidence"])),
            (found["status"] == "FULL_TIME", outcome("ACCEPT", "FULL_TIME", "full_time", found["evidence"])),
        ],
        outcome("ACCEPT_UNKNOWN", "UNKNOWN", "unknown", F.lit(None).cast("string")),
    )


def classify_location_text(location: Column) -> Column:
    """One location string to US, NON_US or UNKNOWN."""
    original = C.strip(F.coalesce(location, F.lit("")))
    lowered = F.lower(original)
    pieces = F.transform(F.split(original, "[,/|]"), lambda p: F.upper(C.strip(p)))
    places = r"(?U)\b(?:" + "|".join(C.regex_quote(p) for p in L.US_CITIES + L.US_STATES) + r")\b"
    return C.ladder(
        [
            (lowered.isin(L.UNKNOWN_VALUES), F.lit("UNKNOWN")),
            (lowered.isin(L.US_EXACT), F.lit("US")),
            (C.contains_any(lowered, L.US_PHRASES), F.lit("US")),
            (lowered.rlike(places), F.lit("US")),
            (F.arrays_overlap(pieces, F.array(*map(F.lit, L.US_STATE_CODES))), F.lit("US")),
            (C.contains_any(lowered, L.NON_US_PHRASES), F.lit("NON_US")),
        ],
        F.lit("UNKNOWN"),
    )


def classify_location(location: Column, offices: Column) -> Column:
    """The posting's own location decides; its offices only where that says nothing."""
    own = classify_location_text(location["name"])
    found = F.transform(X.office_texts(offices), classify_location_text)
    by_office = C.ladder(
        [
            (F.array_contains(found, "US"), F.lit("US")),
            (F.array_contains(found, "NON_US"), F.lit("NON_US")),
        ],
        F.lit("UNKNOWN"),
    )
    return F.when(own != "UNKNOWN", own).otherwise(by_office)


def classify_profile(title: Column) -> Column:
    """Title to one of the candidate profiles; the first pack that hits wins."""
    normal = X.normalize_title(title)
    return C.ladder(
        [(C.any_of(normal, pack), F.lit(profile)) for profile, pack in T.PROFILE_PACKS], F.lit(T.DEFAULT_PROFILE)
    )


def is_active(flag: Column) -> Column:
    """Missing life-cycle information counts as active."""
    return F.coalesce(flag, F.lit(True))


def filter_by_role(postings: DataFrame) -> DataFrame:
    return postings.filter(keep_role(F.col("title")))


def split_by_employment(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected postings, the latter with their classification."""
    marked = postings.withColumn("employment", classify_employment(F.col("title"), F.col("metadata")))
    rejected = F.col("employment.decision") == "REJECT"
    return marked.filter(~rejected).drop("employment"), marked.filter(rejected)


def with_location_status(postings: DataFrame) -> DataFrame:
    return postings.withColumn("location_status", classify_location(F.col("location"), F.col("offices")))


def split_by_location(postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """US, unknown and non-US postings."""
    marked = with_location_status(postings)
    return tuple(marked.filter(F.col("location_status") == s) for s in ("US", "UNKNOWN", "NON_US"))
