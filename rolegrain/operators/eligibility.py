"""Eligibility findings and decision.

All functions take text as ``combined_text`` gives it: normalised and lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.spans import context, find_all, first_span
from ..rules import eligibility as G
from ..schemas import FINDING
from .text import strip_tags

_NONE = f"array<{FINDING}>"


def combined_text(title: Column, text: Column) -> Column:
    """Title and text as one normalised string."""
    return F.concat(strip_tags(title), F.lit(". "), strip_tags(text))


def has_exception(text: Column, patterns: list[str]) -> Column:
    return C.any_of_lower(text, patterns) if patterns else F.lit(False)


def category_hit(text: Column, patterns: list[str], exceptions: list[str]) -> Column:
    """Whether a category applies, without looking for evidence."""
    return C.any_of_lower(text, patterns) & ~has_exception(text, exceptions)


def find_matches(text: Column, patterns: list[str], category: str, reason: str) -> Column:
    """Every match of every pattern, patterns in order, as ``array<finding>``."""

    def findings(pattern: str) -> Column:
        return F.transform(
            find_all(text, C.java(pattern)),
            lambda s: F.struct(
                F.lit(category).alias("category"), F.lit(reason).alias("reason"),
                context(text, s["start"], s["end"], G.EVIDENCE_RADIUS).alias("evidence"),
            ),
        )

    return F.when(C.any_of_lower(text, patterns), F.concat(*[findings(p) for p in patterns])).otherwise(
        F.array().cast(_NONE)
    )


def all_findings(text: Column) -> Column:
    """Findings of all categories that no exception clears."""
    return F.concat(*[
        F.when(has_exception(text, exceptions), F.array().cast(_NONE)).otherwise(
            find_matches(text, patterns, category, reason)
        )
        for category, reason, patterns, exceptions in G.CATEGORIES
    ])


def dedupe_findings(findings: Column) -> Column:
    """One finding per category, the first one."""

    def first_of(category: str) -> Column:
        return F.get(F.filter(findings, lambda f: f["category"] == category), F.lit(0))

    return C.compact(*[first_of(category) for category, *_ in G.CATEGORIES])


def first_findings(text: Column) -> Column:
    """The same as ``dedupe_findings(all_findings(text))`` without looking for later matches."""

    def first(category: str, reason: str, patterns: list[str], exceptions: list[str]) -> Column:
        def evidence(pattern: str) -> Column:
            regex = C.java(pattern)
            start = first_span(text, regex)
            end = start + F.length(F.regexp_extract(text, regex, 0))
            return F.when(text.rlike(regex), context(text, start, end, G.EVIDENCE_RADIUS))

        return F.when(
            category_hit(text, patterns, exceptions),
            F.struct(
                F.lit(category).alias("category"), F.lit(reason).alias("reason"),
                F.coalesce(*[evidence(p) for p in patterns]).alias("evidence"),
            ),
        )

    return C.compact(*[first(*row) for row in G.CATEGORIES])


def decide(findings: Column) -> Column:
    """``struct<decision, reason>`` from the findings of a posting."""
    categories = F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["category"])))
    flagged = F.size(categories) > 0
    return F.struct(
        F.when(flagged, F.lit("NEEDS_ASSISTANCE")).otherwise(F.lit("PASS")).alias("decision"),
        F.when(flagged, F.concat(F.lit(G.REVIEW_PREFIX), F.array_join(categories, ", "))).alias("reason"),
    )


def with_eligibility(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """Add ``findings`` and ``eligibility``."""
    marked = df.withColumn("_all", combined_text(F.col(title), F.col(text)))
    marked = C.pinned(marked, {"findings": first_findings(F.col("_all"))}).drop("_all")
    return marked.withColumn("eligibility", decide(F.col("findings")))
