"""Experience mentions, the experience gate and the experience score."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.literals import required_literals
from ..functions.spans import context, find_all, window
from ..rules import experience as E
from ..rules import scoring as S
from ..schemas import MENTION

_ANY_YEARS = r"(?iU)\d\s*\+?\s*(?:years?|yrs?)\b"
_NONE = f"array<{MENTION}>"


#: Decimal digits of all scripts below the third plane, and their values.
_DIGITS = [chr(c) for c in range(0x20000) if unicodedata.decimal(chr(c), None) is not None]
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def whole_number(digits: Column) -> Column:
    """A run of decimal digits of any script as a number; the largest one where 64 bits do not hold it."""
    return F.coalesce(F.translate(digits, "".join(_DIGITS), _VALUES).try_cast("bigint"), F.lit((1 << 63) - 1))


def _candidates(text: Column, kind: str, pattern: str) -> Column:
    """Mentions of one kind that stand in an experience context."""
    regex = C.java(pattern)

    def build(span: Column) -> Column:
        first = whole_number(F.regexp_extract(span["match"], regex, 1))
        second = whole_number(F.regexp_extract(span["match"], regex, 2)) if kind == "range" else first
        near = F.lower(window(text, span["start"], span["end"], E.DEGREE_LOOKBACK, E.DEGREE_LOOKAHEAD))

        def judge(around: Column, low: Column) -> Column:
            degree = C.contains_any(low, E.DEGREE_TERMS) & ~F.contains(near, F.lit(E.EXPERIENCE_TERM))
            return F.when(
                F.contains(low, F.lit(E.EXPERIENCE_TERM)) & ~degree,
                F.struct(
                    F.lit(kind).alias("type"), span["match"].alias("match"),
                    F.least(first, second).alias("min_years"), F.greatest(first, second).alias("max_years"),
                    C.contains_any(low, E.PREFERRED_WORDS).alias("preferred"), around.alias("text"),
                    span["start"].alias("start"), span["end"].alias("end"),
                ),
            )

        around = context(text, span["start"], span["end"], E.CONTEXT_RADIUS)
        return C.let(around, lambda a: C.let(F.lower(a), lambda low: judge(a, low)))

    return F.array_compact(F.transform(find_all(text, regex), build))


def _clear_of(taken: Column):
    return lambda m: ~F.exists(taken, lambda t: (m["start"] < t["end"]) & (m["end"] > t["start"]))


def with_mentions(df: DataFrame, text: str = "text", into: str = "mentions") -> DataFrame:
    """Add ``array<mention>``: the most specific kind first, later kinds never overlap an accepted one.

    Each kind is its own projection, so Spark computes it once although every
    later kind looks at it.  Texts without any year phrase skip all of it.
    """
    source = F.col(text)
    low = F.lower(source)
    has_years = (F.contains(low, F.lit("year")) | F.contains(low, F.lit("yr"))) & source.rlike(_ANY_YEARS)
    names = []
    for number, (kind, pattern) in enumerate(E.MENTION_KINDS):
        name = f"_kind{number}"
        taken = reduce(lambda a, b: F.concat(a, b), [F.col(n) for n in names]) if names else None
        free = _candidates(source, kind, pattern)
        if taken is not None:
            free = F.filter(free, _clear_of(taken))
        needed = required_literals([pattern]) or []
        worth = has_years & C.contains_any(low, needed) if needed else has_years
        df = df.withColumn(name, F.when(worth, free).otherwise(F.array().cast(_NONE)).cast(_NONE))
        names.append(name)
    return C.pinned(df, {into: F.concat(*names)}).drop(*names)


def binding_years(mentions: Column) -> Column:
    """Minimum years of every mention that is not merely preferred."""
    return F.transform(F.filter(mentions, lambda m: ~m["preferred"]), lambda m: m["min_years"])


def classify_experience(mentions: Column) -> Column:
    """REJECT from five binding years on, REVIEW at exactly four, else ACCEPT."""
    years = binding_years(mentions)
    return C.ladder(
        [
            (F.exists(years, lambda y: y >= E.REJECT_YEARS), F.lit("REJECT")),
            (F.array_contains(years, E.REVIEW_YEARS), F.lit("REVIEW")),
        ],
        F.lit("ACCEPT"),
    )


def required_years(mentions: Column) -> Column:
    """Largest binding minimum, null without one."""
    return F.array_max(binding_years(mentions))


def experience_score(required_min: Column, applicant_years: int = S.APPLICANT_YEARS) -> Column:
    gap = required_min - F.lit(applicant_years)
    return C.ladder(
        [(required_min.isNull() | (gap <= 0), F.lit(100.0)), (gap <= 1, F.lit(65.0))], F.lit(0.0)
    )


def split_by_experience(postings: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted, review and rejected postings with their mentions."""
    marked = with_mentions(postings, text).withColumn("experience_status", classify_experience(F.col("mentions")))
    return tuple(marked.filter(F.col("experience_status") == s) for s in ("ACCEPT", "REVIEW", "REJECT"))
