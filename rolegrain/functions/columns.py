"""Column expressions shared by the operators. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .literals import required_literals

SPACE = r"(?U)\s+"
FLAGS = "(?iUd)"


def java(pattern: str) -> str:
    """Case-insensitive, Unicode-aware Java form of a rule pattern."""
    return FLAGS + pattern


def one_regex(patterns: Iterable[str], flags: str = FLAGS) -> str:
    """One alternation; where patterns start at a word, the word start is tested before them."""
    at_word = [p[2:] for p in patterns if p.startswith(r"\b")]
    elsewhere = [p for p in patterns if not p.startswith(r"\b")]
    return flags + "(?:" + "|".join(([r"\b(?:" + "|".join(at_word) + ")"] if at_word else []) + elsewhere) + ")"


def any_of(text: Column, patterns: Iterable[str]) -> Column:
    """True when any pattern of the pack occurs; one scan of the text."""
    return F.coalesce(text.rlike(one_regex(patterns)), F.lit(False))


def any_of_lower(low: Column, patterns: Sequence[str]) -> Column:
    """``any_of`` for long lower-cased text: the patterns run only where a literal they need occurs."""
    hit = F.coalesce(low.rlike(one_regex(patterns, "(?Ud)")), F.lit(False))
    literals = required_literals(patterns)
    return hit if literals is None else contains_any(low, literals) & hit


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Text matched by the first pattern of the pack that hits, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, java(p), 0), F.lit("")) for p in patterns])


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """True when any of the literal phrases occurs."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return F.coalesce(hit, F.lit(False))


def ladder(rungs: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """First condition that holds gives the value."""
    result = None
    for condition, value in rungs:
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return default if result is None else result.otherwise(default)


def compact(*items: Column) -> Column:
    """Array of the items that are not null."""
    return F.array_compact(F.array(*items))


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squash(text: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def regex_quote(phrase: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " and ord(c) < 128 else c for c in phrase)


def whole_word(text: Column, word: str) -> Column:
    return F.coalesce(text.rlike(r"(?U)\b" + regex_quote(word) + r"\b"), F.lit(False))


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    ``round`` in Spark works on the shortest decimal text of a double and so
    rounds 2.675 up.  The plain scaled rounding is right except next to a
    tie, and only there the slower exact formatter decides.
    """
    scale = float(10**digits)
    scaled = value * F.lit(scale)
    near_tie = F.abs(scaled - F.floor(scaled) - F.lit(0.5)) < F.lit(1e-6)
    exact = F.call_function("format_number", value, F.lit("0." + "0" * digits)).cast("double")
    return F.when(near_tie | (F.abs(value) >= F.lit(1e9)), exact).otherwise(
        F.floor(scaled + F.lit(0.5)) / F.lit(scale)
    )


def round2(value: Column) -> Column:
    return round_half_even(value, 2)


def safe_text(text: Column, length: int | None = None) -> Column:
    """Trimmed text, cut only where a caller names a ``length``; blank becomes null."""
    whole = F.nullif(strip(text.cast("string")), F.lit(""))
    return whole if length is None else F.left(whole, F.lit(length))


def safe_list(values: Column, items: int | None = None, length: int | None = None) -> Column:
    """The values as safe texts without blanks and repeats; the first ``items`` of these where a caller asks for it."""
    kept = F.array_distinct(F.array_compact(F.transform(F.coalesce(values, empty_strings()), lambda v: safe_text(v, length))))
    return kept if items is None else F.slice(kept, 1, items)


def nonneg_int(value: Column, default: int = 0) -> Column:
    """Whole number of 64 bits, negatives become 0, unreadable values the default."""
    return F.greatest(F.lit(0).cast("bigint"), F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint")))


def nonneg_double(value: Column, default: float = 0.0) -> Column:
    """Number rounded to 3 places; negative and unreadable values become the default."""
    number = value.try_cast("double")
    return F.when(number >= 0, round_half_even(number, 3)).otherwise(F.lit(float(default)))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, lower case otherwise."""
    marked = F.regexp_replace(F.lower(text), r"(?U)(?<![\p{L}])(\p{L})", "\u0001$1")
    parts = F.split(marked, "\u0001")
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(
        F.element_at(parts, 1),
        F.array_join(
            F.transform(rest, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), ""
        ),
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed once, whatever is filtered or exploded behind them.

    Spark moves a filter below the projections it looks at by repeating their
    expressions, which multiplies work built in several steps.  A one-row
    generator lets filters on other columns pass and stops those on its own.
    """
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    kept = [c for c in df.columns if c not in values]
    return df.select(*kept, F.inline_outer(F.array(row)).alias(*values))


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row, without a join."""
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return together.agg(*[F.first(c, ignorenulls=True).alias(c) for c in together.columns])


OWNER = "owner_id"


def owned(keys: Sequence[str], *frames: DataFrame) -> list[str]:
    """``keys`` with the owner's column in front where all frames have one: rows of two owners never meet."""
    own = [OWNER] if OWNER not in keys and all(OWNER in f.columns for f in frames) else []
    return [*own, *keys]


def last_per_key(df: DataFrame, keys: Sequence[str], newest: Sequence[str] = ("fetched_at", "created_at")) -> DataFrame:
    """One row per key: the newest by the first of these columns that there is, then the largest in the short columns.

    Short columns are numbers, dates and flags, in their order; texts and nested values only decide by one hash of them all.
    """
    stamp = [c for c in newest if c in df.columns and c not in keys][:1]
    others = [f for f in df.schema.fields if f.name not in (*keys, *stamp) and "map<" not in f.dataType.simpleString()]
    short = [f.name for f in others if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    long_ = [f.name for f in others if f.name not in short]
    order = [F.desc_nulls_last(c) for c in [*stamp, *short]] + ([F.xxhash64(*long_).desc()] if long_ else [])
    return first_by_rank(df, keys, order or [F.lit(0).asc()])


def first_by_rank(df, keys: Sequence[str], order: Sequence[Column], limit: int = 1, rank: str | None = None):
    """The first ``limit`` rows per key.

    The bound on ``row_number`` lets Spark cut every map task down to
    ``limit`` rows per key before the shuffle, so a hot key stays small.
    """
    from pyspark.sql import Window

    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= limit)
    return kept if rank else kept.drop(name)
