"""All matches of a pattern with their positions, as a native array column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
#: Pieces per block of running lengths.
BLOCK = 256
SPAN = "array<struct<start: int, end: int, match: string>>"


def find_all(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, match>>`` in text order, counted in characters.

    Every match is wrapped in two marker characters, the text is cut at the
    opening one, and running lengths give the positions.  Spark has no
    built-in that returns the offsets of all matches.  Lengths run within
    blocks of pieces and then over the blocks, so a text with very many
    matches does not copy a growing array for each of them.
    """
    clean = F.replace(F.replace(text, F.lit(OPEN), F.lit(" ")), F.lit(CLOSE), F.lit(" "))
    pieces = F.split(F.regexp_replace(clean, pattern, OPEN + "$0" + CLOSE), OPEN)

    def step(state: Column, piece: Column) -> Column:
        # Only the text in front of the first match comes without a closing marker.
        is_match, match = F.contains(piece, F.lit(CLOSE)), F.substring_index(piece, CLOSE, 1)
        span = F.struct(
            state["at"].alias("start"), (state["at"] + F.length(match)).alias("end"), match.alias("match")
        )
        return F.struct(
            (state["at"] + F.length(piece) - is_match.cast("int")).alias("at"),
            F.when(is_match, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"),
        )

    def shift(state: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct(
            (s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["match"].alias("match"),
        ))
        return F.struct((state["at"] + block["at"]).alias("at"), F.concat(state["out"], F.array(moved)).alias("out"))

    def whole(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        count = F.floor((F.size(parts) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda n: F.aggregate(F.slice(parts, n * BLOCK + 1, BLOCK), start, step))
        none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(blocks, none, shift, lambda state: F.flatten(state["out"]))

    # The pieces as a lambda variable: computed once, not for every block.
    return F.when(text.isNotNull(), F.get(F.transform(F.array(pieces), whole), F.lit(0)))


def context(text: Column, start: Column, end: Column, radius: int) -> Column:
    """Text around a span, clipped at both ends and trimmed."""
    return window(text, start, end, radius, radius)


def window(text: Column, start: Column, end: Column, before: int, after: int) -> Column:
    from .columns import strip

    left = F.greatest(start - F.lit(before), F.lit(0))
    return strip(F.substr(text, left + F.lit(1), end + F.lit(after) - left))


def first_span(text: Column, pattern: str) -> Column:
    """Start of the first match in characters; the length before the first cut."""
    return F.length(F.element_at(F.split(text, pattern, 2), 1))
