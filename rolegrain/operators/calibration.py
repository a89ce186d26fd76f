"""Samples and comparisons used to tune the scoring model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..rules import scoring as S

# Sizes of the sample parts.
TOP, NEAR_THRESHOLD, BOTTOM, MOST_WARNED, LOW_CONFIDENCE = 3, 5, 3, 5, 5
REVIEW_TOP = 5


def _heads(rows: DataFrame, keys: Sequence[str], parts: Sequence[tuple[Column, Sequence[Column], int, bool]]) -> DataFrame:
    """Ordered heads of one frame in one pass: ``part`` and ``place`` beside the columns of ``rows``.

    Each part is (rows that take part, up to two ascending numbers to order by, size, keys downwards).  A row becomes one
    copy per part it takes part in; the bound on the row number lets every task drop all but its own heads before they meet.
    """
    zero = F.lit(0.0)
    copies = [
        F.when(condition, F.struct(
            F.lit(number).alias("part"), F.lit(size).alias("size"), *[o.cast("double").alias(f"o{i}") for i, o in enumerate([*order, zero][:2])], F.lit(down).alias("down"),
        ))
        for number, (condition, order, size, down) in enumerate(parts)
    ]
    spread = rows.withColumn("_copy", F.explode(F.array_compact(F.array(*copies))))
    up = [F.when(~F.col("_copy.down"), F.col(k)).asc() for k in keys]
    down = [F.when(F.col("_copy.down"), F.col(k)).desc() for k in keys]
    window = Window.partitionBy("_copy.part").orderBy("_copy.o0", "_copy.o1", *up, *down)
    ranked = spread.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= max(p[2] for p in parts))
    return ranked.filter(F.col("place") <= F.col("_copy.size")).withColumn("part", F.col("_copy.part")).drop("_copy")


def select_examples(scored: DataFrame, keys: Sequence[str] = ("board_token", "posting_id")) -> DataFrame:
    """Calibration sample: top, nearest to the threshold, bottom, most warned, least evidence.

    Needs ``score``, ``confidence`` and ``warning_count``, and keeps just them,
    the keys, ``part`` and ``place``.  Each part is a bounded head of the frame, all of one pass;
    a posting in two parts keeps the first.
    """
    score, confidence, warned = F.col("score"), F.col("confidence"), F.col("warning_count")
    every = F.lit(True)
    sample = _heads(scored.select(*keys, "score", "confidence", "warning_count"), keys, [
        (every, [-score], TOP, False),
        (every, [F.abs(score - S.MANUAL_THRESHOLD)], NEAR_THRESHOLD, False),
        (every, [score], BOTTOM, True),
        (warned > 0, [-warned, -score], MOST_WARNED, False),
        (confidence < S.MANUAL_CONFIDENCE, [confidence, -score], LOW_CONFIDENCE, False),
    ])
    # The bottom part is read from the better end, like the rest of the sorted list.
    place = F.when(F.col("part") == 2, F.lit(BOTTOM + 1) - F.col("place")).otherwise(F.col("place"))
    return C.first_by_rank(sample.withColumn("place", place), keys, [F.asc("part"), F.asc("place")])


def review_set(compared: DataFrame, keys: Sequence[str] = ("board_token", "posting_id")) -> DataFrame:
    """Route changes, then evidence-held postings, then the top of the list, each posting once.

    Needs ``current_route``, ``route``, ``score``, and keeps just them, the keys
    and ``part`` (0, 1, 2).  One pass: only copies for the top of the list are bounded by their place.
    """
    own = (
        F.when(F.col("current_route") != F.col("route"), F.lit(0))
        .when((F.col("score") >= S.MANUAL_THRESHOLD) & (F.col("route") != "MANUAL_PRIORITY"), F.lit(1))
    )
    narrow = compared.select(*keys, "current_route", "route", "score")
    spread = narrow.withColumn("part", F.explode(F.array_compact(F.array(own, F.lit(2)))))
    # All copies for the top meet in one group, of which every task keeps its own head; the others have groups of their own.
    group = F.when(F.col("part") < 2, F.to_json(F.struct(*keys, "part")))
    window = Window.partitionBy("_group").orderBy(F.desc("score"), *keys)
    placed = spread.withColumn("_group", group).withColumn("_place", F.row_number().over(window)).filter(F.col("_place") <= REVIEW_TOP)
    return C.first_by_rank(placed.drop("_group", "_place"), keys, [F.asc("part")])


def compare_models(current: DataFrame, proposed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row of counts over two scored frames joined by posting.

    Both need ``route``, ``profile``, ``score`` and ``confidence``.
    """
    old = current.select(*keys, F.col("route").alias("current_route"), F.col("profile").alias("current_profile"))
    return count_changes(proposed.join(old, list(keys)))


def count_changes(both: DataFrame) -> DataFrame:
    """The same counts over rows that hold both models: ``current_route`` and ``current_profile`` beside the proposed model's columns."""
    manual = "MANUAL_PRIORITY"
    over = F.col("score") >= S.MANUAL_THRESHOLD
    return both.agg(
        F.count("*").alias("compared"),
        F.count_if(F.col("current_route") == manual).alias("current_manual"),
        F.count_if(F.col("route") == manual).alias("proposed_manual"),
        F.count_if(over).alias("fit_above_threshold"),
        F.count_if(F.col("current_route") != F.col("route")).alias("route_changes"),
        F.count_if(F.col("current_profile") != F.col("profile")).alias("profile_changes"),
        F.count_if(over & (F.col("route") != manual)).alias("evidence_held"),
        F.count_if(F.col("confidence") < S.MANUAL_CONFIDENCE).alias("low_confidence"),
    )
