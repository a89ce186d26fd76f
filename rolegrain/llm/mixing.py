"""Mixing sources to target weights by weighted fair queueing, with built-in column functions only.

Every source is a queue of its shuffled documents, served ``passes`` times at most. The virtual finish time of copy ``n`` of a
document is the words its source has served by then, ``n`` whole passes and the documents up to and including it, divided by
the source's target. Copies are served in the order of virtual finish times; at virtual time 1 every source has had its target
and the total budget is used up, so the order is truncated there, and the document in service at that moment is taken in part
(or as a whole if more than half was served).

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, ordered last; equal
rows are separate documents; of equal finish times the smaller document is served first; texts of any length are only counted;
sources without words get target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import restored, shielded

#: Ranges of the shuffle order per source, so that a source that holds most rows is summed by many tasks.
SLICES = 1024


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``mix_target`` per ``mix_source``: ``share`` of all sizes by weight, at most ``most`` times the source's size.

    What a capped source leaves is shared again by weight until none is above its cap. That ends at the level where the
    uncapped sources take ``level * weight``; in ascending order of cap / weight it is the first level below the next cap.
    One row per source, so one task orders them.
    """
    by_name = Window.orderBy(F.col("mix_source") == "", "mix_source")
    by_ratio = Window.orderBy("ratio", "mix_source")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.partitionBy()
    place = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int") + 1
    weighed = (
        sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place))
        .withColumn("cap", F.lit(most) * F.col("mix_source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("mix_source_size").over(everywhere))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everywhere)["level"]
    return weighed.withColumn("level", level).select(
        "mix_source", "mix_source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("mix_target"),
    )


def served(docs: DataFrame, weights: tuple[int, ...], share: float, passes: int, seed: str, whole: bool) -> DataFrame:
    """Rows of ``docs`` (columns of other names than ``mix_...``) with ``mix_size``, ``mix_source_size``, ``mix_target``,
    ``mix_taken`` and ``mix_upto``, the words its source has served in the first pass up to and including the document."""
    own = [F.col(c) for c in docs.columns]
    # A key without nulls, in the order of the sources: null sorts as the empty string and is moved to the end.
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = docs.select(*own, words(F.col("text")).alias("mix_size"), source.alias("mix_source"), key.alias("mix_key"))
    sized = sized.withColumn("mix_slice", (F.conv(F.substring("mix_key", 1, 6), 16, 10).cast("long") % SLICES).cast("int"))
    slices = sized.groupBy("mix_source", "mix_slice").agg(F.sum("mix_size").alias("slice_size"))
    earlier = Window.partitionBy("mix_source").orderBy("mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("mix_source", "mix_slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("mix_offset"))
    goals = targets(slices.groupBy("mix_source").agg(F.sum("slice_size").alias("mix_source_size")), weights, share, float(passes))
    within = Window.partitionBy("mix_source", "mix_slice").orderBy("mix_key", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        sized.withColumn("mix_upto", F.sum("mix_size").over(within))
        .join(offsets.join(goals, "mix_source"), ["mix_source", "mix_slice"])
        .withColumn("mix_upto", F.col("mix_upto") + F.col("mix_offset"))
    )
    size, goal = F.col("mix_size"), F.col("mix_target")
    taken = F.lit(0)
    for n in range(passes):
        start = F.col("mix_upto") - size + n * F.col("mix_source_size")
        part = F.greatest(F.lit(0), F.least(size, F.floor(goal).cast("long") - start))
        taken = taken + (F.when(part * 2 > size, size).otherwise(F.lit(0)) if whole else part)
    return joined.withColumn("mix_taken", taken.cast("long")).select(*own, "mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_upto", "mix_key")


def finish(copy: Column) -> Column:
    """Virtual finish time of a copy: what its source has served by then, over the source's target."""
    return F.when(F.col("mix_target") > 0, (F.col("mix_upto") + copy * F.col("mix_source_size")) / F.col("mix_target"))


NEEDED = ["doc_id", "text", "source"]


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: str = "mix", whole: bool = False,
) -> DataFrame:
    """Rows of ``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_taken`` and ``mix_finish``.

    ``mix_taken`` counts words with repeats; ``mix_finish`` is the virtual finish time of the first pass. With ``whole`` a
    document is never cut. Rows come in the order of service. Columns of ``docs`` with these names give way to the new ones.
    """
    done = served(shielded(docs, NEEDED), weights, share, passes, seed, whole).withColumn("mix_finish", finish(F.lit(0)))
    made = ["mix_size", "mix_source_size", "mix_target", "mix_taken", "mix_finish"]
    names = [(c if c in NEEDED else f"own_{i}", c) for i, c in enumerate(docs.columns) if c not in made]
    return done.sort(F.col("mix_finish").asc_nulls_last(), "mix_size").select(*[F.col(n).alias(c) for n, c in names], *made)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2, seed: str = "mix") -> DataFrame:
    """Whole documents as often as the mix takes them, with the columns of ``docs``, in the order of service.

    Every copy has its own finish time: the second copies of a source follow its first ones.
    """
    taken = served(shielded(docs, NEEDED), weights, share, passes, seed, True).filter("mix_taken > 0")
    times = (F.col("mix_taken") / F.col("mix_size")).cast("int")
    copies = taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), times - 1)))
    return restored(copies.sort(finish(F.col("mix_copy")), "mix_size", "mix_key"), docs, NEEDED)
