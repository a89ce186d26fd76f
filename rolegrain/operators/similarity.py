"""Similarity of posting text and profiles from chunk vectors.

Vectors are input columns.  The numeric work is a matrix product: of an Arrow batch of posting chunks with a short list of
profile vectors, or of a bucket of postings with a slice of a long one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..rules import scoring as S
from ..session import fits

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    norm = F.sqrt(dot(vector, vector))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def _rows_of_unit_length(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1.0)


#: Posting chunks per bucket and profile vectors per slice, about: what one block product takes.
CHUNKS, VECTORS = 4096, 2048
#: Postings whose best chunk scores a task holds before it passes them on.
HELD = 20_000


def _best_per_profile(chunks: np.ndarray, vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For every chunk its largest similarity to the vectors of every profile."""
    return np.maximum.reduceat(_rows_of_unit_length(chunks) @ vectors.T, starts, axis=1)


def _profile_vectors(profile_chunks: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Profile names in order, unit vectors sorted by profile, and where each profile's vectors start."""
    table = profile_chunks.select(F.col("profile").cast("string"), F.col("vec").cast("array<double>")).toArrow().sort_by("profile")
    if not table.num_rows:
        return [], np.zeros((0, 0)), np.zeros(0, int)
    names, starts = np.unique(np.array(table.column(0).to_pylist(), str), return_index=True)
    return names.tolist(), _rows_of_unit_length(np.array(table.column(1).to_pylist(), float)), starts


def _best_chunks(chunks: DataFrame, keys: Sequence[str], vectors: np.ndarray, starts: np.ndarray, top: int) -> DataFrame:
    """Keys and ``_top``: per profile the ``top`` largest chunk scores that one task has met for the posting."""
    schema = T.StructType([T.StructField(c, chunks.schema[c].dataType) for c in keys] + [T.StructField("_top", T.ArrayType(T.ArrayType(T.DoubleType())))])
    spread = chunks.sparkSession.sparkContext.broadcast((vectors, starts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def passed_on() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v.T.tolist() for v in held.values()])], [*keys, "_top"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [c.type for c in batch.columns[:-1]]
            names = list(zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True))
            values = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best = _best_per_profile(values, *spread.value)
            places: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for name, rows in places.items():
                mine = best[rows] if name not in held else np.concatenate([held[name], best[rows]])
                held[name] = -np.sort(-mine, axis=0)[:top]
            if len(held) >= HELD:
                yield passed_on()
                held = {}
        if held:
            yield passed_on()

    return chunks.select(*keys, F.col("vec").cast("array<double>").alias("vec")).mapInArrow(work, schema)


def semantic_by_posting(
    chunks: DataFrame, profile_chunks: DataFrame, keys: Sequence[str], top: int = S.TOP_CHUNKS,
    per_bucket: int = CHUNKS, per_slice: int = VECTORS,
) -> DataFrame:
    """Mean of the best chunk scores in percent, one row per posting: keys and ``semantic``, an ``array<struct<profile, semantic_raw>>``.

    A profile list of one slice that fits a broadcast goes to the postings: vectors stay where they are, and only the best
    ``top`` scores per profile that a task has met are shuffled.  Longer lists are met in blocks.
    """
    if not fits(profile_chunks, per_slice):
        rows = semantic_in_blocks(chunks, profile_chunks, keys, top, per_bucket, per_slice)
        return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("profile", "semantic_raw"))).alias("semantic"))
    names, vectors, starts = _profile_vectors(profile_chunks)
    if not names:
        empty = F.array().cast("array<struct<profile: string, semantic_raw: double>>")
        return chunks.select(*keys).distinct().withColumn("semantic", empty)
    met = _best_chunks(chunks, keys, vectors, starts, top).groupBy(*keys).agg(F.collect_list("_top").alias("_parts"))

    def score(name: Column, place: Column) -> Column:
        every = F.flatten(F.transform("_parts", lambda part: F.get(part, place)))
        mean = C.let(F.slice(F.sort_array(every, asc=False), 1, top), lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))
        return F.struct(name.alias("profile"), C.let(mean * 100.0, C.round2).alias("semantic_raw"))

    listed = F.array(*map(F.lit, names))
    return met.select(*keys, F.transform(listed, score).alias("semantic"))


def semantic_scores(
    chunks: DataFrame, profile_chunks: DataFrame, keys: Sequence[str], top: int = S.TOP_CHUNKS,
    per_bucket: int = CHUNKS, per_slice: int = VECTORS,
) -> DataFrame:
    """The same, one row per posting and profile: keys, ``profile``, ``semantic_raw``."""
    return semantic_by_posting(chunks, profile_chunks, keys, top, per_bucket, per_slice).select(*keys, F.inline("semantic"))


def semantic_in_blocks(
    chunks: DataFrame, profile_chunks: DataFrame, keys: Sequence[str], top: int = S.TOP_CHUNKS,
    per_bucket: int = CHUNKS, per_slice: int = VECTORS,
) -> DataFrame:
    """The same for profile lists of any length.

    Postings are dealt to buckets and profiles to slices, each with all its vectors.  A bucket meets a slice in one block
    product; it yields the finished mean per posting and profile, so no chunk-profile pair becomes a row.
    """
    buckets = max(1, -(-chunks.count() // per_bucket))
    slices = max(1, -(-profile_chunks.count() // per_slice))
    left = chunks.select(
        *keys, F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_bucket"),
        F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"),
    )
    right = profile_chunks.select(
        "profile", F.col("vec").cast("array<double>").alias("vec"), F.pmod(F.xxhash64("profile"), F.lit(slices)).cast("int").alias("_slice"),
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("_bucket"),
    )
    names = list(keys)

    def meet(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in [*names, "profile"]} | {"_mean": pd.Series(dtype=float)})
        other = other.sort_values("profile", kind="stable")
        profiles, starts = np.unique(other["profile"].to_numpy(str), return_index=True)
        best = _best_per_profile(np.array(own["vec"].tolist(), float), _rows_of_unit_length(np.array(other["vec"].tolist(), float)), starts)
        groups = own.groupby(names, sort=False, dropna=False)
        rows = [own.iloc[[place[0]]][names].assign(_n=n) for n, place in enumerate(groups.indices.values())]
        means = np.stack([-np.sort(-best[place], axis=0)[:top].mean(axis=0) for place in groups.indices.values()])
        keyed = pd.concat(rows).loc[lambda f: f.index.repeat(len(profiles))]
        return keyed[names].assign(profile=np.tile(profiles, len(rows)), _mean=means.ravel())

    schema = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in names) + ", profile string, _mean double"
    met = left.groupBy("_bucket", "_slice").cogroup(right.groupBy("_bucket", "_slice")).applyInPandas(meet, schema)
    return met.select(*names, "profile", C.round2(F.col("_mean") * 100.0).alias("semantic_raw"))
