"""Approximate nearest neighbours by collision counting.

Vectors are normalised; each of ``lines`` random projections sorts the rows of a shard by their projected value. A query
opens a window around its own value on every line and counts in how many windows a row lies. The windows are widened step by
step (virtual rehashing: a window of the next radius contains that of the last, so only its new parts are counted). A row
whose count passes the threshold is verified with its exact cosine. A query stops once enough rows were verified in the
shard, or when the windows cover everything.

Rows are dealt to shards of about ``SHARD`` rows and queries to blocks of about ``BLOCK``; every block meets every shard
once, in a task of its own. Each task returns the best ``k`` of its shard for every query of its block; the best of all
shards follow from a ranked window over ``k`` rows per query and shard.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as queries nor
as candidates; vectors of another width than most are compared only with their own width; rows with the same id and different
vectors are rows of their own, each a query (with ranks from 1) and a candidate, for each other too; equal rows count once; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINES = 64
#: Rows per shard and queries per block, about.
SHARD, BLOCK = 16_384, 2_048
#: Half-widths of the windows, in standard deviations of a projected unit vector, and the share of lines that must collide.
RADII, SHARE = (0.3, 0.6, 0.9, 1.2), 0.4
#: Share of a shard's rows after which a query stops.
ENOUGH = 0.3


def usable(vector: Column) -> Column:
    """Finite numbers only, at least one of them not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & sound & F.exists(vector, lambda x: x != 0)


def nearest(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the ids and cosines of its ``k`` best verified rows of this shard."""
    raw, asked = rows, queries
    # Powers of two change no cosine, and keep squares of very large and very small components finite.
    rows, queries = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (rows, queries))
    width = rows.shape[1]
    lines = np.random.default_rng(seed).standard_normal((width, LINES))
    lines *= np.sqrt(width) / np.linalg.norm(lines, axis=0)
    norms, query_norms = np.sqrt((rows * rows).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    values, marks = (rows / norms[:, None]) @ lines, (queries / query_norms[:, None]) @ lines
    orders = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
    ordered = np.sort(values, axis=0).T.copy()
    needed, enough = int(np.ceil(SHARE * LINES)), max(20 * k, int(ENOUGH * len(rows)))
    # The ends of every query's window on every line and at every radius; the last covers the whole line.
    ends = [
        (np.stack([np.searchsorted(ordered[i], marks[:, i] - r) for i in range(LINES)]), np.stack([np.searchsorted(ordered[i], marks[:, i] + r, "right") for i in range(LINES)]))
        for r in RADII
    ]
    ends.append((np.zeros_like(ends[0][0]), np.full_like(ends[0][0], len(rows))))
    for q in range(len(queries)):
        counts = np.zeros(len(rows), np.int64)
        same = np.flatnonzero(ids == query_ids[q])
        other = np.ones(len(rows), bool)
        other[same[(raw[same] == asked[q]).all(axis=1)]] = False
        low = high = None
        for lower, upper in ends:
            if low is None:
                fresh = [orders[i, lower[i, q] : upper[i, q]] for i in range(LINES)]
            else:
                fresh = [orders[i, lower[i, q] : low[i, q]] for i in range(LINES)] + [orders[i, high[i, q] : upper[i, q]] for i in range(LINES)]
            counts += np.bincount(np.concatenate(fresh), minlength=len(rows))
            low, high = lower, upper
            passed = np.flatnonzero((counts >= needed) & other)
            if len(passed) >= enough:
                break
        cosines = np.clip((rows[passed] * queries[q]).sum(axis=1) / (norms[passed] * query_norms[q]), -1.0, 1.0)
        best = np.lexsort((ids[passed], -cosines))[:k]
        yield q, ids[passed[best]], cosines[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of ``vectors`` for every row of ``queries``."""

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return own.filter(F.col("id").isNotNull() & usable(F.col("v"))).distinct()

    rows, asked = clean(vectors), clean(queries)
    shards = max(1, -(-vectors.count() // SHARD))
    blocks = max(1, -(-queries.count() // BLOCK))
    width = F.size("v").alias("width")
    dealt = rows.select("id", "v", width, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    sent = asked.select("id", "v", F.xxhash64("v").alias("tag"), width, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    cell = ["width", "shard", "block"]

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            own, wanted = np.stack(left["v"]).astype(float), np.stack(right["v"]).astype(float)
            ids, query_ids, tags = left["id"].to_numpy(), right["id"].to_numpy(), right["tag"].to_numpy()
            for q, found, scores in nearest(own, ids, wanted, query_ids, k, seed):
                out += [(int(query_ids[q]), int(tags[q]), int(i), float(s)) for i, s in zip(found, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "tag", "vec_id", "score"]).astype({"query_id": "int64", "tag": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.groupBy(*cell).cogroup(sent.groupBy(*cell)).applyInPandas(work, "query_id long, tag long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
