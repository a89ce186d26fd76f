"""Frames whose extra columns cannot clash with an operator's own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shielded(docs: DataFrame, needed: list[str]) -> DataFrame:
    """``docs`` with all columns but ``needed`` renamed to ``own_<place>``."""
    return docs.toDF(*[c if c in needed else f"own_{i}" for i, c in enumerate(docs.columns)])


def restored(df: DataFrame, docs: DataFrame, needed: list[str]) -> DataFrame:
    """The columns of ``docs`` again, from a frame that came from ``shielded``."""
    names = [c if c in needed else f"own_{i}" for i, c in enumerate(docs.columns)]
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
