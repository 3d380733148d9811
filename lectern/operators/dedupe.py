"""Ordered distinct operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key; an aggregation, so a hot key combines before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
