"""One row per key, chosen by an order, as an aggregate: partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greatest_by(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    """Per key the payload of the row with the greatest ``rank``, compared left to right."""
    return _pick(df, keys, rank, payload, F.max)


def least_by(df: DataFrame, keys: Sequence[str], rank: Sequence[Column], payload: Sequence[str]) -> DataFrame:
    return _pick(df, keys, rank, payload, F.min)


def _pick(df, keys, rank, payload, choose):
    row = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], *[F.col(p).alias(f"p{i}") for i, p in enumerate(payload)])
    chosen = df.groupBy(*keys).agg(choose(row).alias("_row"))
    return chosen.select(*keys, *[F.col(f"_row.p{i}").alias(p) for i, p in enumerate(payload)])
