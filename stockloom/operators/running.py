"""Running totals and ranks that do not put a whole key into one task.

A plain window gives every row of a key to one task, so one busy key decides the run time. Here the
keys with more than ``rows`` rows are cut along their order: their rows, and only theirs, are dealt
out by ranges of (key, order, row) with borders taken from the rows themselves, so each slice holds
about ``rows`` rows, even if all of them have one instant. The window runs inside a slice, on top of
the sum of the slices before it. All other keys are one slice, shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.session import staged

SLICE_ROWS = 1_000_000


def cut_by_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = SLICE_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """The rows of short keys with ``_slice`` 0, and those of long keys (None without any) with slices from 1.

    A greater slice never holds a row that comes earlier along ``order`` (ascending, nulls first) in its
    key. Rows equal in key and order may fall into different slices. Null keys are keys like any other.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows)
    long_keys = staged(counts.select(F.struct(*keys).alias("_long"), "_rows"), "long-keys")
    total = long_keys.agg(F.sum("_rows")).first()[0]
    if total is None:
        return df.withColumn("_slice", F.lit(0)), None
    of_long = F.struct(*keys) == F.col("_long")
    short = df.join(long_keys, of_long, "left_anti").withColumn("_slice", F.lit(0))
    # The number that parts equal rows is written before rows are dealt out by it: a repeated task must not draw it anew.
    numbered = staged(df.join(long_keys, of_long, "left_semi").withColumn("_row", F.monotonically_increasing_id()), "long-rows")
    dealt = numbered.repartitionByRange(max(2, -(-total // rows)), *keys, *order, "_row")
    return short, staged(dealt.withColumn("_slice", F.spark_partition_id() + 1).drop("_row"), "slices")


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column], rows: int = SLICE_ROWS
) -> DataFrame:
    """Add one running total per entry of ``totals`` along ``order`` (ascending, nulls first) within ``keys``.

    ``order`` should tell rows of a key apart; where it does not, equal rows come in any order. An empty
    input gives an empty result.
    """
    names = list(totals)
    valued = df.select(*[c for c in df.columns if c not in names], *[value.alias(name) for name, value in totals.items()])
    short, long = cut_by_rows(valued, keys, order, rows)
    within = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)

    def inside(part: DataFrame) -> DataFrame:
        return part.withColumns({n: F.sum(n).over(within) for n in names})

    if long is None:
        return inside(short).drop("_slice")
    sums = long.groupBy(*keys, "_slice").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.struct(*keys, "_slice").alias("_at"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names]
    )
    at = F.struct(*keys, "_slice") == F.col("_at")
    raised = inside(long).join(before, at).withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in names})
    return inside(short).unionByName(raised.drop("_at", *[f"_before_{n}" for n in names])).drop("_slice")


def ranks(df: DataFrame, keys: Sequence[str], order: Sequence[str], into: str, rows: int = SLICE_ROWS) -> DataFrame:
    """Row number from 1 along ``order`` within ``keys``, computed slice by slice."""
    return running_totals(df, keys, order, {into: F.lit(1).cast("bigint")}, rows)
