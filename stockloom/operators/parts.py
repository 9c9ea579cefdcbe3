"""Connected parts of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.session import staged


def connected_parts(edges: DataFrame) -> DataFrame:
    """(id, part) for every id in ``edges`` (a, b); a part is named by its least id. Null ends and loops are ignored.

    A step joins and groups edges by node, with partial sums before the shuffle. The steps end when one
    leaves every edge as it was: the edges are then stars around the least ids. No edges give no rows.
    """
    known = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = staged(known.distinct(), "parts")
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = large.join(down, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        after = staged(small.filter("a <> b").distinct(), "parts")
        changed = after.join(e, ["a", "b"], "left_anti")
        if after.count() == e.count() and changed.isEmpty():
            break
        e = after
    centres = e.select(F.col("b").alias("id"), F.col("b").alias("part")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("part")).unionByName(centres)
