"""Keyed writes as joins: insert-ignore, upserts, purge; versions of a written table."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.model import REFERENCES
from stockloom.sources.tables import Tables


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``stored`` plus the new rows whose key is not there yet."""
    fresh = new.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def upsert_rows(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Insert or update on ``keys``, which are compared null-safe.

    An existing row takes the columns in ``update`` from the incoming row, nulls included, and keeps
    the others; without ``update`` it takes every incoming column.
    """
    update = [c for c in incoming.columns if c not in keys] if update is None else list(update)
    left = stored.select(F.struct(*keys).alias("_key"), F.struct("*").alias("old"))
    right = incoming.select(F.struct(*keys).alias("_key"), F.struct("*").alias("new"))
    both = left.join(right, "_key", "full")
    columns = [*stored.columns, *[c for c in incoming.columns if c not in stored.columns]]

    def value(name):
        old = F.col(f"old.{name}") if name in stored.columns else F.lit(None)
        if name not in incoming.columns:
            return old.alias(name)
        if name in keys:
            return F.col(f"_key.{name}").alias(name)
        new = F.col(f"new.{name}")
        if name in update:
            return F.when(F.col("new").isNotNull(), new).otherwise(old).alias(name)
        return F.when(F.col("old").isNull(), new).otherwise(old).alias(name)

    return both.select(*[value(c) for c in columns])


def apply_changes(stored: DataFrame, changed: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """``stored`` with the rows of ``changed`` put in place of those with the same key."""
    kept = stored.join(changed.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changed, allowMissingColumns=True)


def purge(t: Tables, roots: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Delete the rows each condition selects and everything owned by them, children first.

    Returns the remaining rows of every table touched. Line rows go with their header; other
    referring rows stay, and the foreign-key check reports them.
    """
    doomed: dict[str, DataFrame] = {}
    for table, condition in roots.items():
        doomed[table] = t[table].filter(condition).select("id")
    for reference in _owned_order():
        if reference.parent in doomed:
            owned = t[reference.child].join(
                doomed[reference.parent].withColumnRenamed("id", reference.column), reference.column, "left_semi"
            ).select("id")
            doomed[reference.child] = doomed[reference.child].union(owned) if reference.child in doomed else owned
    return {table: t[table].join(ids, "id", "left_anti") for table, ids in doomed.items()}


def _owned_order():
    """Owning references; no owned table owns another, so one pass is enough."""
    return [r for r in REFERENCES if r.cascade]


def publish(df: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as a new version under ``folder``. Readers see it once it is complete."""
    path = f"{folder}/version-{time.time_ns():020d}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest complete version under ``folder``, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    names = sorted(
        (status.getPath().toString() for status in fs.listStatus(path) if status.getPath().getName().startswith("version-")), reverse=True
    )
    for name in names:
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{name}/_SUCCESS")):
            return spark.read.parquet(name)
    return None


def append_rows(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Append the result of a query to a stored table."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
