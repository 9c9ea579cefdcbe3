"""Typed table access: whole reads, keyed reads, renaming, conforming rows to the model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from stockloom.model import DEFAULTS, LOWERED, SCHEMAS, TIMED


class Tables(Mapping):
    """Table name to DataFrame. Tables are opened when first asked for."""

    def __init__(self, opener: Callable[[str], DataFrame], given: Mapping[str, DataFrame] | None = None):
        self._opener = opener
        self._known = dict(given or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name not in self._known:
            self._known[name] = self._opener(name)
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def replacing(self, **changed: DataFrame) -> Tables:
        return Tables(self._opener, {**self._known, **changed})


def open_tables(spark: SparkSession, folder: str) -> Tables:
    """Every table of the model under ``folder``, read with its declared schema."""
    return Tables(lambda name: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}"))


def tables_from_rows(spark: SparkSession, rows: Mapping[str, list[dict]]) -> Tables:
    """Tables built from literal rows; a table without rows is empty. For small fixtures."""

    def build(name):
        schema = StructType([StructField(f.name, f.dataType, True) for f in SCHEMAS[name]])
        listed = [{"is_deleted": False, **row} for row in rows.get(name, [])]
        return local_rows(spark, listed, schema)

    return Tables(build)


def local_rows(spark: SparkSession, rows: list[dict], schema: StructType) -> DataFrame:
    """Rows as a local relation, whose size the optimizer knows."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(schema)), schema)


def active(df: DataFrame) -> DataFrame:
    """Rows that are not soft-deleted. The filter reaches the Parquet scan."""
    return df.filter(~F.col("is_deleted"))


def where_equals(df: DataFrame, **values) -> DataFrame:
    """Equality filter on one or more columns."""
    for name, value in values.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def where_in_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """S2 in bulk: rows whose ``column`` is among ``keys`` (first column of ``keys``)."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(column)), column, "left_semi")


def found_and_missing(df: DataFrame, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """S3: the rows found for ``keys``, and the keys for which there is none."""
    wanted = keys.select(F.col(keys.columns[0]).alias(column))
    return df.join(wanted, column, "left_semi"), wanted.join(df.select(column), column, "left_anti")


def lookup_or_null(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """One row per key; a key without a stored row gives nulls."""
    return keys.select(F.col(keys.columns[0]).alias(column)).join(df, column, "left")


def to_camel(name: str) -> str:
    return re.sub(r"_([a-z])", lambda m: m.group(1).upper(), name)


def to_snake(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "_" + m.group(0).lower(), name)


def camel_columns(df: DataFrame) -> DataFrame:
    """All columns renamed snake to camel."""
    return df.toDF(*[to_camel(c) for c in df.columns])


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[to_snake(c) for c in df.columns])


def with_defaults(df: DataFrame, table: str, run_ts: Column, user: Column | None = None) -> DataFrame:
    """Fill what an insert may leave out: state, zero quantities, times, audit columns; P13 applies too."""
    schema = SCHEMAS[table]
    filled = lowered(df, table)
    for name, value in DEFAULTS.get(table, {}).items():
        default = F.lit(value).cast(schema[name].dataType)
        filled = filled.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)
    if "is_deleted" in schema.names:
        filled = filled.withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)) if "is_deleted" in df.columns else F.lit(False))
    for name in TIMED:
        if name in schema.names:
            filled = filled.withColumn(name, F.coalesce(name, run_ts) if name in df.columns else run_ts)
    if user is not None and "created_by" in schema.names:
        filled = filled.withColumn("created_by", F.coalesce("created_by", user) if "created_by" in df.columns else user)
    return filled


def lowered(df: DataFrame, table: str) -> DataFrame:
    """The rows as they are written, with the columns that are kept in lower case turned so."""
    return df.withColumns({c: F.lower(c) for c in LOWERED.get(table, ()) if c in df.columns})


def completed(df: DataFrame, table: str) -> DataFrame:
    """The row with every column of ``table``; those it does not have are null."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in SCHEMAS[table] if f.name not in df.columns}
    return df.withColumns(missing).select(*SCHEMAS[table].names)


def touched(df: DataFrame, changed: Column, run_ts: Column) -> DataFrame:
    """Set ``updated_at`` on rows where ``changed`` holds."""
    old = F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp")
    return df.withColumn("updated_at", F.when(changed, run_ts).otherwise(old))
