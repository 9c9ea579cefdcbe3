"""What a job returns and the steps all jobs share."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.model import SCHEMAS
from stockloom.plans.quality import with_class
from stockloom.session import staged
from stockloom.sources.tables import Tables
from stockloom.sources.writers import apply_changes


@dataclass(frozen=True)
class JobResult:
    """``inserts``: rows to append per table. ``changes``: full rows to put in place by id, new ids
    included. ``rejects``: request_id, reject_code, reject_class."""

    rejects: DataFrame
    inserts: Mapping[str, DataFrame] = field(default_factory=dict)
    changes: Mapping[str, DataFrame] = field(default_factory=dict)

    def signed(self, t: Tables, user: Column) -> JobResult:
        """The same result with the user who ran the job: ``created_by`` of new rows that name nobody, ``updated_by`` of changed ones.

        ``changes`` may hold new rows (stock of a bucket that had none); those that ``t`` lacks count as new.
        """
        inserts = {}
        for table, rows in self.inserts.items():
            if "created_by" in SCHEMAS[table].names:
                rows = rows.withColumn("created_by", F.coalesce("created_by", user) if "created_by" in rows.columns else user)
            inserts[table] = rows
        changes = {}
        for table, rows in self.changes.items():
            if "updated_by" in SCHEMAS[table].names:
                known = t[table].select(F.col("id").cast("string").alias("_known"))
                known = known.join(rows.select(F.col("id").cast("string").alias("_known")), "_known", "left_semi").distinct()
                rows = rows.join(known, F.col("id").cast("string") == F.col("_known"), "left")
                old = F.col("_known").isNotNull()
                before = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("created_by", "updated_by")}
                rows = rows.withColumns({
                    "created_by": F.when(old, before["created_by"]).otherwise(F.coalesce(before["created_by"], user)),
                    "updated_by": F.when(old, user).otherwise(before["updated_by"]),
                }).drop("_known")
            changes[table] = rows
        return JobResult(self.rejects, inserts, changes)

    def applied(self, t: Tables) -> Tables:
        """The tables as they stand after the job."""
        changed = {table: apply_changes(t[table], rows) for table, rows in self.changes.items()}
        for table, rows in self.inserts.items():
            changed[table] = changed.get(table, t[table]).unionByName(rows, allowMissingColumns=True)
        return t.replacing(**changed)


def staged_result(result: JobResult, label: str) -> JobResult:
    """The result written out, so that what builds on it does not plan or compute it again."""
    return JobResult(
        staged(result.rejects, f"{label}-rejects"),
        {table: staged(rows, f"{label}-{table}") for table, rows in result.inserts.items()},
        {table: staged(rows, f"{label}-{table}") for table, rows in result.changes.items()},
    )


def classified(df: DataFrame, request: str, code: Column) -> tuple[DataFrame, DataFrame]:
    """Split on ``code``: rows where it is null go on; the others become rejects.

    The judged rows are written once, as both halves and all later steps start from them.
    """
    marked = staged(df.withColumn("_code", code), "judged")
    rejects = marked.filter(F.col("_code").isNotNull()).select(F.col(request).cast("string").alias("request_id"), F.col("_code").alias("reject_code"))
    return marked.filter(F.col("_code").isNull()).drop("_code"), rejects


def rejected(df: DataFrame, request: str, code: str) -> DataFrame:
    return df.select(F.col(request).cast("string").alias("request_id"), F.lit(code).alias("reject_code"))


def gathered(*parts: DataFrame) -> DataFrame:
    """All rejects with their class, one row per request."""
    every = reduce(DataFrame.unionByName, parts)
    return with_class(every.groupBy("request_id").agg(F.min("reject_code").alias("reject_code")))


def without(df: DataFrame, request: str, rejects: DataFrame) -> DataFrame:
    """Rows of ``df`` whose request is not among ``rejects``."""
    ids = rejects.select(F.col("request_id").alias("_rejected")).distinct()
    return df.join(ids, F.col(request).cast("string") == F.col("_rejected"), "left_anti")


def already_stored(stored: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``key`` in ``rows`` that ``stored`` holds too.

    The stored table is the large side: it is filtered by the keys at hand, which are broadcast
    while they are few, so it is not shuffled for a small batch.
    """
    return stored.select(key).join(rows.select(key), key, "left_semi").distinct()


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str], request: str) -> tuple[DataFrame, DataFrame]:
    """The rows that take their key first, and the ``request`` of every other row; null keys are exempt.

    Only keys are shuffled to see whether any repeats; if none does, the rows pass as they are (``df`` should be cheap
    to read again). Else firsts are found by an aggregate over whole rows, so a key repeated very often costs no more;
    only rows of repeated keys are looked at again. The others are told by occurrence: a row that repeats the first in every column is one of them, while
    the first itself stays. ``request`` alone must therefore not be used to take the others away.
    """
    place = list(dict.fromkeys([*order, request, *df.columns]))
    keyed = df.dropna(subset=list(keys))
    if keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").isEmpty():
        return df, df.select(request).limit(0)
    grouped = keyed.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min(F.struct(*place)).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    grouped = staged(grouped, "firsts")
    firsts = grouped.select("_first.*").select(*df.columns)
    unkeyed = df.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))
    repeated = grouped.filter("_rows > 1")
    again = keyed.join(repeated.select(*[f"_key_{k}" for k in keys]), [F.col(k) == F.col(f"_key_{k}") for k in keys], "left_semi")
    return firsts.unionByName(unkeyed), again.select(request).exceptAll(repeated.select(F.col(f"_first.{request}").alias(request)))


def stamped(df: DataFrame, run_ts: Column, **values: Column) -> DataFrame:
    """Changed rows: new values and the time of the change."""
    return df.withColumns({**values, "updated_at": run_ts})
