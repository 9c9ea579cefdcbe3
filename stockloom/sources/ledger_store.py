"""The stock ledger on disk, by day, with closing balances.

Movements lie in parts of (posting batch, day). Closing a day stores the sum of every bucket over all
movements up to it that were posted so far. What is read afterwards is that snapshot, the days after it and
what was posted later into closed days; the rest is left out by its partition.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, LongType, StructField, StructType

from stockloom.functions.keys import bucket
from stockloom.model import BUCKET
from stockloom.operators.running import SLICE_ROWS, running_totals


class LedgerStore:
    """Rows of ``schema`` (at least id, ts, the bucket columns and qty_delta) under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._schema = StructType([StructField(f.name, f.dataType, True) for f in schema])
        self._sums = StructType([*[self._schema[c] for c in BUCKET], StructField("qty", DecimalType(38, 3)), StructField("n_movements", LongType())])
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def append(self, moves: DataFrame, batch_id: int) -> None:
        """Post ``moves`` as batch ``batch_id`` (0 or more, ascending). The same call again leaves the same result."""
        dated = moves.select(*self._schema.names).withColumn("day", F.to_date("ts"))
        dated.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self._folder}/moves/batch={batch_id}")

    def close(self, day: datetime.date) -> None:
        """Store the balances at the end of ``day``, with all that was posted so far. Movements without a time are never closed."""
        batches = self._complete("moves", "batch")
        if not batches:
            return
        closed, _ = self._snapshot()
        rows = self._rows(self._open(closed)).filter(F.col("day") <= F.lit(day))
        sums = self._summed(rows)
        if closed is not None:
            sums = self._merged(sums.unionByName(self._stored(closed)))
        sums.write.mode("overwrite").parquet(f"{self._folder}/closed/at={day.isoformat()}~{batches[-1]:012d}")

    def balances(self) -> DataFrame:
        """Per bucket: qty and n_movements over all movements."""
        closed, _ = self._snapshot()
        sums = self._summed(self.open_rows())
        return sums if closed is None else self._merged(sums.unionByName(self._stored(closed)))

    def open_rows(self) -> DataFrame:
        """The movements that the last closing balances do not hold."""
        return self._rows(self._open(self._snapshot()[0])).drop("batch", "day")

    def running(self, slice_rows: int = SLICE_ROWS) -> DataFrame:
        """V15 for the days after the last closed one (for all movements if none is): each row with the balance after it."""
        closed, day = self._snapshot()
        rows = self._rows(self._open(closed)).withColumn("bucket", bucket())
        totals = running_totals(rows, ["bucket"], ["ts", "id"], {"running_qty": F.col("qty_delta")}, slice_rows)
        if closed is None:
            return totals.drop("bucket", "batch", "day")
        start = self._stored(closed).select(bucket().alias("_bucket"), F.col("qty").alias("_start"))
        later = totals.filter(F.col("day") > F.lit(day)).join(start, F.col("bucket") == F.col("_bucket"), "left")
        raised = (F.col("running_qty") + F.coalesce("_start", F.lit(0))).cast("decimal(28,3)")
        return later.withColumn("running_qty", raised).drop("bucket", "batch", "day", "_bucket", "_start")

    def _rows(self, condition: Column) -> DataFrame:
        paths = [f"{self._folder}/moves/batch={b}" for b in self._complete("moves", "batch")]
        placed = StructType([*self._schema.fields, StructField("batch", LongType()), StructField("day", DateType())])
        if not paths:
            return self._spark.createDataFrame([], placed)
        return self._spark.read.schema(placed).option("basePath", f"{self._folder}/moves").parquet(*paths).filter(condition)

    def _open(self, closed: tuple[str, int] | None) -> Column:
        if closed is None:
            return F.lit(True)
        day, batch = closed
        return (F.col("day") > F.lit(day).cast("date")) | F.col("day").isNull() | (F.col("batch") > batch)

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*BUCKET).agg(F.sum("qty_delta").cast("decimal(38,3)").alias("qty"), F.count(F.lit(1)).alias("n_movements"))

    def _merged(self, sums: DataFrame) -> DataFrame:
        return sums.groupBy(*BUCKET).agg(F.sum("qty").cast("decimal(38,3)").alias("qty"), F.sum("n_movements").alias("n_movements"))

    def _snapshot(self) -> tuple[tuple[str, int] | None, datetime.date | None]:
        """Day and last batch of the newest closing balances."""
        found = sorted(n for n in self._names("closed") if n.startswith("at=") and self._exists(f"closed/{n}/_SUCCESS"))
        if not found:
            return None, None
        day, _, batch = found[-1][3:].partition("~")
        return (day, int(batch)), datetime.date.fromisoformat(day)

    def _stored(self, closed: tuple[str, int]) -> DataFrame:
        return self._spark.read.schema(self._sums).parquet(f"{self._folder}/closed/at={closed[0]}~{closed[1]:012d}")

    def _complete(self, part: str, column: str) -> list[int]:
        names = [n for n in self._names(part) if n.startswith(f"{column}=") and self._exists(f"{part}/{n}/_SUCCESS")]
        return sorted(int(n.partition("=")[2]) for n in names)

    def _names(self, part: str) -> list[str]:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{part}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _exists(self, part: str) -> bool:
        return self._fs.exists(self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{part}"))
