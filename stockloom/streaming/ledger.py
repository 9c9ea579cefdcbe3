"""The stock ledger as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from stockloom.functions.keys import bucket
from stockloom.model import BUCKET
from stockloom.plans.jobs.base import JobResult
from stockloom.operators.overdraft import BLOCK_ROWS, refused_withdrawals
from stockloom.operators.running import running_totals
from stockloom.plans.jobs.ledger import post_movements
from stockloom.session import staged
from stockloom.sources.tables import Tables
from stockloom.sources.keyed import PARTS, KeyedTable
from stockloom.streaming.batches import write_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Balance(StatefulProcessor):
    """Keeps the balance of one bucket; refuses what would take it below zero.

    The rows of one micro-batch are put in order; how many there can be is set at the source
    (``maxFilesPerTrigger`` or the like).
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._balance = handle.getValueState("balance", StructType([StructField("thousandths", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        balance = self._balance.get()[0] if self._balance.exists() else int(batch["opening"].iloc[0])
        accepted, balances = [], []
        for delta in batch["delta"].tolist():
            fits = balance + delta >= 0
            balance += delta if fits else 0
            accepted.append(fits)
            balances.append(balance)
        self._balance.update((balance,))
        yield pd.DataFrame({"id": batch["id"], "bucket": key[0], "delta": batch["delta"], "accepted": accepted, "balance": balances})

    def close(self) -> None:
        pass


def running_balances(moves: DataFrame, opening: DataFrame) -> DataFrame:
    """Each movement with the balance after it and whether it was accepted.

    ``moves``: a stream with id, ts, bucket columns, qty_delta. ``opening``: bucket columns and balance, the same
    whenever the stream is started again. The opening balance comes with the movements of its bucket, so state is
    kept, and the processor called, for buckets that move only.
    """
    if moves.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    id_type = dict(moves.dtypes)["id"]
    keyed = moves.select("id", "ts", F.to_json(bucket()).alias("bucket"), (F.col("qty_delta") * 1000).cast("bigint").alias("delta"))
    start = opening.groupBy(F.to_json(bucket()).alias("bucket")).agg(F.sum((F.col("balance") * 1000).cast("bigint")).alias("opening"))
    started = keyed.join(start, "bucket", "left").select("id", "ts", "bucket", "delta", F.coalesce("opening", F.lit(0).cast("bigint")).alias("opening"))
    tracked = started.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Balance(),
        outputStructType=f"id {id_type}, bucket string, delta bigint, accepted boolean, balance bigint",
        outputMode="Append",
        timeMode="None",
    )
    return tracked.select(
        "id", "bucket", (F.col("delta") / 1000).cast("decimal(18,3)").alias("qty_delta"), "accepted",
        (F.col("balance") / 1000).cast("decimal(18,3)").alias("running_qty"),
    )


def once_per_move_key(moves: DataFrame, delay: str) -> DataFrame:
    """R2: drop repeats of a move key that arrive within ``delay``, with state bounded by it.

    Rows that come later than ``delay`` are not in the result at all. Where none may be lost, use the
    ledger writer, which tests each key against all that is stored.
    """
    return moves.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["move_key"])


def balance_writer(opening: DataFrame, folder: str, parts: int = PARTS, block_rows: int = BLOCK_ROWS, compact_share: float = 0.5):
    """R1 for busy buckets: a ``foreachBatch`` function that notes for each movement the balance after it and whether it was accepted.

    ``opening``: bucket columns and balance. Movements: id, ts, bucket columns, qty_delta. The rows of one bucket
    in a micro-batch are spread over tasks in blocks of ``block_rows``, whatever their number; balances of the
    buckets at hand are read and written by key. Rows go to ``folder``/movements.
    """
    start = opening.groupBy(bucket().alias("bucket")).agg(F.sum("balance").cast("decimal(38,3)").alias("balance"))

    def note(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        moves = staged(batch.select("id", "ts", bucket().alias("bucket"), F.col("qty_delta").cast("decimal(38,3)").alias("delta")), "moves")
        table = KeyedTable(spark, f"{folder}/balances", start.schema, ["bucket"], parts=parts)
        known = table.lookup(moves, before=batch_id)
        first = start.join(moves.select("bucket"), "bucket", "left_semi").join(known.select("bucket"), "bucket", "left_anti")
        before = staged(known.unionByName(first), "balances-before")
        refused = refused_withdrawals(moves, before, ["ts", "id"], block_rows)
        judged = staged(moves.join(refused.withColumn("accepted", F.lit(False)), "id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(True))), "judged-moves")
        moved = F.when(F.col("accepted"), F.col("delta")).otherwise(F.lit(0)).cast("decimal(38,3)")
        totals = running_totals(judged, ["bucket"], ["ts", "id"], {"_moved": moved}, block_rows).join(before, "bucket", "left")
        balance = (F.coalesce("balance", F.lit(0)) + F.col("_moved")).cast("decimal(18,3)")
        write_batch(
            totals.select("id", "bucket.*", F.col("delta").cast("decimal(18,3)").alias("qty_delta"), "accepted", balance.alias("running_qty")),
            f"{folder}/movements", batch_id,
        )
        ends = judged.groupBy("bucket").agg(F.sum(moved).alias("_all")).join(before, "bucket", "left")
        table.put(ends.select("bucket", (F.coalesce("balance", F.lit(0)) + F.col("_all")).cast("decimal(38,3)").alias("balance")), batch_id)
        table.compact(compact_share)

    return note


def posted_table(spark: SparkSession, folder: str, like: DataFrame, parts: int = PARTS) -> KeyedTable:
    """Ledger rows the writer posted, found by their move key."""
    return KeyedTable(spark, f"{folder}/inventory_tx", like.schema, ["id"], by=["move_key"], parts=parts)


def stock_table(spark: SparkSession, folder: str, like: DataFrame, parts: int = PARTS) -> KeyedTable:
    """Stock rows the writer changed, found by their bucket."""
    return KeyedTable(spark, f"{folder}/inventory", like.schema, ["id"], by=list(BUCKET), parts=parts)


def ledger_writer(t: Tables, folder: str, run_ts: Column, parts: int = PARTS, compact_share: float = 0.5):
    """A ``foreachBatch`` function that posts each micro-batch by the rules of B8.

    Ledger rows, balances and rejects go to ``folder``. A batch that runs again gives the same result, and a
    move key stored in ``t`` or posted in any earlier batch is refused, however old it is. A batch reads and
    writes the stock of its buckets only, and looks for its move keys only.
    """
    ledger_shape = t["inventory_tx"]
    opening = t["inventory"] if "updated_at" in t["inventory"].columns else t["inventory"].withColumn("updated_at", F.lit(None).cast("timestamp"))

    def post(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = staged(batch, "movements")
        posted_rows = posted_table(spark, folder, ledger_shape, parts)
        stock_rows = stock_table(spark, folder, opening, parts)
        ledger = ledger_shape.unionByName(posted_rows.lookup(batch, before=batch_id))
        changed = stock_rows.lookup(batch, before=batch_id)
        touched = staged(batch.select(bucket().alias("_bucket")).distinct(), "touched-buckets")  # of a known size: few are broadcast, and the stock is not shuffled
        at_hand = opening.join(touched, bucket() == F.col("_bucket"), "left_semi")
        stock = staged(at_hand.join(changed.select("id"), "id", "left_anti").unionByName(changed), "stock")
        now: JobResult = post_movements(t.replacing(inventory_tx=ledger, inventory=stock), batch, run_ts)
        posted = now.inserts["inventory_tx"]
        posted = posted.withColumns({f.name: F.lit(None).cast(f.dataType) for f in ledger_shape.schema if f.name not in posted.columns})
        posted_rows.put(posted.select(*ledger_shape.columns), batch_id)
        write_batch(now.rejects, f"{folder}/rejects", batch_id)
        stock_rows.put(now.changes["inventory"].select(*opening.columns), batch_id)
        posted_rows.compact(compact_share)
        stock_rows.compact(compact_share)

    return post


def bucket_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """The bucket text of ``running_balances`` as its four columns again."""
    shape = StructType([like.schema[c] for c in BUCKET])
    return df.withColumn("_b", F.from_json("bucket", shape)).select(*[c for c in df.columns if c != "bucket"], "_b.*")
