"""Per-customer counters of fulfilled orders, kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.plans.metrics import SHIPPED
from stockloom.session import staged
from stockloom.sources.keyed import PARTS, KeyedTable


def counter_table(spark: SparkSession, folder: str, customer_type: str, parts: int = PARTS) -> KeyedTable:
    """The stored counters, by customer."""
    shape = spark.createDataFrame([], f"customer_id {customer_type}, orders_count bigint, total_qty decimal(28,3)").schema
    return KeyedTable(spark, f"{folder}/counters", shape, ["customer_id"], parts=parts)


def state_table(spark: SparkSession, folder: str, order_type: str, parts: int = PARTS) -> KeyedTable:
    """The last state of every order counted, by order."""
    shape = spark.createDataFrame([], f"order_id {order_type}, status string").schema
    return KeyedTable(spark, f"{folder}/orders", shape, ["order_id"], parts=parts)


def counter_writer(folder: str, parts: int = PARTS, compact_share: float = 0.5):
    """A ``foreachBatch`` function over events with order_id, customer_id, total_qty.

    An order counts once, also when its event is delivered again in a later batch, however late. A batch
    reads and writes the counters of its customers and the states of its orders only.
    """

    def update(batch: DataFrame, batch_id: int) -> None:
        spark, types = batch.sparkSession, dict(batch.dtypes)
        counters = counter_table(spark, folder, types["customer_id"], parts)
        states = state_table(spark, folder, types["order_id"], parts)
        batch = staged(batch.select("order_id", "customer_id", "total_qty"), "events")
        seen = states.lookup(batch, before=batch_id)
        once = batch.groupBy("order_id").agg(F.min(F.struct("customer_id", "total_qty")).alias("_event")).select("order_id", "_event.*")
        fresh = staged(once.join(seen.select("order_id"), "order_id", "left_anti"), "fresh-events")
        added = fresh.groupBy("customer_id").agg(F.count("*").alias("orders_count"), F.sum("total_qty").cast("decimal(28,3)").alias("total_qty"))
        total = counters.lookup(fresh, before=batch_id).unionByName(added).groupBy("customer_id").agg(
            F.sum("orders_count").alias("orders_count"), F.sum("total_qty").cast("decimal(28,3)").alias("total_qty")
        )
        counters.put(total, batch_id)
        states.put(fresh.select("order_id", F.lit(SHIPPED).alias("status")), batch_id)
        counters.compact(compact_share)
        states.compact(compact_share)

    return update


def live_counters(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same counters as one streaming aggregate, for an update-mode sink.

    ``events`` also has ``ts``. State is bounded by ``delay``, at a price: an event later than that is not
    counted at all. Where none may be lost, use ``counter_writer``, which is exact however late an event is.
    """
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["order_id"])
    return once.groupBy("customer_id").agg(F.count("*").alias("orders_count"), F.sum("total_qty").alias("total_qty"))
