"""Per-customer counters of fulfilled orders (A8) and order totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.sources.tables import Tables, active

SHIPPED = "SHIPPED"  # fixed value: the state recorded for every fulfilled order


def order_totals(t: Tables) -> DataFrame:
    """Total ordered quantity per order."""
    return active(t["sales_order_line"]).groupBy("sales_order_id").agg(F.sum("qty_ordered").alias("total_qty"))


def fulfilled_orders(t: Tables) -> DataFrame:
    """One event per shipped order: order_id, customer_id, total_qty."""
    orders = active(t["sales_order"]).filter(F.col("status") == SHIPPED).select(F.col("id").alias("sales_order_id"), "customer_id")
    return orders.join(order_totals(t), "sales_order_id", "left").select(
        F.col("sales_order_id").alias("order_id"), "customer_id", F.coalesce("total_qty", F.lit(0)).alias("total_qty")
    )


def customer_counters(events: DataFrame) -> DataFrame:
    """Number of fulfilled orders and their quantity per customer. An order counts once."""
    once = events.groupBy("order_id").agg(F.min(F.struct("customer_id", "total_qty")).alias("_event")).select("order_id", "_event.*")
    return once.groupBy("customer_id").agg(F.count("*").alias("orders_count"), F.sum("total_qty").alias("total_qty"))


def customer_metrics(counters: DataFrame, customers: DataFrame) -> DataFrame:
    """Counters of the given customers; zero where nothing was counted."""
    return customers.select("customer_id").join(counters, "customer_id", "left").select(
        "customer_id", F.coalesce("orders_count", F.lit(0)).alias("orders_count"), F.coalesce("total_qty", F.lit(0)).alias("total_qty")
    )


def order_states(events: DataFrame) -> DataFrame:
    """The last state of every fulfilled order."""
    return events.select("order_id").distinct().withColumn("status", F.lit(SHIPPED))


def state_of_orders(states: DataFrame, orders: DataFrame) -> DataFrame:
    """The state of each of the given orders (order_id); null for one that was not counted."""
    return orders.select("order_id").join(states, "order_id", "left").select("order_id", "status")
