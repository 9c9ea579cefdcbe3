"""Staged files: the size the optimizer is told, and when they are deleted."""

import gc
import os
import time

import pytest
from pyspark.sql import functions as F

from stockloom import session
from stockloom.plans.jobs import fulfil, picking
from stockloom.session import release, staged
from stockloom.sources.fixtures import with_text_ids
from stockloom.sources.tables import tables_from_rows
from tests import seed


@pytest.fixture
def low_limit(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_compress_well_are_not_broadcast(spark, low_limit):
    keys = staged(spark.range(100_000).select(F.concat(F.lit("order-"), F.col("id").cast("string")).alias("k"), F.lit("OPEN").alias("state")), "keys")
    files = keys.inputFiles()
    assert sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in files) < 300_000
    asked = spark.range(50_000).select(F.concat(F.lit("order-"), (F.col("id") * 3).cast("string")).alias("k"))
    for side in (keys, keys.filter("state = 'OPEN'"), keys.select("k").unionByName(keys.select("k"))):
        joined = asked.repartition(2).join(side.select("k"), "k", "left_semi")
        assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 33_334
    few = staged(spark.range(10).select(F.concat(F.lit("order-"), F.col("id").cast("string")).alias("k")), "few")
    assert "BroadcastHashJoin" in plan(asked.join(few, "k", "left_semi"))


def test_staged_files_go_with_their_last_reader(spark):
    def kept(path):
        for _ in range(3):
            gc.collect()
            time.sleep(0.3)
            release(spark, 0)
        return os.path.exists(path)

    first = staged(spark.range(1000).withColumn("k", F.col("id") % 10), "first")
    path = os.path.dirname(first.inputFiles()[0].removeprefix("file:").replace("///", "/"))
    reader = first.groupBy("k").count()
    del first
    assert kept(path) and reader.count() == 10
    del reader
    assert not kept(path) and not any(path.endswith(p.rpartition("/")[2]) for p in session._FOLDERS)


def test_pick_items_are_found_once(spark, run_ts, monkeypatch):
    written, write = [], picking.staged
    monkeypatch.setattr(picking, "staged", lambda df, label: written.append(label) or write(df, label))
    held = {"so_line_id": "11", "warehouse_id": "1", "product_id": "5", "qty_picked": 0, "status": "OPEN"}
    t = with_text_ids(tables_from_rows(spark, {
        "warehouse": [{"id": "1", "code": "W", "name": "W"}], "sales_order": [{"id": "1"}, {"id": "2"}],
        "sales_order_line": [{"id": "11", "sales_order_id": "1"}, {"id": "21", "sales_order_id": "2"}, {"id": "91", "sales_order_id": "9"}],
        "reservation": [{"id": "r1", **held, "qty_reserved": 3}, {"id": "r2", **held, "so_line_id": "21", "qty_reserved": 4}, {"id": "r9", **held, "so_line_id": "91", "qty_reserved": 4}],
    }))
    requests = spark.createDataFrame([("P1", "1", "1"), ("P2", "2", "1"), ("P9", "9", "1")], "id string, sales_order_id string, warehouse_id string")
    done = picking.create_picklists(t, requests, run_ts)
    assert written.count("pick-items") == 1
    items = done.inserts["pick_item"]
    assert "LeftSemi" not in plan(items)
    assert sorted((r["picklist_id"], r["reservation_id"]) for r in items.collect()) == [("P1", "r1"), ("P2", "r2")]  # P9 names an order that there is not


def test_spent_steps_of_an_order_are_gone_before_picking(spark, run_ts, monkeypatch):
    left, create = [], fulfil.create_picklists

    def picklists(*given):
        for _ in range(3):
            gc.collect()
            time.sleep(0.3)
            release(spark, 0)
        left.extend(p.rpartition("/")[2][:-33] for p in session._FOLDERS)
        return create(*given)

    monkeypatch.setattr(fulfil, "create_picklists", picklists)
    orders, lines = seed.make(spark, seed.ORDER_SCHEMA, [seed.order("o1", 1)]), seed.make(spark, seed.LINE_SCHEMA, [seed.line("l1", "o1", 10)])
    done = fulfil.fulfil_orders(seed.tables(spark), orders, lines, run_ts)
    assert done.outcome.count() == 1 and "sales-order" in left
    assert not {"entered-sales_order", "entered-sales_order_line", "wanted", "judged", "limits"} & set(left)
