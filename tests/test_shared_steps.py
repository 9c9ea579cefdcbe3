"""Steps that many jobs share: what they read again, and what state they keep."""

from decimal import Decimal

from pyspark.sql import functions as F

from checks.documents import nested_rows, stored_documents
from stockloom.plans.jobs import reserving
from stockloom.plans.jobs.base import first_of_each
from stockloom.sources.fixtures import derived_tables
from stockloom.streaming import ledger
from tests import seed

D = Decimal


def test_rows_without_a_repeated_key_pass_as_they_are(spark):
    shape = "id string, seq long, more string"
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z"), (None, 3, "z")], shape)
    firsts, others = first_of_each(rows, ["id"], ["seq"], "id")
    assert firsts is rows and others.count() == 0
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 2, "y"), ("b", 2, "y"), (None, 3, "z")], shape)
    firsts, others = first_of_each(rows, ["id"], ["seq"], "id")
    assert sorted(map(tuple, firsts.collect()), key=str) == [("a", 1, "y"), ("b", 2, "y"), (None, 3, "z")]
    assert sorted(r["id"] for r in others.collect()) == ["a", "b"]


def test_demands_do_not_look_for_known_ids_again(spark, run_ts, monkeypatch):
    seen, admit = [], reserving.admit
    monkeypatch.setattr(reserving, "admit", lambda demands, *more: seen.append(demands.inputFiles()) or admit(demands, *more))
    line = dict(id="l1", sales_order_id="so", line_no=1, product_id=seed.GADGET, uom_id=seed.UNIT, qty_ordered=D(5), price_per_uom=D(1))
    t = seed.tables(spark, sales_order_line=[line])
    shape = "id string, seq long, so_line_id string, warehouse_id string, bin_id string, product_id string, lot_id string, qty_reserved decimal(18,3)"
    asked = spark.createDataFrame([("new", 1, "l1", seed.WAREHOUSE, seed.BIN, seed.GADGET, None, D(1))], shape)
    done = reserving.reserve_stock(t, asked, run_ts)
    assert done.inserts["reservation"].count() == 1 and done.rejects.count() == 0
    assert any("/known-" in f for f in seen[0])


def test_state_is_kept_for_buckets_that_move(spark, tmp_path):
    shape = "warehouse_id string, bin_id string, product_id string, lot_id string"
    opening = spark.createDataFrame([("w", None, f"p{k}", None, D(10)) for k in range(5)] + [("w", None, "p0", None, D(1))], f"{shape}, balance decimal(18,3)")
    moves = [("m1", "2024-01-01 00:00:00", "w", None, "p0", None, D(-11)), ("m2", "2024-01-01 00:00:01", "w", None, "p0", None, D(-1)), ("m3", "2024-01-01 00:00:00", "w", "b", "p1", None, D(2))]
    later = [("m4", "2024-01-02 00:00:00", "w", None, "p0", None, D(5)), ("m5", "2024-01-02 00:00:00", "w", "b", "p1", None, D(-2)), ("m6", "2024-01-02 00:00:00", "w", None, "p2", None, D(-11))]
    source, out, progress = (str(tmp_path / name) for name in ("source", "out", "progress"))
    for part in (moves, later):
        rows = spark.createDataFrame(part, f"id string, ts string, {shape}, qty_delta decimal(18,3)")
        rows.write.mode("append").parquet(source)
        stream = ledger.running_balances(spark.readStream.schema(rows.schema).parquet(source), opening)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = {r["id"]: (r["accepted"], r["running_qty"]) for r in spark.read.parquet(out).collect()}
    assert got == {"m1": (True, D(0)), "m2": (False, D(0)), "m3": (True, D(2)), "m4": (True, D(5)), "m5": (True, D(0)), "m6": (False, D(10))}
    assert spark.read.format("statestore").option("stateVarName", "balance").load(progress).count() == 3


def test_nested_rows_read_each_document_once(spark):
    stored = stored_documents(derived_tables(spark, "/root/testdata/sf0.001"))
    rows = nested_rows(stored)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(rows).count("Relation [") == plan(stored).count("Relation [")
    assert {r["kind"] for r in rows.select("kind").distinct().collect()} == {"header", "line", "reservation", "pick", "shipped"}
    bare = stored.withColumns({c: F.lit(None).cast(stored.schema[c].dataType) for c in ("lines", "reservations", "picklist", "shipment")})
    assert nested_rows(bare).count() == stored.count()  # no children leave the header
