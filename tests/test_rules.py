"""Rules that are easy to get wrong, one test each."""

import datetime
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from stockloom.operators.hierarchy import explode_graph, tree_paths
from stockloom.plans import quality, search, views
from stockloom.plans.documents import document_picklists, document_shipments, order_fulfillment_doc
from stockloom.plans.jobs import intake, ledger, picking, reserving, shipping
from stockloom.sources import tables as tb
from stockloom.sources import writers
from tests import seed

D = Decimal
MADE = {"created_at": seed.NOW}


def order_row(key, status="APPROVED", **more):
    return dict(id=key, customer_id=seed.CUSTOMER, status=status, order_date=seed.DAY, currency="USD", **MADE, **more)


def line_row(key, order="o1", qty=10, product=seed.WIDGET, uom=seed.UNIT, **more):
    return dict(id=key, sales_order_id=order, line_no=1, product_id=product, uom_id=uom, qty_ordered=D(qty), price_per_uom=D(1), **MADE, **more)


def held_row(key, line, qty, picked=0, status="OPEN", bin_id=seed.BIN, lot_id=seed.LOT, product=seed.WIDGET, **more):
    return dict(id=key, so_line_id=line, warehouse_id=seed.WAREHOUSE, bin_id=bin_id, product_id=product, lot_id=lot_id, qty_reserved=D(qty),
                qty_picked=D(picked), status=status, **{**MADE, **more})


def test_empty_lines_give_zero_and_picked_lines_reopen(spark):
    t = seed.tables(spark, sales_order=[order_row("o1")], sales_order_line=[line_row("l1"), line_row("l2")],
                    reservation=[held_row("r1", "l1", 10, 10, "PICKED")])
    totals = {r["so_line_id"]: (r["qty_reserved_open"], r["qty_picked_total"]) for r in views.so_line_reservations(t).collect()}
    assert totals == {"l1": (0, 10), "l2": (0, 0)}
    assert {r["id"] for r in views.so_line_open(t).collect()} == {"l1", "l2"}


def test_undated_shipment_is_latest_and_no_children_is_null(spark):
    t = seed.tables(
        spark, sales_order=[order_row("o1")],
        shipment=[
            dict(id="s1", sales_order_id="o1", warehouse_id=seed.WAREHOUSE, ship_date=seed.DAY, **MADE),
            dict(id="s0", sales_order_id="o1", warehouse_id=seed.WAREHOUSE, ship_date=None, **MADE),
        ],
    )
    assert document_shipments(t).first()["shipment_id"] == "s0"
    doc = order_fulfillment_doc(t).first()
    assert doc["lines"] is None and doc["reservations"] is None and doc["picklist"] is None and doc["shipment"]["items"] is None
    assert doc["warehouse_code"] == "WH-MAIN"


def test_deleted_chosen_picklist_gives_none(spark):
    item = dict(bin_id=None, product_id=seed.WIDGET, lot_id=None, qty_to_pick=D(1), qty_picked=D(0), status="OPEN", **MADE)
    t = seed.tables(
        spark, sales_order=[order_row("o1")], sales_order_line=[line_row("l1")], reservation=[held_row("r1", "l1", 5)],
        picklist=[dict(id="p1", warehouse_id=seed.WAREHOUSE, status="OPEN", is_deleted=True, **MADE), dict(id="p2", warehouse_id=seed.WAREHOUSE, status="OPEN", **MADE)],
        pick_item=[dict(id="i1", picklist_id="p1", reservation_id="r1", **item), dict(id="i2", picklist_id="p2", reservation_id="r1", **item)],
    )
    assert document_picklists(t).count() == 0
    assert order_fulfillment_doc(t).first()["picklist"] is None


def test_cycles_end(spark):
    edges = spark.createDataFrame(
        [("b1", "p", "p", D(2)), ("b1", "p", "q", D(3)), ("b2", "q", "p", D(5)), ("b2", "q", "z", D(1))], "root string, parent string, child string, qty decimal(18,6)"
    )
    got = sorted((r["root"], r["child"], r["level"], float(r["qty"])) for r in explode_graph(edges).collect())
    # The self-loop is listed once at level 1 and expanded to what is not on its path.
    assert got == [
        ("b1", "p", 1, 2.0), ("b1", "q", 1, 3.0), ("b1", "q", 2, 6.0), ("b1", "z", 2, 3.0), ("b1", "z", 3, 6.0),
        ("b2", "p", 1, 5.0), ("b2", "z", 1, 1.0),
    ]
    nodes = spark.createDataFrame([("a", "A", "A", None), ("b", "B", "B", "a"), ("c", "C", "C", "gone")], "id string, code string, name string, parent_id string")
    assert {r["path_code"] for r in tree_paths(nodes).collect()} == {"A", "A/B"}


def test_quantities_of_long_paths_pass_twelve_digits(spark):
    edges = spark.createDataFrame([("r", k, k + 1, Decimal("3.000001")) for k in range(1, 31)], "root string, parent long, child long, qty decimal(18,6)")
    deepest = explode_graph(edges).orderBy(F.desc("level")).first()
    wanted = Decimal(1)
    for _ in range(30):
        wanted = (wanted * Decimal("3.000001")).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    assert (deepest["level"], deepest["child"], deepest["qty"]) == (30, 31, wanted) and wanted > 10**14


def test_three_way_filter(spark):
    t = seed.tables(spark)
    assert views.inventory_available(t, product_id=seed.GADGET).count() == 1
    assert views.inventory_available(t, lot_id=None).first()["product_id"] == seed.GADGET
    assert views.inventory_available(t, lot_id=seed.LOT).first()["product_id"] == seed.WIDGET


RESERVE = "id string, seq bigint, so_line_id string, warehouse_id string, bin_id string, product_id string, lot_id string, qty_reserved decimal(18,3)"


def test_reservation_codes(spark, run_ts):
    t = seed.tables(
        spark, sales_order=[order_row("o1")],
        sales_order_line=[line_row("l1", qty=10), line_row("l2", qty=5000), line_row("l3", qty=2, uom="unit-box"), line_row("l4", is_deleted=True)],
    )
    wh = (seed.WAREHOUSE, seed.BIN, seed.WIDGET, seed.LOT)
    asked = [
        ("a", 1, "l1", *wh, D(4)), ("b", 2, "l1", *wh, D(4)), ("c", 3, "l2", *wh, D(2000)), ("d", 4, "l3", *wh, D(3)), ("e", 5, "l3", *wh, D(2)),
        ("f", 6, "l4", *wh, D(1)), ("g", 7, "l2", seed.WAREHOUSE, seed.BIN, seed.GADGET, None, D(1)), ("h", 8, "l2", *wh, D(-1)),
    ]
    done = reserving.reserve_stock(t, seed.make(spark, RESERVE, asked), run_ts)
    assert {r["request_id"]: r["reject_code"] for r in done.rejects.collect()} == {
        "b": "UNIQUE_VIOLATION", "c": "INSUFFICIENT_AVAILABLE", "d": "EXCEEDS_ORDERED", "f": "NOT_FOUND", "g": "PRODUCT_MISMATCH", "h": "INVALID_QTY",
    }
    assert {r["id"]: r["qty_reserved"] for r in done.inserts["reservation"].collect()} == {"a": 4, "e": 24}


MOVES = (
    "id string, ts timestamp, warehouse_id string, bin_id string, product_id string, lot_id string, qty_delta decimal(18,3), reason string, "
    "ref_type string, ref_id string, move_key string"
)


def move(key, hour, delta, product=seed.GADGET, lot=None, mk=None):
    return (key, seed.NOW + datetime.timedelta(hours=hour), seed.WAREHOUSE, seed.BIN, product, lot, D(delta), "ADJUST_NEG", "T", key, mk or f"K:{key}")


def test_posting(spark, run_ts):
    t = seed.tables(spark, inventory_tx=[dict(id="old", ts=seed.NOW, warehouse_id=seed.WAREHOUSE, product_id=seed.GADGET, qty_delta=D(1), reason="RECEIVE", move_key="K:known")])
    moves = [move("a", 1, -400), move("b", 2, -200), move("c", 3, -100), move("d", 4, 0), move("e", 5, 1, mk="K:known"), move("f", 6, 1, mk="K:c"),
             move("g", 7, 5, product=seed.WIDGET), move("h", 8, 1, product="none")]
    done = ledger.post_movements(t, seed.make(spark, MOVES, moves), run_ts)
    assert {r["request_id"]: (r["reject_code"], r["reject_class"]) for r in done.rejects.collect()} == {
        "b": ("INSUFFICIENT_STOCK", "InsufficientStock"), "d": ("CHECK_VIOLATION", "Validation"), "e": ("UNIQUE_VIOLATION", "Conflict"),
        "f": ("UNIQUE_VIOLATION", "Conflict"), "h": ("FOREIGN_KEY_VIOLATION", "NotFound"),
    }
    after = done.applied(t)
    stock = {(r["product_id"], r["lot_id"]): r["qty_on_hand"] for r in after["inventory"].collect()}
    assert stock == {(seed.WIDGET, seed.LOT): 1000, (seed.GADGET, None): 0, (seed.WIDGET, None): 5}
    again = ledger.post_movements(after, seed.make(spark, MOVES, moves[:1]), run_ts)
    assert again.rejects.first()["reject_code"] == "UNIQUE_VIOLATION" and again.changes["inventory"].count() == 0


CONFIRM = "id string, seq bigint, ts timestamp, pick_item_id string, qty decimal(18,3)"


def test_one_confirmation_per_item_and_autoclose(spark, run_ts):
    item = dict(bin_id=seed.BIN, product_id=seed.WIDGET, lot_id=seed.LOT, qty_picked=D(0), status="OPEN", **MADE)
    t = seed.tables(
        spark, sales_order=[order_row("o1")], sales_order_line=[line_row("l1", qty=20)], reservation=[held_row("r1", "l1", 10), held_row("r2", "l1", 5, bin_id=None)],
        picklist=[dict(id="p1", warehouse_id=seed.WAREHOUSE, status="OPEN", **MADE)],
        pick_item=[dict(id="i1", picklist_id="p1", reservation_id="r1", qty_to_pick=D(10), **item), dict(id="i2", picklist_id="p1", reservation_id="r2", qty_to_pick=D(5), **item)],
    )
    asked = [("a", 1, seed.NOW, "i1", D(4)), ("b", 2, seed.NOW, "i1", D(6)), ("c", 3, seed.NOW, "i2", D(9)), ("d", 4, seed.NOW, "none", D(1))]
    done = picking.confirm_picks(t, seed.make(spark, CONFIRM, asked), run_ts)
    assert {r["request_id"]: r["reject_code"] for r in done.rejects.collect()} == {"b": "UNIQUE_VIOLATION", "c": "INVALID_QTY", "d": "NOT_FOUND"}
    assert done.changes["picklist"].count() == 0
    full = picking.confirm_picks(t, seed.make(spark, CONFIRM, [("a", 1, seed.NOW, "i1", D(10)), ("c", 2, seed.NOW, "i2", D(5))]), run_ts)
    assert full.changes["picklist"].first()["status"] == "CLOSED"
    assert {r["id"]: r["status"] for r in full.changes["reservation"].collect()} == {"r1": "PICKED", "r2": "PICKED"}


def test_shipping_scopes(spark, run_ts):
    item = dict(bin_id=seed.BIN, product_id=seed.WIDGET, lot_id=seed.LOT, qty_to_pick=D(10), qty_picked=D(10), status="PICKED", **MADE)
    t = seed.tables(
        spark, sales_order=[order_row("o1"), order_row("o2", status="CANCELLED")], sales_order_line=[line_row("l1"), line_row("l2", order="o2")],
        reservation=[held_row("r1", "l1", 10, 10, "PICKED"), held_row("r2", "l2", 10, 10, "PICKED")],
        picklist=[dict(id="p1", warehouse_id=seed.WAREHOUSE, status="CLOSED", **MADE)],
        pick_item=[dict(id="i1", picklist_id="p1", reservation_id="r1", **item), dict(id="i2", picklist_id="p1", reservation_id="r2", **item)],
        shipment=[dict(id="s1", sales_order_id="o1", warehouse_id=seed.WAREHOUSE, **MADE)],
    )
    asked = seed.make(spark, "shipment_id string", [("s1",), ("gone",)])
    own = shipping.ship_picks(t, asked, run_ts)
    assert own.inserts["shipment_item"].count() == 1 and own.changes["sales_order"].first()["status"] == "SHIPPED"
    assert own.rejects.first()["reject_code"] == "NOT_FOUND"
    assert shipping.ship_picks(t, asked, run_ts, scope="warehouse").inserts["shipment_item"].count() == 2


def test_approval_and_line_numbers(spark, run_ts):
    t = seed.tables(spark, sales_order=[order_row("o1", "DRAFT"), order_row("o2", "DRAFT", is_deleted=True), order_row("o3")],
                    sales_order_line=[{**line_row("l1", is_deleted=True), "line_no": 4}])
    keys = seed.make(spark, "id string", [("o1",), ("o2",), ("o3",)])
    assert [r["id"] for r in intake.approve(t, "sales_order", keys, run_ts).changes["sales_order"].collect()] == ["o1"]
    lines = seed.make(spark, seed.LINE_SCHEMA, [seed.line("n1", "o1", 1, seq=2), seed.line("n2", "o1", 1, seq=1), seed.line("n3", "o3", 1)])
    numbered = intake.add_numbered_lines(t, "sales_order_line", lines, run_ts, slice_rows=1).inserts["sales_order_line"]
    assert {r["id"]: r["line_no"] for r in numbered.collect()} == {"n2": 5, "n1": 6, "n3": 1}


def test_planted_faults_are_found(spark):
    t = seed.tables(
        spark,
        address=[dict(id="a1", country_code="USA")],
        customer=[dict(id="c9", name=None, address_id="none", **MADE)],
        product=[dict(id="x", sku="WGT-001", name="Copy", base_uom_id=seed.UNIT, **MADE), dict(id="y", sku="GDG-001", name="Old", base_uom_id=seed.UNIT, is_deleted=True, **MADE)],
        inventory=[dict(id="stock-3", warehouse_id=seed.WAREHOUSE, bin_id=seed.BIN, product_id=seed.GADGET, lot_id=None, qty_on_hand=D(1), **MADE)],
        sales_order=[order_row("o1", status="LOST")],
    )
    found = {(r["table_name"], r["rule"]) for r in quality.all_violations(t, ["address", "customer", "product", "inventory", "sales_order"]).collect()}
    assert found == {
        ("address", "length:country_code"), ("customer", "not_null:name"), ("customer", "foreign_key:address_id"), ("product", "unique_live:sku"),
        ("inventory", "unique:warehouse_id+bin_id+product_id+lot_id"), ("sales_order", "allowed:status"),
    }


def test_purge_takes_owned_lines(spark):
    t = seed.tables(spark, sales_order=[order_row("o1", created_by="u1"), order_row("o2", created_by="u2")],
                    sales_order_line=[line_row("l1"), line_row("l2", order="o2")])
    left = writers.purge(t, {"sales_order": F.col("created_by") == "u1"})
    assert [r["id"] for r in left["sales_order"].collect()] == ["o2"] and [r["id"] for r in left["sales_order_line"].collect()] == ["l2"]


def test_upsert_keeps_other_columns(spark):
    stored = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(writers.upsert_rows(stored, new, ["k"]).collect()) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]


def test_names_and_search(spark):
    assert tb.to_camel("qty_on_hand") == "qtyOnHand" and tb.to_snake("qtyOnHand") == "qty_on_hand" and tb.to_camel("line_1") == "line_1"
    t = seed.tables(spark, customer=[dict(id="c2", name="Café Ölhaus", **MADE)])
    queries = spark.createDataFrame([(1, "super WIDGET"), (2, "cafe olhaus"), (3, "super gadget")], "query_id int, query string")
    hits = {(r["query_id"], r["entity_id"]) for r in search.token_search(views.search_catalog(t), queries).collect()}
    assert hits == {(1, seed.WIDGET), (2, "c2")}
    names = t["product"].select("id", "name")
    close = search.similar_names(names, spark.createDataFrame([(1, "supr widget")], "query_id int, query string"), 0.5)
    assert [r["id"] for r in close.collect()] == [seed.WIDGET]
