"""The named queries V1-V18. Each takes the tables and returns a lazily planned DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.keys import bucket
from stockloom.functions.predicates import (
    ANY, PO_OPEN, RESERVATION_HOLDING, SO_OPEN, TRANSFER_OPEN, all_same, effective_on, in_status, remainder, where_given,
)
from stockloom.functions.text import search_tokens
from stockloom.model import BUCKET
from stockloom.operators.hierarchy import explode_graph, tree_paths
from stockloom.operators.lookup import columns_of
from stockloom.operators.closure import within
from stockloom.operators.running import SLICE_ROWS, running_totals
from stockloom.sources.tables import Tables, active, where_in_keys


def _product(t: Tables, key: str = "product_id") -> DataFrame:
    return columns_of(t["product"], key, product_sku="sku", product_name="name")


def _lot(t: Tables) -> DataFrame:
    return columns_of(t["lot"], "lot_id", lot_code="lot_code")


def _bin(t: Tables) -> DataFrame:
    return columns_of(t["warehouse_bin"], "bin_id", bin_code="code")


def _unit(t: Tables, key: str = "uom_id", into: str = "uom_code") -> DataFrame:
    return columns_of(t["unit_of_measure"], key, live=False, **{into: "code"})


def product(t: Tables) -> DataFrame:
    """V1: active products with category name and base unit code."""
    return (
        active(t["product"])
        .join(columns_of(t["product_category"], "category_id", category_name="name"), "category_id", "left")
        .join(_unit(t, "base_uom_id", "base_uom_code"), "base_uom_id", "left")
        .select("id", "sku", "name", "category_id", "category_name", "base_uom_id", "base_uom_code")
    )


def category_path(t: Tables) -> DataFrame:
    """V2: category tree with paths and depth; a deleted node hides what is below it."""
    return tree_paths(active(t["product_category"]).select("id", "code", "name", "parent_id"))


def lot(t: Tables) -> DataFrame:
    """V3: active lots of active products."""
    return (
        active(t["lot"])
        .join(_product(t), "product_id")
        .select("id", "product_id", "product_sku", "product_name", "lot_code", "expiry_date", "status_id")
    )


def inventory_bucket(t: Tables) -> DataFrame:
    """V4: stock rows with the codes of their dimensions."""
    return (
        active(t["inventory"])
        .join(columns_of(t["warehouse"], "warehouse_id", warehouse_code="code"), "warehouse_id")
        .join(_bin(t), "bin_id", "left")
        .join(_product(t), "product_id")
        .join(_lot(t), "lot_id", "left")
        .select(
            "id", "warehouse_id", "warehouse_code", "bin_id", "bin_code", "product_id", "product_sku", "product_name",
            "lot_id", "lot_code", "qty_on_hand",
        )
    )


def reservation_open(t: Tables) -> DataFrame:
    """V5: quantity still reserved per bucket."""
    return (
        active(t["reservation"])
        .filter(in_status("status", RESERVATION_HOLDING))
        .groupBy(*BUCKET)
        .agg(F.sum(F.col("qty_reserved") - F.col("qty_picked")).alias("qty_reserved_open"))
    )


def inventory_available(t: Tables, warehouse_id=ANY, product_id=ANY, bin_id=ANY, lot_id=ANY) -> DataFrame:
    """V6: stock on hand less what is reserved. The filters follow the rules of ``where_given``."""
    given = {"warehouse_id": warehouse_id, "product_id": product_id, "bin_id": bin_id, "lot_id": lot_id}
    stock = where_given(inventory_bucket(t), **given).alias("stock")
    held = where_given(reservation_open(t), **given).alias("held")
    return stock.join(held, all_same("stock", "held", BUCKET), "left").select(
        *[f"stock.{c}" for c in (
            "warehouse_id", "warehouse_code", "bin_id", "bin_code", "product_id", "product_sku", "product_name", "lot_id", "lot_code", "qty_on_hand",
        )],
        remainder(F.col("qty_on_hand"), F.coalesce("qty_reserved_open", F.lit(0))).alias("qty_available"),
    )


def _open_purchase_orders(t: Tables) -> DataFrame:
    return active(t["purchase_order"]).filter(in_status("status", PO_OPEN))


def _outstanding() -> Column:
    return remainder(F.col("qty_ordered"), F.col("qty_received"))


def po_line_open(t: Tables) -> DataFrame:
    """V7: purchase lines with something left to receive."""
    orders = columns_of(
        _open_purchase_orders(t), "purchase_order_id",
        po_number="po_number", supplier_id="supplier_id", po_status="status", order_date="order_date", expected_date="expected_date",
    )
    return (
        active(t["purchase_order_line"])
        .withColumn("qty_outstanding", _outstanding())
        .filter(F.col("qty_outstanding") > 0)
        .join(orders, "purchase_order_id")
        .join(columns_of(t["supplier"], "supplier_id", supplier_name="name"), "supplier_id")
        .join(_product(t), "product_id")
        .join(_unit(t), "uom_id")
        .select(
            "id", "purchase_order_id", "po_number", "supplier_id", "supplier_name", "po_status", "order_date", "expected_date",
            "line_no", "product_id", "product_sku", "product_name", "uom_id", "uom_code", "qty_ordered", "qty_received",
            "qty_outstanding", "price_per_uom", (F.col("qty_outstanding") * F.col("price_per_uom")).alias("amount_outstanding"),
        )
    )


def po_header_open(t: Tables) -> DataFrame:
    """V8: outstanding totals per purchase order. Lines are summed before they meet the headers."""
    totals = (
        active(t["purchase_order_line"])
        .groupBy("purchase_order_id")
        .agg(
            F.sum(_outstanding()).alias("total_qty_outstanding"),
            F.sum(_outstanding() * F.col("price_per_uom")).alias("total_amount_outstanding"),
        )
        .filter(F.col("total_qty_outstanding") > 0)
        .withColumnRenamed("purchase_order_id", "id")
    )
    return (
        _open_purchase_orders(t)
        .join(columns_of(t["supplier"], "supplier_id", supplier_name="name"), "supplier_id")
        .join(totals, "id")
        .select(
            "id", "po_number", "supplier_id", "supplier_name", F.col("status").alias("po_status"), "order_date", "expected_date",
            "total_qty_outstanding", "total_amount_outstanding",
        )
    )


def so_line_reservations(t: Tables) -> DataFrame:
    """V9: reserved and picked totals per order line; zero for a line without reservations."""
    held = F.when(in_status("status", RESERVATION_HOLDING), F.col("qty_reserved") - F.col("qty_picked")).otherwise(F.lit(0))
    per_line = (
        active(t["reservation"])
        .groupBy("so_line_id")
        .agg(F.sum(held).alias("_held"), F.sum("qty_picked").alias("_picked"))
    )
    return (
        active(t["sales_order_line"])
        .select(F.col("id").alias("so_line_id"), "sales_order_id", "line_no", "product_id")
        .join(per_line, "so_line_id", "left")
        .select(
            "so_line_id", "sales_order_id", "line_no", "product_id",
            F.coalesce("_held", F.lit(0)).alias("qty_reserved_open"),
            F.coalesce("_picked", F.lit(0)).alias("qty_picked_total"),
        )
    )


def so_line_open(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Sales lines that still need stock; with ``orders``, of these order ids only, whose reservations alone are grouped."""
    if orders is not None:
        t = within(t, "sales_order", orders, ["sales_order_line", "reservation"])
    lines = active(t["sales_order_line"])
    headers = columns_of(
        active(t["sales_order"]).filter(in_status("status", SO_OPEN)), "sales_order_id",
        so_number="so_number", customer_id="customer_id", so_status="status", order_date="order_date",
    )
    held = so_line_reservations(t).select(F.col("so_line_id").alias("id"), "qty_reserved_open")
    return (
        lines.join(held, "id", "left")
        .withColumn("qty_reserved_open", F.coalesce("qty_reserved_open", F.lit(0)))
        .withColumn("qty_to_reserve", remainder(F.col("qty_ordered"), F.col("qty_reserved_open")))
        .filter(F.col("qty_to_reserve") > 0)
        .join(headers, "sales_order_id")
        .join(columns_of(t["customer"], "customer_id", customer_name="name"), "customer_id")
        .join(_product(t), "product_id")
        .join(_unit(t), "uom_id")
        .select(
            "id", "sales_order_id", "so_number", "customer_id", "customer_name", "so_status", "order_date", "line_no", "product_id",
            "product_sku", "product_name", "uom_id", "uom_code", "qty_ordered", "qty_reserved_open", "qty_to_reserve",
        )
    )


def picklist_detail(t: Tables, picklists: DataFrame | None = None) -> DataFrame:
    """Pick items with codes, optionally of the given picklist ids only."""
    items = active(t["pick_item"])
    if picklists is not None:
        items = where_in_keys(items, picklists, "picklist_id")
    return (
        items.withColumnRenamed("status", "pick_item_status")
        .join(columns_of(t["picklist"], "picklist_id", warehouse_id="warehouse_id", picklist_status="status"), "picklist_id")
        .join(_product(t), "product_id")
        .join(_bin(t), "bin_id", "left")
        .join(_lot(t), "lot_id", "left")
        .select(
            "id", "picklist_id", "warehouse_id", "picklist_status", "reservation_id", "bin_id", "bin_code", "product_id",
            "product_sku", "product_name", "lot_id", "lot_code", "qty_to_pick", "qty_picked", "pick_item_status",
        )
    )


def _order_number(t: Tables) -> DataFrame:
    return columns_of(t["sales_order"], "sales_order_id", so_number="so_number")


def shipment_detail(t: Tables, shipments: DataFrame | None = None) -> DataFrame:
    """Shipment items with order, carrier and lot, optionally of the given shipment ids only."""
    items = active(t["shipment_item"])
    if shipments is not None:
        items = where_in_keys(items, shipments, "shipment_id")
    headers = columns_of(
        t["shipment"], "shipment_id", shipment_number="shipment_number", sales_order_id="sales_order_id", warehouse_id="warehouse_id",
        carrier_id="carrier_id", tracking_no="tracking_no", ship_date="ship_date",
    )
    return (
        items.join(headers, "shipment_id")
        .join(_order_number(t), "sales_order_id")
        .join(columns_of(t["carrier"], "carrier_id", live=False, carrier_name="name"), "carrier_id", "left")
        .join(_product(t), "product_id")
        .join(_lot(t), "lot_id", "left")
        .select(
            "shipment_id", "shipment_number", "sales_order_id", "so_number", "warehouse_id", "carrier_id", "carrier_name", "tracking_no",
            "ship_date", F.col("id").alias("shipment_item_id"), "product_id", "product_sku", "product_name", "lot_id", "lot_code", "qty_shipped",
        )
    )


def package_detail(t: Tables) -> DataFrame:
    """Package items with their package, order and lot."""
    headers = columns_of(
        t["package"], "package_id", package_no="package_no", sales_order_id="sales_order_id", warehouse_id="warehouse_id",
        shipment_id="shipment_id", package_status="status", weight_kg="weight_kg", dims="dims",
    )
    return (
        active(t["package_item"])
        .join(headers, "package_id")
        .join(_order_number(t), "sales_order_id")
        .join(_product(t), "product_id")
        .join(_lot(t), "lot_id", "left")
        .select(
            "package_id", "package_no", "sales_order_id", "so_number", "warehouse_id", "shipment_id", "package_status", "weight_kg", "dims",
            F.col("id").alias("package_item_id"), "product_id", "product_sku", "product_name", "lot_id", "lot_code", "qty",
        )
    )


def transfer_line_open(t: Tables) -> DataFrame:
    """Lines of transfers that are not finished."""
    headers = columns_of(
        active(t["transfer_order"]).filter(in_status("status", TRANSFER_OPEN)), "transfer_order_id",
        transfer_number="transfer_number", from_warehouse_id="from_warehouse_id", to_warehouse_id="to_warehouse_id",
        transfer_status="status", requested_at="requested_at",
    )
    return (
        active(t["transfer_order_line"])
        .join(headers, "transfer_order_id")
        .join(_product(t), "product_id")
        .join(_lot(t), "lot_id", "left")
        .select(
            "id", "transfer_order_id", "transfer_number", "from_warehouse_id", "to_warehouse_id", "transfer_status", "requested_at",
            "product_id", "product_sku", "product_name", "lot_id", "lot_code", "qty",
        )
    )


def inventory_tx_running(t: Tables, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The ledger with the running balance of each bucket.

    A bucket with more than ``slice_rows`` movements is spread over several tasks.
    """
    ledger = t["inventory_tx"].select(
        "id", "ts", bucket().alias("bucket"), "reason", "ref_type", "ref_id", "qty_delta"
    )
    return running_totals(ledger, ["bucket"], ["ts", "id"], {"running_qty": F.col("qty_delta")}, slice_rows).select(
        "id", "ts", "bucket.*", "reason", "ref_type", "ref_id", "qty_delta", "running_qty"
    )


def bom_active(t: Tables, as_of: Column) -> DataFrame:
    """Bills of material effective on ``as_of``."""
    return (
        active(t["bom"])
        .filter(effective_on(as_of, "effective_from", "effective_to"))
        .select(F.col("id").alias("bom_id"), "parent_product_id", "revision", "effective_from", "effective_to")
    )


def bom_flat_active(t: Tables, as_of: Column, max_level: int | None = None) -> DataFrame:
    """Effective bills of material exploded to all levels."""
    edges = (
        bom_active(t, as_of)
        .join(t["bom_item"], "bom_id")
        .select(
            F.col("bom_id").alias("root"), F.col("parent_product_id").alias("parent"), F.col("component_product_id").alias("child"),
            F.col("qty_per").cast("decimal(18,6)").alias("qty"),
        )
    )
    return explode_graph(edges, max_level).select(
        F.col("root").alias("bom_id"), F.col("parent").alias("parent_product_id"), F.col("child").alias("component_product_id"),
        F.col("qty").alias("total_qty_per"), "level",
    )


def search_catalog(t: Tables) -> DataFrame:
    """Six entity types in one shape: type, id, label, weighted tokens."""

    def entity(kind, rows, label, *weighted):
        return rows.select(
            F.lit(kind).alias("entity_type"), F.col("id").cast("string").alias("entity_id"), label.alias("label"),
            search_tokens(*weighted).alias("tokens"),
        )

    def text(name):
        return F.coalesce(F.col(name), F.lit(""))

    place = F.concat_ws(" ", *[text(c) for c in ("line1", "line2", "city", "region", "postal_code", "country_code")])
    parts = [
        entity("product", active(t["product"]), F.concat("sku", F.lit(" "), "name"), ("A", text("sku")), ("B", text("name"))),
        entity("customer", active(t["customer"]), F.col("name"), ("A", text("name")), ("D", text("tax_id"))),
        entity("supplier", active(t["supplier"]), F.col("name"), ("A", text("name")), ("D", text("tax_id"))),
        entity("warehouse", active(t["warehouse"]), F.concat("code", F.lit(" "), "name"), ("A", text("code")), ("B", text("name"))),
        entity("lot", active(t["lot"]), F.col("lot_code"), ("D", text("lot_code"))),
        entity("address", t["address"], F.concat(text("line1"), F.lit(" "), text("city"), F.lit(" "), text("postal_code")), ("D", place)),
    ]
    catalogue = parts[0]
    for part in parts[1:]:
        catalogue = catalogue.unionByName(part)
    return catalogue
