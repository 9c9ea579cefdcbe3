"""One nested fulfilment document per order (V19), its flat parts, and its stored form.

Every child table is reduced to one row per order by a single aggregation on the order key; all
parts then meet the header on that same key, so the joins reuse the partitioning the aggregations
already made. The flat parts are public: an order too large for one document is still whole there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.predicates import remainder
from stockloom.operators.closure import within
from stockloom.operators.firsts import greatest_by
from stockloom.operators.lookup import columns_of
from stockloom.sources.tables import Tables, active

DOCUMENT_SOURCE = "order-fulfillment-demo"  # fixed value stored in every document


def _for_orders(t: Tables, orders: DataFrame | None) -> Tables:
    """With ``orders``, the tables cut down to what belongs to these orders before anything is grouped or joined."""
    return t if orders is None else within(t, "sales_order", orders, ["sales_order_line", "reservation", "shipment", "shipment_item"])


def _order_of_line(t: Tables) -> DataFrame:
    return t["sales_order_line"].select(F.col("id").alias("so_line_id"), "sales_order_id")


def document_lines(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Order lines of active products. Reserved totals count reservations of every status."""
    t = _for_orders(t, orders)
    totals = active(t["reservation"]).groupBy("so_line_id").agg(
        F.sum("qty_reserved").alias("_reserved"), F.sum("qty_picked").alias("_picked")
    )
    held = remainder(F.coalesce("_reserved", F.lit(0)), F.coalesce("_picked", F.lit(0)))
    return (
        active(t["sales_order_line"])
        .withColumnRenamed("id", "so_line_id")
        .join(totals, "so_line_id", "left")
        .join(columns_of(t["product"], "product_id", product_sku="sku", product_name="name"), "product_id")
        .join(columns_of(t["unit_of_measure"], "uom_id", live=False, uom_code="code"), "uom_id")
        .withColumn("_held", held)
        .select(
            "sales_order_id", F.col("so_line_id").alias("line_id"), "line_no", "product_id", "product_sku", "product_name", "uom_id", "uom_code",
            F.col("qty_ordered").cast("double").alias("qty_ordered"), F.col("_held").cast("double").alias("qty_reserved_open"),
            remainder(F.col("qty_ordered"), F.col("_held")).cast("double").alias("qty_to_reserve"),
            F.col("price_per_uom").cast("double").alias("price_per_uom"),
        )
    )


def document_reservations(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Active reservations per order, including those of deleted lines."""
    t = _for_orders(t, orders)
    return (
        active(t["reservation"])
        .join(_order_of_line(t), "so_line_id")
        .select(
            "sales_order_id", "id", "so_line_id", "warehouse_id", "bin_id", "product_id", "lot_id",
            F.col("qty_reserved").cast("double").alias("qty_reserved"), F.col("qty_picked").cast("double").alias("qty_picked"),
            "status", "created_at",
        )
    )


def document_picklists(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """The picklist chosen for each order: the least picklist id that any pick item of the order names.

    The choice ignores deletion; a deleted choice then leaves the order without a picklist.
    """
    t = _for_orders(t, orders)
    chosen = (
        t["pick_item"].select("picklist_id", F.col("reservation_id").alias("id"))
        .join(t["reservation"].select("id", "so_line_id"), "id")
        .join(_order_of_line(t), "so_line_id")
        .groupBy("sales_order_id")
        .agg(F.min("picklist_id").alias("picklist_id"))
    )
    return chosen.join(columns_of(t["picklist"], "picklist_id", warehouse_id="warehouse_id", status="status"), "picklist_id")


def document_pick_items(t: Tables, orders: DataFrame | None = None, picklists: DataFrame | None = None) -> DataFrame:
    picklists = document_picklists(t, orders) if picklists is None else picklists
    return (
        active(t["pick_item"])
        .join(picklists.select("picklist_id", "sales_order_id"), "picklist_id")
        .select(
            "sales_order_id", "picklist_id", "id", "reservation_id", "bin_id", "product_id", "lot_id",
            F.col("qty_to_pick").cast("double").alias("qty_to_pick"), F.col("qty_picked").cast("double").alias("qty_picked"), "status",
        )
    )


def document_shipments(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """The latest active shipment per order; one without a date counts as latest."""
    t = _for_orders(t, orders)
    shipments = active(t["shipment"]).join(
        columns_of(t["warehouse"], "warehouse_id", live=False, warehouse_code="code"), "warehouse_id"
    )
    latest = greatest_by(
        shipments, ["sales_order_id"], [F.col("ship_date").isNull(), F.col("ship_date"), F.col("id")],
        ["id", "shipment_number", "warehouse_id", "warehouse_code", "carrier_id", "tracking_no", "ship_date"],
    )
    carriers = columns_of(t["carrier"], "carrier_id", live=False, carrier_name="name")
    return latest.withColumnRenamed("id", "shipment_id").join(carriers, "carrier_id", "left")


def document_shipment_items(t: Tables, orders: DataFrame | None = None, shipments: DataFrame | None = None) -> DataFrame:
    shipments = document_shipments(t, orders) if shipments is None else shipments
    return (
        active(t["shipment_item"])
        .join(shipments.select("shipment_id", "sales_order_id"), "shipment_id")
        .select("sales_order_id", "shipment_id", "id", "product_id", "lot_id", F.col("qty_shipped").cast("double").alias("qty_shipped"))
    )


def _listed(**fields: str) -> Column:
    """Sorted array of structs; the first field is the id, which fixes the order."""
    return F.sort_array(F.collect_list(F.struct(*[F.col(column).alias(name) for name, column in fields.items()])))


def order_fulfillment_doc(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """Header, lines, reservations, picklist with items, shipment with items. No children gives null.

    With ``orders``, only documents of these order ids; every child table is cut down to them first.
    """
    t = _for_orders(t, orders)
    lines = document_lines(t).groupBy("sales_order_id").agg(
        _listed(
            lineId="line_id", lineNo="line_no", productId="product_id", productSku="product_sku", productName="product_name", uomId="uom_id",
            uomCode="uom_code", qtyOrdered="qty_ordered", qtyReservedOpen="qty_reserved_open", qtyToReserve="qty_to_reserve",
            pricePerUom="price_per_uom",
        ).alias("lines")
    )
    warehouses = columns_of(t["warehouse"], "warehouse_id", live=False, warehouse_code="code")
    first = F.struct(F.col("created_at").isNull(), "created_at", "id", "warehouse_id", "warehouse_code")
    reservations = (
        document_reservations(t)
        .join(warehouses, "warehouse_id", "left")
        .groupBy("sales_order_id")
        .agg(
            _listed(
                id="id", soLineId="so_line_id", warehouseId="warehouse_id", binId="bin_id", productId="product_id", lotId="lot_id",
                qtyReserved="qty_reserved", qtyPicked="qty_picked", status="status",
            ).alias("reservations"),
            F.min(F.when(F.col("warehouse_code").isNotNull(), first)).alias("_first"),
        )
    )

    picklists = document_picklists(t)
    pick_items = document_pick_items(t, picklists=picklists).groupBy("sales_order_id").agg(
        _listed(
            id="id", reservationId="reservation_id", binId="bin_id", productId="product_id", lotId="lot_id", qtyToPick="qty_to_pick",
            qtyPicked="qty_picked", status="status",
        ).alias("items")
    )
    picklist = picklists.join(pick_items, "sales_order_id", "left").select(
        "sales_order_id",
        F.struct(
            F.col("picklist_id").alias("picklistId"), F.col("warehouse_id").alias("warehouseId"), F.col("status"), F.col("items")
        ).alias("picklist"),
    )

    shipments = document_shipments(t)
    shipment_items = document_shipment_items(t, shipments=shipments).groupBy("sales_order_id").agg(
        _listed(id="id", productId="product_id", lotId="lot_id", qtyShipped="qty_shipped").alias("items")
    )
    shipment = shipments.join(shipment_items, "sales_order_id", "left").select(
        "sales_order_id", "carrier_id", "carrier_name", "tracking_no", "ship_date",
        F.col("warehouse_id").alias("_ship_warehouse"), F.col("warehouse_code").alias("_ship_warehouse_code"),
        F.struct(
            F.col("shipment_id").alias("shipmentId"), F.col("shipment_number").alias("shipmentNumber"), F.col("warehouse_id").alias("warehouseId"),
            F.col("carrier_id").alias("carrierId"), F.col("carrier_name").alias("carrierName"), F.col("tracking_no").alias("trackingNo"),
            F.col("ship_date").alias("shipDate"), F.col("items"),
        ).alias("shipment"),
    )

    headers = active(t["sales_order"]).withColumnRenamed("id", "sales_order_id")
    return (
        headers.join(columns_of(t["customer"], "customer_id", customer_name="name"), "customer_id")
        .join(lines, "sales_order_id", "left")
        .join(reservations, "sales_order_id", "left")
        .join(picklist, "sales_order_id", "left")
        .join(shipment, "sales_order_id", "left")
        .select(
            "sales_order_id", "so_number", "customer_id", "customer_name", F.col("status").alias("so_status"), "order_date", "due_date", "currency",
            F.coalesce("_first.warehouse_id", "_ship_warehouse").alias("warehouse_id"),
            F.coalesce("_first.warehouse_code", "_ship_warehouse_code").alias("warehouse_code"),
            "carrier_id", "carrier_name", "tracking_no", "ship_date", "lines", "reservations", "picklist", "shipment",
        )
    )


def to_document(doc: DataFrame, requests: DataFrame, run_ts: Column, source: str = DOCUMENT_SOURCE) -> DataFrame:
    """The stored form of V19 rows.

    ``requests``: sales_order_id, warehouse_id, currency, which fill what the order itself lacks.
    Missing arrays become empty ones.
    """
    asked = requests.select(
        "sales_order_id", F.col("warehouse_id").alias("_warehouse_id"), F.col("currency").alias("_currency")
    )

    def listed(column):
        return F.coalesce(F.col(column), F.array().cast(doc.schema[column].dataType))

    def with_items(column):
        kind = doc.schema[column].dataType
        items = F.coalesce(F.col(f"{column}.items"), F.array().cast(kind["items"].dataType))
        return F.when(F.col(column).isNotNull(), F.col(column).withField("items", items))

    camel = {
        "soNumber": "so_number", "customerId": "customer_id", "customerName": "customer_name", "warehouseCode": "warehouse_code",
        "carrierId": "carrier_id", "carrierName": "carrier_name", "trackingNo": "tracking_no",
    }
    return doc.join(asked, "sales_order_id").select(
        F.col("sales_order_id").alias("_id"), F.col("sales_order_id").alias("salesOrderId"),
        *[F.col(old).alias(new) for new, old in camel.items()],
        F.coalesce("warehouse_id", "_warehouse_id").alias("warehouseId"),
        F.to_date("order_date").alias("orderDate"), F.to_date("due_date").alias("dueDate"), F.to_date("ship_date").alias("shipDate"),
        F.coalesce("currency", "_currency").alias("currency"), F.col("so_status").alias("soStatus"),
        listed("lines").alias("lines"), listed("reservations").alias("reservations"),
        with_items("picklist").alias("picklist"), with_items("shipment").alias("shipment"),
        run_ts.alias("createdAt"), F.lit(source).alias("source"),
    )


def as_json(doc: DataFrame, key: str = "sales_order_id") -> DataFrame:
    """documents as JSON text with null fields kept."""
    return doc.select(F.col(key), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
