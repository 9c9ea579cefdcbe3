"""Oracle pairs for the nested document: the document is exploded to flat rows on the Spark side."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import RUN_TS, query
from stockloom.plans import documents

ORDER_LINE = "select id so_line_id, sales_order_id from {sales_order_line}"

CHOSEN_PICKLIST = """
    select x.sales_order_id, k.id picklist_id, k.warehouse_id, k.status
    from (select l.sales_order_id, min(i.picklist_id) picklist_id from {pick_item} i join {reservation} r on r.id=i.reservation_id
          join {sales_order_line} l on l.id=r.so_line_id group by l.sales_order_id) x
    join {picklist} k on k.id=x.picklist_id and not k.is_deleted"""

LATEST_SHIPMENT = """
    select * from (
      select s.*, w.code warehouse_code, c.name carrier_name,
             row_number() over (partition by s.sales_order_id order by s.ship_date desc nulls first, s.id desc) rn
      from {shipment} s join {warehouse} w on w.id=s.warehouse_id left join {carrier} c on c.id=s.carrier_id where not s.is_deleted) z
    where rn=1"""

FIRST_RESERVATION = """
    select * from (
      select l.sales_order_id, r.id reservation_id, r.warehouse_id, w.code warehouse_code,
             row_number() over (partition by l.sales_order_id order by r.created_at, r.id) rn
      from {reservation} r join {sales_order_line} l on l.id=r.so_line_id join {warehouse} w on w.id=r.warehouse_id where not r.is_deleted) z
    where rn=1"""

DOC_ORDER = """
    select o.*, c.name customer_name from {sales_order} o join {customer} c on c.id=o.customer_id and not c.is_deleted where not o.is_deleted"""

PARTS = {"chosen": CHOSEN_PICKLIST, "latest": LATEST_SHIPMENT, "first": FIRST_RESERVATION, "doc_order": DOC_ORDER}

HEADER = """
    select o.id sales_order_id, o.so_number, o.customer_id, o.customer_name, o.status so_status, o.order_date, o.due_date, o.currency,
           coalesce(f.warehouse_id, s.warehouse_id) warehouse_id, coalesce(f.warehouse_code, s.warehouse_code) warehouse_code,
           s.carrier_id, s.carrier_name, s.tracking_no, s.ship_date, k.picklist_id, s.id shipment_id
    from {doc_order} o left join {first} f on f.sales_order_id=o.id left join {latest} s on s.sales_order_id=o.id
    left join {chosen} k on k.sales_order_id=o.id"""

DOC_LINES = """
    select o.id sales_order_id, l.id line_id, l.line_no, l.product_id, p.sku, p.name, l.uom_id, u.code uom_code,
           cast(l.qty_ordered as double) qty_ordered, cast(greatest(coalesce(r.res,0)-coalesce(r.pick,0),0) as double) qty_reserved_open,
           cast(greatest(l.qty_ordered-greatest(coalesce(r.res,0)-coalesce(r.pick,0),0),0) as double) qty_to_reserve,
           cast(l.price_per_uom as double) price_per_uom
    from {doc_order} o join {sales_order_line} l on l.sales_order_id=o.id and not l.is_deleted join {product} p on p.id=l.product_id and not p.is_deleted
    join {unit_of_measure} u on u.id=l.uom_id
    left join (select so_line_id, sum(qty_reserved) res, sum(qty_picked) pick from {reservation} where not is_deleted group by 1) r on r.so_line_id=l.id"""

DOC_RESERVATIONS = """
    select o.id sales_order_id, r.id, r.so_line_id, r.warehouse_id, r.bin_id, r.product_id, r.lot_id, cast(r.qty_reserved as double) qty_reserved,
           cast(r.qty_picked as double) qty_picked, r.status
    from {doc_order} o join {sales_order_line} l on l.sales_order_id=o.id join {reservation} r on r.so_line_id=l.id and not r.is_deleted"""

DOC_PICK_ITEMS = """
    select o.id sales_order_id, k.picklist_id, k.warehouse_id, k.status picklist_status, i.id, i.reservation_id, i.bin_id, i.product_id, i.lot_id,
           cast(i.qty_to_pick as double) qty_to_pick, cast(i.qty_picked as double) qty_picked, i.status
    from {doc_order} o join {chosen} k on k.sales_order_id=o.id left join {pick_item} i on i.picklist_id=k.picklist_id and not i.is_deleted"""

DOC_SHIPMENT_ITEMS = """
    select o.id sales_order_id, s.id shipment_id, s.shipment_number, s.ship_date, i.id, i.product_id, i.lot_id,
           cast(i.qty_shipped as double) qty_shipped
    from {doc_order} o join {latest} s on s.sales_order_id=o.id left join {shipment_item} i on i.shipment_id=s.id and not i.is_deleted"""

HEADER_COLUMNS = (
    "sales_order_id", "so_number", "customer_id", "customer_name", "so_status", "order_date", "due_date", "currency", "warehouse_id",
    "warehouse_code", "carrier_id", "carrier_name", "tracking_no", "ship_date",
)


@query("v19_doc_header", HEADER, **PARTS)
def _(t, spark, folder):
    return documents.order_fulfillment_doc(t).select(
        *HEADER_COLUMNS, F.col("picklist.picklistId").alias("picklist_id"), F.col("shipment.shipmentId").alias("shipment_id")
    )


@query("v19_doc_lines", DOC_LINES, **PARTS)
def _(t, spark, folder):
    line = documents.order_fulfillment_doc(t).select("sales_order_id", F.explode("lines").alias("x"))
    return line.select(
        "sales_order_id", F.col("x.lineId").alias("line_id"), F.col("x.lineNo").alias("line_no"), F.col("x.productId").alias("product_id"),
        F.col("x.productSku").alias("sku"), F.col("x.productName").alias("name"), F.col("x.uomId").alias("uom_id"),
        F.col("x.uomCode").alias("uom_code"), F.col("x.qtyOrdered").alias("qty_ordered"), F.col("x.qtyReservedOpen").alias("qty_reserved_open"),
        F.col("x.qtyToReserve").alias("qty_to_reserve"), F.col("x.pricePerUom").alias("price_per_uom"),
    )


@query("v19_doc_reservations", DOC_RESERVATIONS, **PARTS)
def _(t, spark, folder):
    row = documents.order_fulfillment_doc(t).select("sales_order_id", F.explode("reservations").alias("x"))
    return row.select(
        "sales_order_id", "x.id", F.col("x.soLineId").alias("so_line_id"), F.col("x.warehouseId").alias("warehouse_id"),
        F.col("x.binId").alias("bin_id"), F.col("x.productId").alias("product_id"), F.col("x.lotId").alias("lot_id"),
        F.col("x.qtyReserved").alias("qty_reserved"), F.col("x.qtyPicked").alias("qty_picked"), "x.status",
    )


@query("v19_doc_pick_items", DOC_PICK_ITEMS, **PARTS)
def _(t, spark, folder):
    row = documents.order_fulfillment_doc(t).filter(F.col("picklist").isNotNull()).select(
        "sales_order_id", F.col("picklist.picklistId").alias("picklist_id"), F.col("picklist.warehouseId").alias("warehouse_id"),
        F.col("picklist.status").alias("picklist_status"), F.explode_outer("picklist.items").alias("x"),
    )
    return row.select(
        "sales_order_id", "picklist_id", "warehouse_id", "picklist_status", "x.id", F.col("x.reservationId").alias("reservation_id"),
        F.col("x.binId").alias("bin_id"), F.col("x.productId").alias("product_id"), F.col("x.lotId").alias("lot_id"),
        F.col("x.qtyToPick").alias("qty_to_pick"), F.col("x.qtyPicked").alias("qty_picked"), "x.status",
    )


@query("v19_doc_shipment_items", DOC_SHIPMENT_ITEMS, **PARTS)
def _(t, spark, folder):
    row = documents.order_fulfillment_doc(t).filter(F.col("shipment").isNotNull()).select(
        "sales_order_id", F.col("shipment.shipmentId").alias("shipment_id"), F.col("shipment.shipmentNumber").alias("shipment_number"),
        F.col("shipment.shipDate").alias("ship_date"), F.explode_outer("shipment.items").alias("x"),
    )
    return row.select(
        "sales_order_id", "shipment_id", "shipment_number", "ship_date", "x.id", F.col("x.productId").alias("product_id"),
        F.col("x.lotId").alias("lot_id"), F.col("x.qtyShipped").alias("qty_shipped"),
    )


def requests_for_all(t):
    """A request per order: the warehouse and currency to use where the order has none."""
    return t["sales_order"].select(F.col("id").alias("sales_order_id"), (F.col("id") % 5).alias("warehouse_id"), F.lit("EUR").alias("currency"))


def stored_documents(t):
    return documents.to_document(documents.order_fulfillment_doc(t), requests_for_all(t), F.lit(RUN_TS).cast("timestamp"))


@query("v20_to_document", f"""
    select h.sales_order_id _id, h.so_number "soNumber", coalesce(h.warehouse_id, h.sales_order_id%5) "warehouseId", h.warehouse_code "warehouseCode",
           h.currency, h.order_date "orderDate", h.ship_date "shipDate", coalesce(n.lines,0) line_count, coalesce(r.n,0) reservation_count,
           '{documents.DOCUMENT_SOURCE}' source, timestamp'{RUN_TS}' "createdAt"
    from {{header}} h
    left join (select l.sales_order_id, count(*) lines from {{sales_order_line}} l join {{product}} p on p.id=l.product_id and not p.is_deleted
               where not l.is_deleted group by 1) n on n.sales_order_id=h.sales_order_id
    left join (select l.sales_order_id, count(*) n from {{reservation}} r join {{sales_order_line}} l on l.id=r.so_line_id
               where not r.is_deleted group by 1) r on r.sales_order_id=h.sales_order_id""", header=HEADER, **PARTS)
def _(t, spark, folder):
    return stored_documents(t).select(
        "_id", "soNumber", "warehouseId", "warehouseCode", "currency", "orderDate", "shipDate",
        F.size("lines").cast("bigint").alias("line_count"), F.size("reservations").cast("bigint").alias("reservation_count"), "source", "createdAt",
    )


# What a stored document holds, row by row.
NESTED = """
    select sales_order_id _id, 'header' kind, sales_order_id id, coalesce(warehouse_id, sales_order_id%5) ref, cast(null as double) a, cast(null as double) b, so_number note from {header}
    union all select sales_order_id, 'line', line_id, product_id, qty_ordered, qty_to_reserve, sku || '/' || uom_code from {doc_lines}
    union all select sales_order_id, 'reservation', id, so_line_id, qty_reserved, qty_picked, status from {doc_reservations}
    union all select sales_order_id, 'pick', id, reservation_id, qty_to_pick, qty_picked, status from {doc_picks} where id is not null
    union all select sales_order_id, 'shipped', id, product_id, qty_shipped, cast(null as double), shipment_number from {doc_shipped} where id is not null"""

NESTED_PARTS = {
    **PARTS, "header": HEADER, "doc_lines": DOC_LINES, "doc_reservations": DOC_RESERVATIONS, "doc_picks": DOC_PICK_ITEMS, "doc_shipped": DOC_SHIPMENT_ITEMS,
}


def nested_rows(stored):
    """The content of stored documents as rows: _id, kind, id, ref, a, b, note; each document is read once."""
    empty = F.lit(None).cast("double")

    def row(kind, key, ref, a, b, note):
        return F.struct(F.lit(kind).alias("kind"), key.alias("id"), ref.alias("ref"), a.alias("a"), b.alias("b"), note.alias("note"))

    parts = [
        F.array(row("header", F.col("_id"), F.col("warehouseId"), empty, empty, F.col("soNumber"))),
        F.transform("lines", lambda x: row("line", x["lineId"], x["productId"], x["qtyOrdered"], x["qtyToReserve"], F.concat(x["productSku"], F.lit("/"), x["uomCode"]))),
        F.transform("reservations", lambda x: row("reservation", x["id"], x["soLineId"], x["qtyReserved"], x["qtyPicked"], x["status"])),
        F.transform("picklist.items", lambda x: row("pick", x["id"], x["reservationId"], x["qtyToPick"], x["qtyPicked"], x["status"])),
        F.transform("shipment.items", lambda x: row("shipped", x["id"], x["productId"], x["qtyShipped"], empty, F.col("shipment.shipmentNumber"))),
    ]
    return stored.select("_id", F.explode(F.flatten(F.filter(F.array(*parts), lambda rows: rows.isNotNull()))).alias("_row")).select("_id", "_row.*")


@query("v20_documents_nested", NESTED, **NESTED_PARTS)
def _(t, spark, folder):
    return nested_rows(stored_documents(t))
