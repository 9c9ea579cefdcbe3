"""The data model: 36 tables, their types, keys, references, allowed values and checks.

Everything in this module is a fixed value that results depend on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

KEY = T.StringType()
TEXT = T.StringType()
INT = T.IntegerType()
FLAG = T.BooleanType()
DAY = T.DateType()
MOMENT = T.TimestampType()
QTY = T.DecimalType(18, 3)
PRICE = T.DecimalType(18, 4)
FACTOR = T.DecimalType(18, 6)
MONEY = T.DecimalType(18, 2)
WEIGHT = T.DecimalType(10, 3)

ZERO_ID = "00000000-0000-0000-0000-000000000000"
BUCKET = ("warehouse_id", "bin_id", "product_id", "lot_id")

_AUDIT = [
    ("is_deleted!", FLAG),
    ("created_at!", MOMENT),
    ("created_by", KEY),
    ("updated_at", MOMENT),
    ("updated_by", KEY),
    ("deleted_at", MOMENT),
    ("deleted_by", KEY),
]


def _schema(columns, audit):
    listed = [("id!", KEY), *columns, *(_AUDIT if audit else [])]
    return T.StructType([T.StructField(name.rstrip("!"), kind, not name.endswith("!")) for name, kind in listed])


def _bare(*columns):
    return _schema(columns, audit=False)


def _audited(*columns):
    return _schema(columns, audit=True)


# A trailing "!" marks a column that may not be null.
SCHEMAS: dict[str, T.StructType] = {
    "app_user": _bare(("username!", TEXT), ("full_name", TEXT), ("email!", TEXT), ("created_at!", MOMENT), ("updated_at", MOMENT)),
    "address": _bare(("line1", TEXT), ("line2", TEXT), ("city", TEXT), ("region", TEXT), ("country_code", TEXT), ("postal_code", TEXT)),
    "unit_of_measure": _bare(("code!", TEXT), ("name!", TEXT)),
    "uom_conversion": _bare(("from_uom_id!", KEY), ("to_uom_id!", KEY), ("factor!", FACTOR)),
    "product_category": _audited(("name!", TEXT), ("code!", TEXT), ("parent_id", KEY)),
    "inventory_status": _bare(("code!", TEXT)),
    "supplier": _audited(("name!", TEXT), ("tax_id", TEXT), ("address_id", KEY)),
    "customer": _audited(("name!", TEXT), ("tax_id", TEXT), ("address_id", KEY)),
    "warehouse": _audited(("code!", TEXT), ("name!", TEXT), ("address_id", KEY)),
    "warehouse_bin": _audited(("warehouse_id!", KEY), ("code!", TEXT)),
    "product": _audited(("sku!", TEXT), ("name!", TEXT), ("category_id", KEY), ("base_uom_id!", KEY), ("metadata", TEXT)),
    "lot": _audited(("product_id!", KEY), ("lot_code!", TEXT), ("expiry_date", DAY), ("status_id", KEY)),
    "inventory": _audited(("warehouse_id!", KEY), ("bin_id", KEY), ("product_id!", KEY), ("lot_id", KEY), ("qty_on_hand!", QTY)),
    "purchase_order": _audited(
        ("po_number", TEXT), ("supplier_id!", KEY), ("status!", TEXT), ("order_date!", DAY),
        ("expected_date", DAY), ("currency", TEXT), ("total_amount", MONEY),
    ),
    "purchase_order_line": _audited(
        ("purchase_order_id!", KEY), ("line_no!", INT), ("product_id!", KEY), ("uom_id!", KEY),
        ("qty_ordered!", QTY), ("price_per_uom!", PRICE), ("qty_received!", QTY),
    ),
    "receipt": _audited(("receipt_number", TEXT), ("purchase_order_id!", KEY), ("warehouse_id!", KEY), ("received_at!", MOMENT)),
    "receipt_line": _audited(
        ("receipt_id!", KEY), ("po_line_id!", KEY), ("product_id!", KEY), ("lot_id", KEY), ("uom_id!", KEY), ("qty_received!", QTY),
    ),
    "sales_order": _audited(
        ("so_number", TEXT), ("customer_id!", KEY), ("status!", TEXT), ("order_date!", DAY),
        ("due_date", DAY), ("currency", TEXT), ("total_amount", MONEY),
    ),
    "sales_order_line": _audited(
        ("sales_order_id!", KEY), ("line_no!", INT), ("product_id!", KEY), ("uom_id!", KEY), ("qty_ordered!", QTY), ("price_per_uom!", PRICE),
    ),
    "carrier": _bare(("name!", TEXT), ("scac", TEXT)),
    "shipment": _audited(
        ("shipment_number", TEXT), ("sales_order_id!", KEY), ("warehouse_id!", KEY), ("carrier_id", KEY),
        ("tracking_no", TEXT), ("ship_date", DAY),
    ),
    "shipment_item": _audited(("shipment_id!", KEY), ("product_id!", KEY), ("lot_id", KEY), ("qty_shipped!", QTY)),
    "transfer_order": _audited(
        ("transfer_number", TEXT), ("from_warehouse_id!", KEY), ("to_warehouse_id!", KEY), ("status!", TEXT), ("requested_at!", MOMENT),
    ),
    "transfer_order_line": _audited(("transfer_order_id!", KEY), ("product_id!", KEY), ("lot_id", KEY), ("uom_id", KEY), ("qty!", QTY)),
    "reservation": _audited(
        ("so_line_id!", KEY), ("warehouse_id!", KEY), ("bin_id", KEY), ("product_id!", KEY), ("lot_id", KEY),
        ("qty_reserved!", QTY), ("qty_picked!", QTY), ("status!", TEXT),
    ),
    "picklist": _audited(("warehouse_id!", KEY), ("status!", TEXT)),
    "pick_item": _audited(
        ("picklist_id!", KEY), ("reservation_id!", KEY), ("bin_id", KEY), ("product_id!", KEY), ("lot_id", KEY),
        ("qty_to_pick!", QTY), ("qty_picked!", QTY), ("status!", TEXT),
    ),
    "package": _audited(
        ("sales_order_id!", KEY), ("warehouse_id!", KEY), ("shipment_id", KEY), ("package_no", TEXT), ("status!", TEXT),
        ("weight_kg", WEIGHT), ("dims", TEXT),
    ),
    "package_item": _audited(("package_id!", KEY), ("product_id!", KEY), ("lot_id", KEY), ("qty!", QTY)),
    "inventory_tx": _bare(
        ("ts!", MOMENT), ("warehouse_id!", KEY), ("bin_id", KEY), ("product_id!", KEY), ("lot_id", KEY), ("qty_delta!", QTY),
        ("reason!", TEXT), ("ref_type", TEXT), ("ref_id", KEY), ("move_key", TEXT), ("created_by", KEY),
    ),
    "customer_return": _audited(("customer_id!", KEY), ("sales_order_id", KEY), ("status!", TEXT)),
    "customer_return_line": _bare(
        ("customer_return_id!", KEY), ("product_id!", KEY), ("lot_id", KEY), ("qty!", QTY),
        ("shipment_item_id", KEY), ("disposition_status_id", KEY),
    ),
    "supplier_return": _audited(("supplier_id!", KEY), ("purchase_order_id", KEY), ("status!", TEXT)),
    "supplier_return_line": _bare(
        ("supplier_return_id!", KEY), ("product_id!", KEY), ("lot_id", KEY), ("qty!", QTY), ("receipt_line_id", KEY),
    ),
    "bom": _audited(("parent_product_id!", KEY), ("revision", TEXT), ("effective_from", DAY), ("effective_to", DAY)),
    "bom_item": _bare(("bom_id!", KEY), ("component_product_id!", KEY), ("qty_per!", FACTOR), ("sequence", INT)),
}

# Allowed states per (table, column).
ALLOWED: dict[tuple[str, str], tuple[str, ...]] = {
    ("purchase_order", "status"): ("DRAFT", "APPROVED", "RECEIVED", "CANCELLED"),
    ("sales_order", "status"): ("DRAFT", "APPROVED", "PART_SHIPPED", "SHIPPED", "CANCELLED"),
    ("transfer_order", "status"): ("DRAFT", "IN_TRANSIT", "RECEIVED", "CANCELLED"),
    ("reservation", "status"): ("OPEN", "PICKED", "RELEASED", "CANCELLED"),
    ("picklist", "status"): ("OPEN", "IN_PROGRESS", "CLOSED"),
    ("pick_item", "status"): ("OPEN", "PICKED", "SHORT"),
    ("package", "status"): ("OPEN", "SEALED"),
    ("inventory_tx", "reason"): (
        "RECEIVE", "ISSUE_PICK", "TRANSFER_OUT", "TRANSFER_IN", "ADJUST_POS", "ADJUST_NEG", "RETURN_FROM_CUST", "RETURN_TO_SUPP",
    ),
    ("customer_return", "status"): ("DRAFT", "RECEIVED", "DISPOSITIONED", "CLOSED"),
    ("supplier_return", "status"): ("DRAFT", "SHIPPED", "CLOSED"),
}

# Fixed-width text columns: longest allowed value.
WIDTHS: dict[tuple[str, str], int] = {
    ("address", "country_code"): 2,
    ("purchase_order", "currency"): 3,
    ("sales_order", "currency"): 3,
}

# Value given to a column when an inserted row leaves it out.
DEFAULTS: dict[str, dict[str, object]] = {
    "inventory": {"qty_on_hand": 0},
    "purchase_order": {"status": "DRAFT"},
    "purchase_order_line": {"qty_received": 0},
    "sales_order": {"status": "DRAFT"},
    "transfer_order": {"status": "DRAFT"},
    "reservation": {"qty_picked": 0, "status": "OPEN"},
    "picklist": {"status": "OPEN"},
    "pick_item": {"qty_picked": 0, "status": "OPEN"},
    "package": {"status": "OPEN"},
    "customer_return": {"status": "DRAFT"},
    "supplier_return": {"status": "DRAFT"},
}


# Columns whose default is the time of the run, and text columns kept in lower case.
TIMED = ("created_at", "received_at", "requested_at")
LOWERED = {"app_user": ("email",)}


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    cascade: bool = False


# Columns named <parent>_id point at <parent>; the others are listed by name.
_OTHER_PARENTS = {
    "category_id": "product_category", "parent_id": "product_category", "base_uom_id": "unit_of_measure",
    "uom_id": "unit_of_measure", "from_uom_id": "unit_of_measure", "to_uom_id": "unit_of_measure",
    "status_id": "inventory_status", "disposition_status_id": "inventory_status", "bin_id": "warehouse_bin",
    "po_line_id": "purchase_order_line", "so_line_id": "sales_order_line", "from_warehouse_id": "warehouse",
    "to_warehouse_id": "warehouse", "parent_product_id": "product", "component_product_id": "product",
    "created_by": "app_user", "updated_by": "app_user", "deleted_by": "app_user",
}

# Header tables whose line rows go with them.
_OWNED_LINES = {
    ("purchase_order_line", "purchase_order_id"), ("receipt_line", "receipt_id"), ("sales_order_line", "sales_order_id"),
    ("shipment_item", "shipment_id"), ("transfer_order_line", "transfer_order_id"), ("pick_item", "picklist_id"),
    ("package_item", "package_id"), ("customer_return_line", "customer_return_id"),
    ("supplier_return_line", "supplier_return_id"), ("bom_item", "bom_id"),
}


def _references():
    found = []
    for table, schema in SCHEMAS.items():
        for column in schema.names:
            parent = _OTHER_PARENTS.get(column)
            if parent is None and column.endswith("_id") and column[:-3] in SCHEMAS:
                parent = column[:-3]
            if parent is not None:
                found.append(Reference(table, column, parent, (table, column) in _OWNED_LINES))
    return tuple(found)


REFERENCES: tuple[Reference, ...] = _references()

# Unique columns; rows holding a null are exempt.
UNIQUE: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("app_user", ("username",)), ("app_user", ("email",)), ("unit_of_measure", ("code",)), ("inventory_status", ("code",)),
    ("purchase_order", ("po_number",)), ("receipt", ("receipt_number",)), ("sales_order", ("so_number",)),
    ("shipment", ("shipment_number",)), ("transfer_order", ("transfer_number",)), ("inventory_tx", ("move_key",)),
)

# Unique column groups; in the bucket keys a null bin or lot counts as a value.
UNIQUE_GROUPS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("uom_conversion", ("from_uom_id", "to_uom_id")), ("purchase_order_line", ("purchase_order_id", "line_no")),
    ("sales_order_line", ("sales_order_id", "line_no")), ("inventory", BUCKET), ("reservation", ("so_line_id", *BUCKET)),
)

# Unique among rows that are not deleted.
UNIQUE_LIVE: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("product_category", ("code",)), ("product", ("sku",)), ("warehouse", ("code",)),
    ("warehouse_bin", ("warehouse_id", "code")), ("lot", ("product_id", "lot_code")),
)

# Conditions every row has to meet; an unknown result passes.
CHECKS: tuple[tuple[str, str, str], ...] = (
    ("purchase_order_line", "received_within_ordered", "qty_received <= qty_ordered"),
    ("reservation", "picked_within_reserved", "qty_picked <= qty_reserved"),
    ("pick_item", "picked_within_to_pick", "qty_picked <= qty_to_pick"),
    ("inventory_tx", "movement_not_zero", "qty_delta <> 0"),
)

# Reject codes of the bulk jobs and the class of failure each one belongs to.
REJECT_CLASSES: dict[str, str] = {
    "INSUFFICIENT_AVAILABLE": "InsufficientStock",
    "INSUFFICIENT_STOCK": "InsufficientStock",
    "EXCEEDS_ORDERED": "Validation",
    "CHECK_VIOLATION": "Validation",
    "NOT_NULL_VIOLATION": "Validation",
    "ENUM_VIOLATION": "Validation",
    "LENGTH_VIOLATION": "Validation",
    "UNIQUE_VIOLATION": "Conflict",
    "FOREIGN_KEY_VIOLATION": "NotFound",
    "NOT_FOUND": "NotFound",
    "PRODUCT_MISMATCH": "Validation",
    "INVALID_QTY": "Validation",
    "MISSING_CONVERSION": "Infrastructure",
}
