"""A small data set: one customer, warehouse, bin, unit, two products, one lot, stock for both."""

import datetime
from decimal import Decimal

from pyspark.sql.types import StructType

from stockloom.sources.tables import local_rows, tables_from_rows

NOW = datetime.datetime(2024, 6, 1)
USER, CUSTOMER, WAREHOUSE, BIN, UNIT = "user-1", "customer-1", "warehouse-1", "bin-1", "unit-ea"
WIDGET, GADGET, CATEGORY, CARRIER, LOT, STATUS = "widget", "gadget", "category-1", "carrier-1", "lot-1", "status-1"


def rows():
    made = {"created_at": NOW, "created_by": USER}
    return {
        "app_user": [dict(id=USER, username="demo_user", full_name="Demo User", email="demo@example.com", created_at=NOW)],
        "customer": [dict(id=CUSTOMER, name="ACME Corporation", **made)],
        "warehouse": [dict(id=WAREHOUSE, code="WH-MAIN", name="Main Warehouse", **made)],
        "warehouse_bin": [dict(id=BIN, warehouse_id=WAREHOUSE, code="A-01-01", **made)],
        "unit_of_measure": [dict(id=UNIT, code="EA", name="Each"), dict(id="unit-box", code="BOX", name="Box")],
        "uom_conversion": [dict(id="c1", from_uom_id=UNIT, to_uom_id=UNIT, factor=Decimal(1)), dict(id="c2", from_uom_id="unit-box", to_uom_id=UNIT, factor=Decimal(12))],
        "product_category": [dict(id=CATEGORY, name="Electronics", code="ELEC", **made)],
        "product": [
            dict(id=WIDGET, sku="WGT-001", name="Super Widget", category_id=CATEGORY, base_uom_id=UNIT, **made),
            dict(id=GADGET, sku="GDG-001", name="Mega Gadget", category_id=CATEGORY, base_uom_id=UNIT, **made),
        ],
        "carrier": [dict(id=CARRIER, name="FastShip Express", scac="FSTX")],
        "inventory_status": [dict(id=STATUS, code="AVAILABLE")],
        "lot": [dict(id=LOT, product_id=WIDGET, lot_code="LOT-2024-001", expiry_date=datetime.date(2025, 12, 31), status_id=STATUS, **made)],
        "inventory": [
            dict(id="stock-1", warehouse_id=WAREHOUSE, bin_id=BIN, product_id=WIDGET, lot_id=LOT, qty_on_hand=Decimal(1000), **made),
            dict(id="stock-2", warehouse_id=WAREHOUSE, bin_id=BIN, product_id=GADGET, lot_id=None, qty_on_hand=Decimal(500), **made),
        ],
    }


def tables(spark, **more):
    data = rows()
    for table, extra in more.items():
        data[table] = data.get(table, []) + extra
    return tables_from_rows(spark, data)


def make(spark, schema, listed):
    kind = StructType.fromDDL(schema)
    return local_rows(spark, [dict(zip(kind.names, row)) for row in listed], kind)


ORDER_SCHEMA = (
    "id string, seq bigint, customer_id string, order_date date, due_date date, currency string, warehouse_id string, bin_id string, lot_id string, "
    "carrier_id string, tracking_no string, ship_date date"
)
LINE_SCHEMA = "id string, seq bigint, sales_order_id string, product_id string, uom_id string, qty_ordered decimal(18,3), price_per_uom decimal(18,4)"
DAY = datetime.date(2024, 6, 1)


def order(key, seq, **changes):
    row = dict(id=key, seq=seq, customer_id=CUSTOMER, order_date=DAY, due_date=None, currency="USD", warehouse_id=WAREHOUSE, bin_id=BIN, lot_id=LOT,
               carrier_id=CARRIER, tracking_no="T1", ship_date=DAY)
    row.update(changes)
    return tuple(row.values())


def line(key, order_key, qty, product=WIDGET, uom=UNIT, seq=1):
    return (key, seq, order_key, product, uom, Decimal(qty), Decimal(100))
