"""Oracle pairs for the named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import AS_OF, doubles, query
from stockloom.plans import views


@query("v01_product", """
    select p.id, p.sku, p.name, p.category_id, c.name category_name, p.base_uom_id, u.code base_uom_code
    from {product} p left join {product_category} c on c.id=p.category_id and not c.is_deleted
    left join {unit_of_measure} u on u.id=p.base_uom_id where not p.is_deleted""")
def _(t, spark, folder):
    return views.product(t)


@query("v02_category_path", """
    with recursive walk as (
      select id, code, name, parent_id, code path_code, name path_name, 0 depth from {product_category} where parent_id is null and not is_deleted
      union all
      select k.id, k.code, k.name, k.parent_id, w.path_code||'/'||k.code, w.path_name||'/'||k.name, w.depth+1
      from {product_category} k join walk w on k.parent_id=w.id where not k.is_deleted)
    select * from walk""")
def _(t, spark, folder):
    return views.category_path(t)


@query("v03_lot", """
    select l.id, l.product_id, p.sku product_sku, p.name product_name, l.lot_code, l.expiry_date, l.status_id
    from {lot} l join {product} p on p.id=l.product_id where not l.is_deleted and not p.is_deleted""")
def _(t, spark, folder):
    return views.lot(t)


BUCKETS = """
    select i.id, i.warehouse_id, w.code warehouse_code, i.bin_id, b.code bin_code, i.product_id, p.sku product_sku, p.name product_name,
           i.lot_id, l.lot_code, cast(i.qty_on_hand as double) qty_on_hand
    from {inventory} i join {warehouse} w on w.id=i.warehouse_id and not w.is_deleted
    left join {warehouse_bin} b on b.id=i.bin_id and not b.is_deleted
    join {product} p on p.id=i.product_id and not p.is_deleted
    left join {lot} l on l.id=i.lot_id and not l.is_deleted where not i.is_deleted"""

HELD = """
    select warehouse_id, bin_id, product_id, lot_id, cast(sum(qty_reserved-qty_picked) as double) qty_reserved_open
    from {reservation} where not is_deleted and status in ('OPEN','PICKED') group by warehouse_id, bin_id, product_id, lot_id"""

AVAILABLE = """
    select b.warehouse_id, b.warehouse_code, b.bin_id, b.bin_code, b.product_id, b.product_sku, b.product_name, b.lot_id, b.lot_code, b.qty_on_hand,
           greatest(b.qty_on_hand-coalesce(h.qty_reserved_open,0), 0) qty_available
    from {buckets} b left join {held} h on h.warehouse_id=b.warehouse_id and h.product_id=b.product_id
     and h.bin_id is not distinct from b.bin_id and h.lot_id is not distinct from b.lot_id"""


@query("v04_inventory_bucket", BUCKETS)
def _(t, spark, folder):
    return doubles(views.inventory_bucket(t), "qty_on_hand")


@query("v05_reservation_open", HELD)
def _(t, spark, folder):
    return doubles(views.reservation_open(t), "qty_reserved_open")


@query("v06_inventory_available", AVAILABLE, buckets=BUCKETS, held=HELD)
def v06(t, spark, folder):
    return doubles(views.inventory_available(t), "qty_on_hand", "qty_available")


@query("v07_po_line_open", """
    select l.id, l.purchase_order_id, o.po_number, o.supplier_id, s.name supplier_name, o.status po_status, o.order_date, o.expected_date, l.line_no,
           l.product_id, p.sku product_sku, p.name product_name, l.uom_id, u.code uom_code, cast(l.qty_ordered as double) qty_ordered,
           cast(l.qty_received as double) qty_received, cast(greatest(l.qty_ordered-l.qty_received,0) as double) qty_outstanding,
           cast(l.price_per_uom as double) price_per_uom, cast(greatest(l.qty_ordered-l.qty_received,0)*l.price_per_uom as double) amount_outstanding
    from {purchase_order_line} l join {purchase_order} o on o.id=l.purchase_order_id and not o.is_deleted and o.status in ('DRAFT','APPROVED')
    join {supplier} s on s.id=o.supplier_id and not s.is_deleted join {product} p on p.id=l.product_id and not p.is_deleted
    join {unit_of_measure} u on u.id=l.uom_id where not l.is_deleted and l.qty_ordered>l.qty_received""")
def _(t, spark, folder):
    return doubles(views.po_line_open(t), "qty_ordered", "qty_received", "qty_outstanding", "price_per_uom", "amount_outstanding")


@query("v08_po_header_open", """
    select o.id, o.po_number, o.supplier_id, s.name supplier_name, o.status po_status, o.order_date, o.expected_date,
           cast(sum(greatest(l.qty_ordered-l.qty_received,0)) as double) total_qty_outstanding,
           cast(sum(greatest(l.qty_ordered-l.qty_received,0)*l.price_per_uom) as double) total_amount_outstanding
    from {purchase_order} o join {supplier} s on s.id=o.supplier_id and not s.is_deleted
    join {purchase_order_line} l on l.purchase_order_id=o.id and not l.is_deleted
    where not o.is_deleted and o.status in ('DRAFT','APPROVED') group by all
    having sum(greatest(l.qty_ordered-l.qty_received,0))>0""")
def _(t, spark, folder):
    return doubles(views.po_header_open(t), "total_qty_outstanding", "total_amount_outstanding")


LINE_HELD = """
    select l.id so_line_id, l.sales_order_id, l.line_no, l.product_id,
           cast(sum(case when not r.is_deleted and r.status in ('OPEN','PICKED') then r.qty_reserved-r.qty_picked else 0 end) as double) qty_reserved_open,
           cast(sum(case when not r.is_deleted then r.qty_picked else 0 end) as double) qty_picked_total
    from {sales_order_line} l left join {reservation} r on r.so_line_id=l.id where not l.is_deleted group by all"""


@query("v09_so_line_reservations", LINE_HELD)
def _(t, spark, folder):
    return doubles(views.so_line_reservations(t), "qty_reserved_open", "qty_picked_total")


@query("v10_so_line_open", """
    select l.id, l.sales_order_id, o.so_number, o.customer_id, c.name customer_name, o.status so_status, o.order_date, l.line_no, l.product_id,
           p.sku product_sku, p.name product_name, l.uom_id, u.code uom_code, cast(l.qty_ordered as double) qty_ordered,
           coalesce(h.qty_reserved_open,0) qty_reserved_open, greatest(l.qty_ordered-coalesce(h.qty_reserved_open,0),0) qty_to_reserve
    from {sales_order_line} l join {sales_order} o on o.id=l.sales_order_id and not o.is_deleted and o.status in ('DRAFT','APPROVED','PART_SHIPPED')
    join {customer} c on c.id=o.customer_id and not c.is_deleted join {product} p on p.id=l.product_id and not p.is_deleted
    join {unit_of_measure} u on u.id=l.uom_id left join {line_held} h on h.so_line_id=l.id
    where not l.is_deleted and greatest(l.qty_ordered-coalesce(h.qty_reserved_open,0),0)>0""", line_held=LINE_HELD)
def _(t, spark, folder):
    return doubles(views.so_line_open(t), "qty_ordered", "qty_reserved_open", "qty_to_reserve")


@query("v11_picklist_detail", """
    select i.id, i.picklist_id, k.warehouse_id, k.status picklist_status, i.reservation_id, i.bin_id, b.code bin_code, i.product_id,
           p.sku product_sku, p.name product_name, i.lot_id, l.lot_code, cast(i.qty_to_pick as double) qty_to_pick,
           cast(i.qty_picked as double) qty_picked, i.status pick_item_status
    from {pick_item} i join {picklist} k on k.id=i.picklist_id and not k.is_deleted join {product} p on p.id=i.product_id and not p.is_deleted
    left join {warehouse_bin} b on b.id=i.bin_id and not b.is_deleted left join {lot} l on l.id=i.lot_id and not l.is_deleted
    where not i.is_deleted""")
def _(t, spark, folder):
    return doubles(views.picklist_detail(t), "qty_to_pick", "qty_picked")


@query("v12_shipment_detail", """
    select s.id shipment_id, s.shipment_number, s.sales_order_id, o.so_number, s.warehouse_id, s.carrier_id, c.name carrier_name, s.tracking_no,
           s.ship_date, i.id shipment_item_id, i.product_id, p.sku product_sku, p.name product_name, i.lot_id, l.lot_code,
           cast(i.qty_shipped as double) qty_shipped
    from {shipment} s join {sales_order} o on o.id=s.sales_order_id and not o.is_deleted left join {carrier} c on c.id=s.carrier_id
    join {shipment_item} i on i.shipment_id=s.id and not i.is_deleted join {product} p on p.id=i.product_id and not p.is_deleted
    left join {lot} l on l.id=i.lot_id and not l.is_deleted where not s.is_deleted""")
def _(t, spark, folder):
    return doubles(views.shipment_detail(t), "qty_shipped")


@query("v13_package_detail", """
    select k.id package_id, k.package_no, k.sales_order_id, o.so_number, k.warehouse_id, k.shipment_id, k.status package_status,
           cast(k.weight_kg as double) weight_kg, k.dims, i.id package_item_id, i.product_id, p.sku product_sku, p.name product_name,
           i.lot_id, l.lot_code, cast(i.qty as double) qty
    from {package} k join {sales_order} o on o.id=k.sales_order_id and not o.is_deleted
    join {package_item} i on i.package_id=k.id and not i.is_deleted join {product} p on p.id=i.product_id and not p.is_deleted
    left join {lot} l on l.id=i.lot_id and not l.is_deleted where not k.is_deleted""")
def _(t, spark, folder):
    return doubles(views.package_detail(t), "weight_kg", "qty")


@query("v14_transfer_line_open", """
    select i.id, i.transfer_order_id, h.transfer_number, h.from_warehouse_id, h.to_warehouse_id, h.status transfer_status, h.requested_at,
           i.product_id, p.sku product_sku, p.name product_name, i.lot_id, l.lot_code, cast(i.qty as double) qty
    from {transfer_order_line} i join {transfer_order} h on h.id=i.transfer_order_id and not h.is_deleted and h.status in ('DRAFT','IN_TRANSIT')
    join {product} p on p.id=i.product_id and not p.is_deleted left join {lot} l on l.id=i.lot_id and not l.is_deleted
    where not i.is_deleted""")
def _(t, spark, folder):
    return doubles(views.transfer_line_open(t), "qty")


RUNNING = """
    select id, ts, warehouse_id, bin_id, product_id, lot_id, reason, ref_type, ref_id, cast(qty_delta as double) qty_delta,
           cast(sum(qty_delta) over (partition by warehouse_id, bin_id, product_id, lot_id order by ts, id
                rows between unbounded preceding and current row) as double) running_qty
    from {inventory_tx}"""


@query("v15_inventory_tx_running", RUNNING)
def _(t, spark, folder):
    return doubles(views.inventory_tx_running(t), "qty_delta", "running_qty")


BOM_ACTIVE = f"""
    select id bom_id, parent_product_id, revision, effective_from, effective_to from {{bom}}
    where not is_deleted and (effective_from is null or effective_from<=date'{AS_OF}') and (effective_to is null or effective_to>=date'{AS_OF}')"""


@query("v16_bom_active", BOM_ACTIVE)
def _(t, spark, folder):
    return views.bom_active(t, F.lit(AS_OF).cast("date"))


@query("v17_bom_flat_active", """
    with recursive edge as (
      select b.bom_id, b.parent_product_id, i.component_product_id, i.qty_per from {bom_active} b join {bom_item} i on i.bom_id=b.bom_id),
    walk as (
      select bom_id, parent_product_id, component_product_id, qty_per total_qty_per, 1 as level, [parent_product_id, component_product_id] path from edge
      union all
      select w.bom_id, w.parent_product_id, e.component_product_id, cast(w.total_qty_per*e.qty_per as decimal(18,6)), w.level+1,
             list_append(w.path, e.component_product_id)
      from walk w join edge e on e.parent_product_id=w.component_product_id where not list_contains(w.path, e.component_product_id))
    select bom_id, parent_product_id, component_product_id, cast(total_qty_per as double) total_qty_per, level from walk""", bom_active=BOM_ACTIVE)
def _(t, spark, folder):
    return doubles(views.bom_flat_active(t, F.lit(AS_OF).cast("date")), "total_qty_per")


TOKEN_RULE = """
    list_distinct([w||'/{1}' for w in string_split_regex(lower(strip_accents({0})), '[^a-z0-9]+') if w<>''])"""


def token_list(*weighted):
    lists = [TOKEN_RULE.format(text, weight) for weight, text in weighted]
    return "list_distinct(" + (lists[0] if len(lists) == 1 else f"list_concat({', '.join(lists)})") + ")"


CATALOG = f"""
    select 'product' entity_type, cast(id as varchar) entity_id, sku||' '||name label, {token_list(('A', 'sku'), ('B', 'name'))} tokens
      from {{product}} where not is_deleted
    union all select 'customer', cast(id as varchar), name, {token_list(('A', 'name'), ('D', "coalesce(tax_id,'')"))} from {{customer}} where not is_deleted
    union all select 'supplier', cast(id as varchar), name, {token_list(('A', 'name'), ('D', "coalesce(tax_id,'')"))} from {{supplier}} where not is_deleted
    union all select 'warehouse', cast(id as varchar), code||' '||name, {token_list(('A', 'code'), ('B', 'name'))} from {{warehouse}} where not is_deleted
    union all select 'lot', cast(id as varchar), lot_code, {token_list(('D', 'lot_code'))} from {{lot}} where not is_deleted
    union all select 'address', cast(id as varchar), coalesce(line1,'')||' '||coalesce(city,'')||' '||coalesce(postal_code,''),
      {token_list(('D', "concat_ws(' ', coalesce(line1,''), coalesce(line2,''), coalesce(city,''), coalesce(region,''), coalesce(postal_code,''), coalesce(country_code,''))"))}
      from {{address}}"""


@query("v18_search_catalog", "select entity_type, entity_id, label, unnest(tokens) as token from {catalog}", catalog=CATALOG)
def _(t, spark, folder):
    return views.search_catalog(t).select(
        "entity_type", "entity_id", "label", F.explode(F.transform("tokens", lambda x: F.concat_ws("/", x["token"], x["weight"]))).alias("token")
    )
