"""Oracle pairs for sources and sinks, predicates, joins, aggregates, top-1 rows and scalar functions."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from checks.documents import CHOSEN_PICKLIST, FIRST_RESERVATION, LATEST_SHIPMENT, requests_for_all, stored_documents
from checks.jobs import run_time, asked
from checks.registry import AS_OF, RUN_TS, doubles, query
from checks.views import AVAILABLE, BUCKETS, CATALOG, HELD
from stockloom.functions import keys, predicates, text, units
from stockloom import model
from stockloom.model import BUCKET, REFERENCES, SCHEMAS
from stockloom.operators.firsts import greatest_by, least_by
from stockloom.operators.hierarchy import tree_paths
from stockloom.operators.lookup import columns_of
from stockloom.operators.running import ranks, running_totals
from stockloom.plans import documents, metrics, quality, search, views
from stockloom.plans.jobs import reserving
from stockloom.session import shared_folder, staged
from stockloom.sources import tables, writers
from stockloom.sources.fixtures import derived_columns
from stockloom.sources.ledger_store import LedgerStore

# --- sources and sinks ----------------------------------------------------------------------------


@query("s01_read_table", "select id, so_number, customer_id, status, order_date, due_date, currency, is_deleted from {sales_order}")
def _(t, spark, folder):
    return t["sales_order"]


@query("s02_filter_equals", "select id, sales_order_id, line_no from {sales_order_line} where line_no=3")
def _(t, spark, folder):
    return tables.where_equals(t["sales_order_line"], line_no=3).select("id", "sales_order_id", "line_no")


@query("s02_filter_by_keys", "select id, sales_order_id from {sales_order_line} where sales_order_id in (select id from {sales_order} where status='DRAFT')")
def _(t, spark, folder):
    return tables.where_in_keys(t["sales_order_line"], t["sales_order"].filter("status = 'DRAFT'").select("id"), "sales_order_id").select("id", "sales_order_id")


WANTED = "select o_orderkey*2 sales_order_id from {src_orders}"


@query("s03_found_and_missing", """
    select w.sales_order_id, o.id is not null found from {wanted} w left join
    (select o.id from {sales_order} o join {customer} c on c.id=o.customer_id and not c.is_deleted where not o.is_deleted) o on o.id=w.sales_order_id""",
    wanted=WANTED)
def _(t, spark, folder):
    wanted = asked(spark, t, folder, WANTED)
    docs = staged(documents.order_fulfillment_doc(t, wanted).select("sales_order_id"), "documents-at-hand")  # both halves read them
    found, missing = tables.found_and_missing(docs, wanted, "sales_order_id")
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("s04_lookup_or_null", "select w.sales_order_id id, o.so_number from {wanted} w left join {sales_order} o on o.id=w.sales_order_id", wanted=WANTED)
def _(t, spark, folder):
    return tables.lookup_or_null(t["sales_order"].select("id", "so_number"), asked(spark, t, folder, WANTED), "id")


@query("s05_upsert_documents", f"""
    with doc as (select o.id, o.so_number, o.currency from {{sales_order}} o join {{customer}} c on c.id=o.customer_id and not c.is_deleted where not o.is_deleted)
    select coalesce(d.id, n.id) _id, d.so_number "soNumber", case when n.id is not null then n.currency else d.currency end currency, n.note
    from doc d full join (select id+7 id, case when id%3=0 then null else 'GBP' end currency, 'seen' note from {{sales_order}} where id%4=0) n on n.id=d.id""")
def _(t, spark, folder):
    stored = stored_documents(t).select("_id", "soNumber", "currency")
    incoming = t["sales_order"].filter("id % 4 = 0").select(
        (F.col("id") + 7).alias("_id"), F.when(F.col("id") % 3 != 0, F.lit("GBP")).alias("currency"), F.lit("seen").alias("note")
    )
    target = f"{shared_folder(spark)}/stockloom/{spark.sparkContext.applicationId}/documents-{os.urandom(6).hex()}"
    writers.publish(stored, target)
    writers.publish(writers.upsert_rows(writers.latest(spark, target), incoming, ["_id"]), target)
    return writers.latest(spark, target)


@query("s06_insert_ignore", """
    select id, currency from {sales_order} union all
    select o_orderkey+5000000 id, 'NEW' from {src_orders} where o_orderkey%2=1""")
def _(t, spark, folder):
    new = asked(spark, t, folder, "select case when o_orderkey%2=0 then o_orderkey else o_orderkey+5000000 end id, 'NEW' currency from {src_orders}")
    return writers.insert_ignore(t["sales_order"].select("id", "currency"), new, ["id"])


@query("s07_upsert_columns", """
    select coalesce(i.warehouse_id, n.warehouse_id) warehouse_id, coalesce(i.bin_id, n.bin_id) bin_id, coalesce(i.product_id, n.product_id) product_id,
           coalesce(i.lot_id, n.lot_id) lot_id, cast(case when n.product_id is not null then n.qty else i.qty_on_hand end as double) qty_on_hand,
           coalesce(i.is_deleted, n.is_deleted) is_deleted
    from {inventory} i full join (select distinct warehouse_id, bin_id, product_id, lot_id, cast(7 as decimal(18,3)) qty, true is_deleted from {reservation}) n
      on i.warehouse_id=n.warehouse_id and i.product_id=n.product_id and i.bin_id is not distinct from n.bin_id and i.lot_id is not distinct from n.lot_id""")
def _(t, spark, folder):
    incoming = t["reservation"].select(*BUCKET).distinct().withColumns(
        {"qty_on_hand": F.lit(7).cast("decimal(18,3)"), "is_deleted": F.lit(True)}
    )
    merged = writers.upsert_rows(t["inventory"].drop("id"), incoming, BUCKET, update=["qty_on_hand"])
    return doubles(merged, "qty_on_hand")


@query("s08_insert_from_query", """
    select id, cast(qty_picked as double) qty_shipped from {pick_item} where qty_picked>0 and not is_deleted
    union all select id, cast(qty_shipped as double) from {shipment_item}""")
def _(t, spark, folder):
    target = f"{shared_folder(spark)}/stockloom/{spark.sparkContext.applicationId}/appended-{os.urandom(6).hex()}"
    writers.append_rows(t["shipment_item"].select("id", "qty_shipped"), target)
    writers.append_rows(tables.active(t["pick_item"]).filter("qty_picked > 0").select("id", F.col("qty_picked").alias("qty_shipped")), target)
    return doubles(spark.read.parquet(target), "qty_shipped")


@query("s09_camel_columns", """select id, picklist_id "picklistId", reservation_id "reservationId", status from {pick_item}""")
def _(t, spark, folder):
    renamed = tables.camel_columns(t["pick_item"].select("id", "picklist_id", "reservation_id", "status"))
    return tables.camel_columns(tables.snake_columns(renamed))


@query("s10_purge", """
    select 'sales_order' tbl, count(*) n_left from {sales_order} where id%7<>2
    union all select 'sales_order_line', count(*) from {sales_order_line} where sales_order_id%7<>2
    union all select 'shipment', count(*) from {shipment} where id%7<>2
    union all select 'shipment_item', count(*) from {shipment_item} where shipment_id%7<>2""")
def _(t, spark, folder):
    mine = F.col("id") % 7 == 2
    left = writers.purge(t, {"sales_order": mine, "shipment": mine})
    counts = [df.agg(F.count("*").alias("n_left")).withColumn("tbl", F.lit(name)) for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("s11_active_rows", "select id, status from {shipment_item} join (select id sid, 'x' status from {shipment}) s on sid=shipment_id where not is_deleted")
def _(t, spark, folder):
    items = tables.active(t["shipment_item"])
    return items.join(t["shipment"].select(F.col("id").alias("shipment_id"), F.lit("x").alias("status")), "shipment_id").select("id", "status")


# --- predicates -----------------------------------------------------------------------------------


@query("p01_soft_delete_placement", """
    select i.id, b.code bin_code from {inventory} i left join {warehouse_bin} b on b.id=i.bin_id and not b.is_deleted where not i.is_deleted""")
def _(t, spark, folder):
    return tables.active(t["inventory"]).join(columns_of(t["warehouse_bin"], "bin_id", bin_code="code"), "bin_id", "left").select("id", "bin_code")


@query("p02_status_in_set", "select id, status from {sales_order} where status in ('DRAFT','APPROVED','PART_SHIPPED')")
def _(t, spark, folder):
    return t["sales_order"].filter(predicates.in_status("status", predicates.SO_OPEN)).select("id", "status")


PAIRS = "select r.id reservation_id, i.id inventory_id from {reservation} r join {inventory} i on i.warehouse_id=r.warehouse_id and i.product_id=r.product_id"


@query("p03_null_safe_equality", PAIRS + " and i.bin_id is not distinct from r.bin_id and i.lot_id is not distinct from r.lot_id")
def _(t, spark, folder):
    matched = t["reservation"].alias("r").join(t["inventory"].alias("i"), predicates.all_same("r", "i", BUCKET))
    return matched.select(F.col("r.id").alias("reservation_id"), F.col("i.id").alias("inventory_id"))


@query("p04_null_safe_inequality", "select i.id from {pick_item} i join {reservation} r on r.id=i.reservation_id where i.lot_id is distinct from r.bin_id")
def _(t, spark, folder):
    bins = t["reservation"].select(F.col("id").alias("reservation_id"), F.col("bin_id").alias("reserved_bin"))
    return t["pick_item"].join(bins, "reservation_id").filter(predicates.differs(F.col("lot_id"), F.col("reserved_bin"))).select("id")


@query("p05_three_way_filter", """
    select * from {available} where warehouse_id=2 and bin_id is null""", available=AVAILABLE, buckets=BUCKETS, held=HELD)
def _(t, spark, folder):
    return doubles(views.inventory_available(t, warehouse_id=2, bin_id=None), "qty_on_hand", "qty_available")


@query("p06_effective_dates", f"""
    select id from {{bom}} where (effective_from is null or effective_from<=date'{AS_OF}') and (effective_to is null or effective_to>=date'{AS_OF}')""")
def _(t, spark, folder):
    return t["bom"].filter(predicates.effective_on(F.lit(AS_OF).cast("date"), "effective_from", "effective_to")).select("id")


@query("p07_clamped_filter", """
    select id, cast(greatest(qty_ordered-qty_received,0) as double) outstanding from {purchase_order_line} where greatest(qty_ordered-qty_received,0)>0""")
def _(t, spark, folder):
    rest = predicates.remainder(F.col("qty_ordered"), F.col("qty_received"))
    return doubles(t["purchase_order_line"].withColumn("outstanding", rest).filter("outstanding > 0").select("id", "outstanding"), "outstanding")


@query("p08_not_in_array", """
    select e.bom_id, e.component_product_id from {bom_item} e join {bom} b on b.id=e.bom_id where not list_contains([b.parent_product_id, 2*b.parent_product_id], e.component_product_id)""")
def _(t, spark, folder):
    edges = t["bom_item"].join(columns_of(t["bom"], "bom_id", live=False, parent="parent_product_id"), "bom_id")
    path = F.array(F.col("parent"), F.col("parent") * 2)
    return edges.filter(predicates.not_among(F.col("component_product_id"), path)).select("bom_id", "component_product_id")


@query("p09_no_open_children", """
    select id from {picklist} k where not exists (select 1 from {pick_item} i where i.picklist_id=k.id and not i.is_deleted and i.status<>'PICKED')""")
def _(t, spark, folder):
    waiting = tables.active(t["pick_item"]).filter("status <> 'PICKED'").select(F.col("picklist_id").alias("id"))
    return t["picklist"].join(waiting, "id", "left_anti").select("id")


@query("p10_null_free_columns", f"""
    select id, coalesce(cast(bin_id as varchar),'{keys.ZERO_ID}') bin_id_norm, coalesce(cast(lot_id as varchar),'{keys.ZERO_ID}') lot_id_norm from {{inventory}}""")
def _(t, spark, folder):
    return t["inventory"].select("id", keys.without_null("bin_id").alias("bin_id_norm"), keys.without_null("lot_id").alias("lot_id_norm"))


@query("p11_insert_defaults", f"""
    select id, coalesce(nullif(status,'OPEN'),'OPEN') status, cast(0 as double) qty_picked, false is_deleted, timestamp'{RUN_TS}' created_at from {{reservation}}""")
def _(t, spark, folder):
    bare = t["reservation"].select("id", F.when(F.col("status") != "OPEN", F.col("status")).alias("status"))
    return doubles(tables.with_defaults(bare, "reservation", run_time()), "qty_picked")


@query("p12_touch_changed", f"select id, case when status='DRAFT' then timestamp'{RUN_TS}' end updated_at from {{sales_order}}")
def _(t, spark, folder):
    return tables.touched(t["sales_order"], F.col("status") == "DRAFT", run_time()).select("id", "updated_at")


@query("p13_lower_email", "select id, lower(email) email from {app_user}")
def _(t, spark, folder):
    return tables.lowered(t["app_user"], "app_user").select("id", "email")


# --- joins ----------------------------------------------------------------------------------------


@query("j01_inner_dimension", """
    select l.id, u.code from {sales_order_line} l join {unit_of_measure} u on u.id=l.uom_id join {product} p on p.id=l.product_id and not p.is_deleted""")
def _(t, spark, folder):
    return (
        t["sales_order_line"].join(columns_of(t["unit_of_measure"], "uom_id", live=False, code="code"), "uom_id")
        .join(columns_of(t["product"], "product_id"), "product_id").select("id", "code")
    )


@query("j02_left_live_lookup", "select s.id, c.name from {shipment} s left join {customer} c on c.id=s.sales_order_id and not c.is_deleted")
def _(t, spark, folder):
    return t["shipment"].join(columns_of(t["customer"], "sales_order_id", name="name"), "sales_order_id", "left").select("id", "name")


@query("j03_null_safe_bucket", """
    select i.id, h.qty_reserved_open from {inventory} i left join {held} h on h.warehouse_id=i.warehouse_id and h.product_id=i.product_id
      and h.bin_id is not distinct from i.bin_id and h.lot_id is not distinct from i.lot_id""", held=HELD)
def _(t, spark, folder):
    joined = t["inventory"].alias("i").join(views.reservation_open(t).alias("h"), predicates.all_same("i", "h", BUCKET), "left")
    return doubles(joined.select("i.id", "qty_reserved_open"), "qty_reserved_open")


@query("j04_left_aggregate", """
    select l.id, cast(coalesce(r.q,0) as double) reserved from {sales_order_line} l
    left join (select so_line_id, sum(qty_reserved) q from {reservation} group by 1) r on r.so_line_id=l.id""")
def _(t, spark, folder):
    sums = t["reservation"].groupBy(F.col("so_line_id").alias("id")).agg(F.sum("qty_reserved").alias("q"))
    return doubles(t["sales_order_line"].join(sums, "id", "left").select("id", F.coalesce("q", F.lit(0)).alias("reserved")), "reserved")


@query("j05_left_conditional_sum", """
    select l.sales_order_id, cast(sum(case when r.status='PICKED' then r.qty_picked else 0 end) as double) picked
    from {sales_order_line} l left join {reservation} r on r.so_line_id=l.id group by 1""")
def _(t, spark, folder):
    picked = F.when(F.col("status") == "PICKED", F.col("qty_picked")).otherwise(F.lit(0))
    rows = t["sales_order_line"].select(F.col("id").alias("so_line_id"), "sales_order_id").join(t["reservation"], "so_line_id", "left")
    return doubles(rows.groupBy("sales_order_id").agg(F.sum(picked).alias("picked")), "picked")


@query("j06_children_per_parent", """
    select s.id, x.n, cast(x.q as double) q from {shipment} s left join lateral
      (select nullif(count(*),0) n, sum(qty_shipped) q from {shipment_item} i where i.shipment_id=s.id and not i.is_deleted) x on true""")
def _(t, spark, folder):
    items = tables.active(t["shipment_item"]).groupBy(F.col("shipment_id").alias("id")).agg(F.count("*").alias("n"), F.sum("qty_shipped").alias("q"))
    return doubles(t["shipment"].select("id").join(items, "id", "left"), "q")


@query("j07_nested_children", """
    select o.id, cast(x.held as double) held from {sales_order} o left join lateral
      (select sum(y.q) held from {sales_order_line} l left join lateral
         (select sum(r.qty_reserved) q from {reservation} r where r.so_line_id=l.id and not r.is_deleted) y on true
       where l.sales_order_id=o.id and not l.is_deleted) x on true""")
def _(t, spark, folder):
    per_line = tables.active(t["reservation"]).groupBy(F.col("so_line_id").alias("id")).agg(F.sum("qty_reserved").alias("q"))
    per_order = tables.active(t["sales_order_line"]).join(per_line, "id", "left").groupBy(F.col("sales_order_id").alias("id")).agg(F.sum("q").alias("held"))
    return doubles(t["sales_order"].select("id").join(per_order, "id", "left"), "held")


@query("j08_lateral_first", "select o.id, s.id shipment_id, s.warehouse_code from {sales_order} o left join {latest} s on s.sales_order_id=o.id", latest=LATEST_SHIPMENT)
def _(t, spark, folder):
    chosen = documents.document_shipments(t).select(F.col("sales_order_id").alias("id"), "shipment_id", "warehouse_code")
    return t["sales_order"].select("id").join(chosen, "id", "left")


@query("j09_scalar_subquery", "select sales_order_id, picklist_id, warehouse_id, status from {chosen}", chosen=CHOSEN_PICKLIST)
def _(t, spark, folder):
    return documents.document_picklists(t).select("sales_order_id", "picklist_id", "warehouse_id", "status")


@query("j10_select_list_subquery", """
    select k.id, (select string_agg(cast(i.id as varchar), ',' order by i.id) from {pick_item} i where i.picklist_id=k.id and not i.is_deleted) items from {picklist} k""")
def _(t, spark, folder):
    items = tables.active(t["pick_item"]).groupBy(F.col("picklist_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.col("id"))), ",").alias("items"))
    return t["picklist"].select("id").join(items, "id", "left")


@query("j11_semi_and_anti", """
    select id, id in (select sales_order_id from {shipment}) shipped from {sales_order}""")
def _(t, spark, folder):
    keys_ = t["shipment"].select(F.col("sales_order_id").alias("id"))
    ids = t["sales_order"].select("id")
    return ids.join(keys_, "id", "left_semi").withColumn("shipped", F.lit(True)).unionByName(
        ids.join(keys_, "id", "left_anti").withColumn("shipped", F.lit(False))
    )


@query("j12_self_join", "select c.id, p.name parent_name from {product_category} c join {product_category} p on p.id=c.parent_id")
def _(t, spark, folder):
    parents = columns_of(t["product_category"], "parent_id", live=False, parent_name="name")
    return t["product_category"].join(parents, "parent_id").select("id", "parent_name")


# --- aggregates -----------------------------------------------------------------------------------


@query("a01_sum_by_nullable_keys", "select bin_id, lot_id, cast(sum(qty_reserved) as double) q from {reservation} group by bin_id, lot_id")
def _(t, spark, folder):
    return doubles(t["reservation"].groupBy("bin_id", "lot_id").agg(F.sum("qty_reserved").alias("q")), "q")


@query("a02_sum_having", """
    select purchase_order_id, cast(sum(greatest(qty_ordered-qty_received,0)*price_per_uom) as double) amount from {purchase_order_line}
    group by 1 having sum(greatest(qty_ordered-qty_received,0))>0""")
def _(t, spark, folder):
    rest = predicates.remainder(F.col("qty_ordered"), F.col("qty_received"))
    sums = t["purchase_order_line"].groupBy("purchase_order_id").agg(F.sum(rest).alias("q"), F.sum(rest * F.col("price_per_uom")).alias("amount"))
    return doubles(sums.filter("q > 0").drop("q"), "amount")


@query("a03_conditional_sums", """
    select warehouse_id, cast(sum(case when qty_delta>0 then qty_delta else 0 end) as double) inward,
           cast(sum(case when qty_delta<0 then qty_delta else 0 end) as double) outward from {inventory_tx} group by 1""")
def _(t, spark, folder):
    def only(condition):
        return F.sum(F.when(condition, F.col("qty_delta")).otherwise(F.lit(0)))

    sums = t["inventory_tx"].groupBy("warehouse_id").agg(only(F.col("qty_delta") > 0).alias("inward"), only(F.col("qty_delta") < 0).alias("outward"))
    return doubles(sums, "inward", "outward")


@query("a04_sum_or_zero", """
    select p.id, cast(coalesce(sum(i.qty_on_hand),0) as double) on_hand from {product} p left join {inventory} i on i.product_id=p.id and not i.is_deleted group by 1""")
def _(t, spark, folder):
    sums = tables.active(t["inventory"]).groupBy(F.col("product_id").alias("id")).agg(F.sum("qty_on_hand").alias("q"))
    return doubles(t["product"].select("id").join(sums, "id", "left").select("id", F.coalesce("q", F.lit(0)).alias("on_hand")), "on_hand")


@query("a05_count_if", "select purchase_order_id, count(*) filter (where not is_deleted and qty_received<qty_ordered) n_short from {purchase_order_line} group by 1")
def _(t, spark, folder):
    return t["purchase_order_line"].groupBy("purchase_order_id").agg(F.count_if(F.expr("not is_deleted and qty_received < qty_ordered")).alias("n_short"))


@query("a06_next_line_number", "select sales_order_id, coalesce(max(line_no),0)+1 next_no from {sales_order_line} group by 1")
def _(t, spark, folder):
    return t["sales_order_line"].groupBy("sales_order_id").agg((F.coalesce(F.max("line_no"), F.lit(0)) + 1).alias("next_no"))


@query("a07_list_or_null", """
    select s.id, case when count(i.id)=0 then null else string_agg(cast(i.id as varchar), ',' order by i.id) end items
    from {shipment} s left join {shipment_item} i on i.shipment_id=s.id and not i.is_deleted group by s.id""")
def _(t, spark, folder):
    listed = documents.document_shipment_items(
        t, shipments=t["shipment"].select(F.col("id").alias("shipment_id"), "sales_order_id")
    ).groupBy(F.col("shipment_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("items"))
    return t["shipment"].select("id").join(listed, "id", "left")


TOTALS = "select sales_order_id, sum(qty_ordered) q from {sales_order_line} where not is_deleted group by 1"


@query("a08_customer_counters", """
    select o.customer_id, count(*) orders_count, cast(sum(coalesce(s.q,0)) as double) total_qty
    from {sales_order} o left join {totals} s on s.sales_order_id=o.id where not o.is_deleted and o.status='SHIPPED' group by 1""", totals=TOTALS)
def _(t, spark, folder):
    return doubles(metrics.customer_counters(metrics.fulfilled_orders(t)), "total_qty")


@query("a08_customer_metrics", """
    select c.id customer_id, coalesce(x.n,0) orders_count, cast(coalesce(x.q,0) as double) total_qty from {customer} c left join (
      select o.customer_id, count(*) n, sum(coalesce(s.q,0)) q from {sales_order} o left join {totals} s on s.sales_order_id=o.id
      where not o.is_deleted and o.status='SHIPPED' group by 1) x on x.customer_id=c.id""", totals=TOTALS)
def _(t, spark, folder):
    counters = metrics.customer_counters(metrics.fulfilled_orders(t))
    return doubles(metrics.customer_metrics(counters, t["customer"].select(F.col("id").alias("customer_id"))), "total_qty")


@query("a09_order_totals", "select sales_order_id, cast(q as double) total_qty from {totals}", totals=TOTALS)
def _(t, spark, folder):
    return doubles(metrics.order_totals(t), "total_qty")


# --- windows and top-1 ----------------------------------------------------------------------------


@query("w01_running_total_sliced", """
    select id, cast(sum(qty_delta) over (partition by warehouse_id order by ts, id rows unbounded preceding) as double) running from {inventory_tx}""")
def _(t, spark, folder):
    rows = t["inventory_tx"].select("id", "ts", "warehouse_id", "qty_delta")
    return doubles(running_totals(rows, ["warehouse_id"], ["ts", "id"], {"running": F.col("qty_delta")}, rows=5_000).select("id", "running"), "running")


@query("w01_rank_sliced", "select id, row_number() over (partition by product_id order by id) rank from {sales_order_line}")
def _(t, spark, folder):
    return ranks(t["sales_order_line"].select("id", "product_id"), ["product_id"], ["id"], "rank", rows=200).select("id", "rank")


@query("t01_latest_shipment", "select sales_order_id, id, ship_date from {latest}", latest=LATEST_SHIPMENT)
def _(t, spark, folder):
    rank = [F.col("ship_date").isNull(), F.col("ship_date"), F.col("id")]
    return greatest_by(tables.active(t["shipment"]), ["sales_order_id"], rank, ["id", "ship_date"])


@query("t02_first_reservation", "select sales_order_id, reservation_id, warehouse_id from {first}", first=FIRST_RESERVATION)
def _(t, spark, folder):
    rows = documents.document_reservations(t).withColumnRenamed("id", "reservation_id")
    return least_by(rows, ["sales_order_id"], [F.col("created_at"), F.col("reservation_id")], ["reservation_id", "warehouse_id"])


@query("t03_any_picklist", """
    select l.sales_order_id, min(i.picklist_id) picklist_id from {pick_item} i join {reservation} r on r.id=i.reservation_id join {sales_order_line} l on l.id=r.so_line_id
    where i.picklist_id in (select id from {picklist} where not is_deleted) group by 1""")
def _(t, spark, folder):
    return documents.document_picklists(t).select("sales_order_id", "picklist_id")


@query("u01_union_all", """
    select 'customer' kind, id from {customer} union all select 'supplier', id from {supplier} union all select 'product', id from {product}""")
def _(t, spark, folder):
    parts = [t[name].select(F.lit(name).alias("kind"), F.col("id")) for name in ("customer", "supplier", "product")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u02_tree_depths", """
    with recursive walk as (select id, 0 depth from {product_category} where parent_id is null and not is_deleted
      union all select k.id, w.depth+1 from {product_category} k join walk w on k.parent_id=w.id where not k.is_deleted)
    select depth, count(*) n from walk group by depth""")
def _(t, spark, folder):
    return views.category_path(t).groupBy("depth").agg(F.count("*").alias("n"))


CHAIN = """
    select id, concat('C', cast(id as string)) code, concat('Name ', cast(id as string)) name,
           case when id%97=0 then null when id%1000=13 then id when id%500=499 then id+100000000 else id-1 end parent_id
    from {product}"""


@query("u02_deep_tree_paths", """
    with recursive walk as (select id, code path_code, name path_name, 0 depth from {chain} where parent_id is null
      union all select k.id, w.path_code || '/' || k.code, w.path_name || '/' || k.name, w.depth+1 from {chain} k join walk w on k.parent_id=w.id)
    select id, path_code, path_name, depth from walk""", chain=CHAIN)
def _(t, spark, folder):
    return tree_paths(asked(spark, t, folder, CHAIN)).select("id", "path_code", "path_name", "depth")


@query("u03_graph_levels", """
    with recursive edge as (select b.parent_product_id p, i.component_product_id c, b.id from {bom} b join {bom_item} i on i.bom_id=b.id where not b.is_deleted
        and (b.effective_to is null or b.effective_to>=date'2024-06-30') and (b.effective_from is null or b.effective_from<=date'2024-06-30')),
    walk as (select id, c, 1 as level, [p,c] path from edge
      union all select w.id, e.c, w.level+1, list_append(w.path, e.c) from walk w join edge e on e.p=w.c where not list_contains(w.path, e.c))
    select level, count(*) n from walk group by level""")
def _(t, spark, folder):
    return views.bom_flat_active(t, F.lit(AS_OF).cast("date")).groupBy("level").agg(F.count("*").alias("n"))


# --- scalar functions -----------------------------------------------------------------------------


@query("f01_convert_qty", """
    select l.id, cast(case when l.uom_id=p.base_uom_id then l.qty else l.qty*c.factor end as double) base_qty
    from {transfer_order_line} l join {product} p on p.id=l.product_id left join {uom_conversion} c on c.from_uom_id=l.uom_id and c.to_uom_id=p.base_uom_id""")
def _(t, spark, folder):
    rows = t["transfer_order_line"].join(columns_of(t["product"], "product_id", live=False, base="base_uom_id"), "product_id")
    return doubles(units.converted(rows, t["uom_conversion"], "qty", "uom_id", "base", "base_qty").select("id", "base_qty"), "base_qty")


@query("f02_available_qty", """
    select i.warehouse_id, i.bin_id, i.product_id, i.lot_id, cast(greatest(i.q-coalesce(h.qty_reserved_open,0),0) as double) available
    from (select warehouse_id, bin_id, product_id, lot_id, sum(qty_on_hand) q from {inventory} where not is_deleted group by all) i
    left join {held} h on h.warehouse_id=i.warehouse_id and h.product_id=i.product_id and h.bin_id is not distinct from i.bin_id
      and h.lot_id is not distinct from i.lot_id""", held=HELD)
def _(t, spark, folder):
    return doubles(reserving.available_per_bucket(t).select("bucket.*", "available"), "available")


@query("f03_greatest_coalesce", "select id, greatest(warehouse_id, bin_id) g, coalesce(bin_id, lot_id, -1) c from {reservation}")
def _(t, spark, folder):
    return t["reservation"].select("id", F.greatest("warehouse_id", "bin_id").alias("g"), F.coalesce("bin_id", "lot_id", F.lit(-1)).alias("c"))


@query("f04_status_choice", "select id, case when qty_picked>=qty_to_pick then 'PICKED' else status end s from {pick_item}")
def _(t, spark, folder):
    return t["pick_item"].select("id", F.when(F.col("qty_picked") >= F.col("qty_to_pick"), F.lit("PICKED")).otherwise(F.col("status")).alias("s"))


@query("f05_concat_labels", """
    select 'address' kind, cast(id as varchar) id, coalesce(line1,'')||' '||coalesce(city,'')||' '||coalesce(postal_code,'') label from {address}
    union all select 'product', cast(id as varchar), sku||' '||name from {product} where not is_deleted""")
def _(t, spark, folder):
    catalogue = views.search_catalog(t).filter(F.col("entity_type").isin("address", "product"))
    return catalogue.select(F.col("entity_type").alias("kind"), F.col("entity_id").alias("id"), "label")


@query("f06_casts", "select id, cast(qty_ordered as double) d, cast(status as varchar) s from {sales_order_line} join (select id oid, status from {sales_order}) o on oid=sales_order_id")
def _(t, spark, folder):
    status = columns_of(t["sales_order"], "sales_order_id", live=False, s="status")
    return t["sales_order_line"].join(status, "sales_order_id").select("id", F.col("qty_ordered").cast("double").alias("d"), F.col("s").cast("string").alias("s"))


@query("f07_json_object", """
    select id, case when carrier_id is null then 'null' else cast(carrier_id as varchar) end carrier_text from {shipment}""")
def _(t, spark, folder):
    shaped = documents.as_json(t["shipment"].select("id", "carrier_id"), key="id")
    return shaped.select("id", F.regexp_extract("document", r'"carrier_id":([^,}]+)', 1).alias("carrier_text"))


@query("f08_move_keys", """
    select id, 'RECEIPT:'||id a, 'PICK:'||id b, 'TO_OUT:'||id c, 'TO_IN:'||id d, 'RMA_IN:'||id e, 'RTV_OUT:'||id f, 'ADJ:'||coalesce(cast(lot_id as varchar),'')||':'||id g from {pick_item}""")
def _(t, spark, folder):
    named = dict(a="receipt_line", b="pick_item", c="transfer_out", d="transfer_in", e="customer_return_line", f="supplier_return_line")
    return t["pick_item"].select("id", *[keys.move_key(kind, "id").alias(n) for n, kind in named.items()], keys.move_key("adjustment", "lot_id", "id").alias("g"))


@query("f09_adjustment_reason", "select id, case when qty_delta>=0 then 'ADJUST_POS' else 'ADJUST_NEG' end reason from {inventory_tx}")
def _(t, spark, folder):
    return t["inventory_tx"].select("id", keys.adjustment_reason(F.col("qty_delta")).alias("reason"))


@query("f10_derived_ids", "select sha256('=line'||chr(31)||'='||id||chr(31)||coalesce('='||bin_id,'~')) id from {reservation}")
def _(t, spark, folder):
    return t["reservation"].select(keys.derived_id(F.lit("line"), "id", "bin_id").alias("id"))


@query("f11_unaccented", "select doc_id, strip_accents(replace(text, 'ß', 'ss')) plain from {src_documents}")
def _(t, spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", text.unaccented(F.col("text")).alias("plain"))


@query("f12_weighted_tokens", "select entity_id, count(*) n from (select entity_id, unnest(tokens) tok from {catalog} where entity_type='product') z group by 1", catalog=CATALOG)
def _(t, spark, folder):
    rows = tables.active(t["product"]).select(
        F.col("id").cast("string").alias("entity_id"), F.explode(text.search_tokens(("A", F.col("sku")), ("B", F.col("name")))).alias("tok")
    )
    return rows.groupBy("entity_id").agg(F.count("*").alias("n"))


SEARCHES = "select p_partkey query_id, p_name query from {src_part} union all select -1, 'lot 44' union all select -2, 'WH-ASIA'"
SEARCH_TERMS = """
    select query_id, len(w) n, unnest(w) token from (
      select query_id, list_distinct([x for x in string_split_regex(lower(strip_accents(query)), '[^a-z0-9]+') if x<>'']) w from {names_asked}) z"""


@query("f13_token_search", """
    with posting as (select entity_type, entity_id, string_split(unnest(tokens),'/') tw from {catalog}),
    hit as (select s.query_id, p.entity_type, p.entity_id, s.n, s.token, case tw[2] when 'A' then 1.0 when 'B' then 0.4 else 0.1 end score
            from posting p join {terms} s on s.token=p.tw[1])
    select query_id, entity_type, entity_id, cast(round(sum(score),3) as double) rank from hit group by all having count(distinct token)=max(n)
    """.replace("group by all", "group by query_id, entity_type, entity_id"), catalog=CATALOG, terms=SEARCH_TERMS,
    names_asked="select min(query_id) query_id, query from (" + SEARCHES + ") z group by query")
def _(t, spark, folder):
    asked_names = asked(spark, t, folder, SEARCHES).groupBy("query").agg(F.min("query_id").alias("query_id"))
    return search.token_search(views.search_catalog(t), asked_names).withColumn("rank", F.round("rank", 3))


GRAMS = """
    select {0}, list_distinct(flatten([[('  '||w||' ')[i:i+2] for i in range(1, len(w)+2)] for w in string_split_regex(lower(strip_accents({1})), '[^a-z0-9]+') if w<>''])) g from {2}"""


@query("f14_similar_names", """
    with n as (""" + GRAMS.format("distinct name", "name", "{product}") + """), q as (""" + GRAMS.format("query_id, query", "query", "{asked_names}") + """),
    s as (select query_id, name, len(list_intersect(n.g, q.g)) shared, len(n.g) a, len(q.g) b from n cross join q)
    select s.query_id, p.id, p.name, cast(round(shared/(a+b-shared),6) as double) similarity from s join {product} p on p.name=s.name
    where shared>0 and shared/(a+b-shared)>=0.6""",
    asked_names="select -s_suppkey query_id, case s_suppkey%3 when 0 then 'smal ring' when 1 then 'red widgets' else 'blue bolt' end query from {src_supplier}")
def _(t, spark, folder):
    text_ = "select -s_suppkey query_id, case s_suppkey%3 when 0 then 'smal ring' when 1 then 'red widgets' else 'blue bolt' end query from {src_supplier}"
    found = search.similar_names(t["product"].select("id", "name"), asked(spark, t, folder, text_), 0.6)
    return found.withColumn("similarity", F.round("similarity", 6))


@query("f15_json_lookup", """
    select id, cast(json_extract_string(metadata,'$.size') as int) size from {product} where json_extract_string(metadata,'$.type')='ECONOMY'""")
def _(t, spark, folder):
    rows = t["product"].filter(search.json_contains("metadata", type="ECONOMY") & search.json_has("metadata", "$.size"))
    return rows.select("id", F.get_json_object("metadata", "$.size").cast("int").alias("size"))


@query("f16_document_dates", """select h.id _id, h.due_date "dueDate" from {sales_order} h join {customer} c on c.id=h.customer_id and not c.is_deleted where not h.is_deleted""")
def _(t, spark, folder):
    rows = t["sales_order"].select("id", F.date_format("due_date", "yyyy-MM-dd'T'00:00:00'Z'").alias("due_text"))
    docs = documents.to_document(documents.order_fulfillment_doc(t), requests_for_all(t), run_time()).select("_id")
    return docs.join(rows.withColumnRenamed("id", "_id"), "_id").select("_id", F.to_date(F.substring("due_text", 1, 10)).alias("dueDate"))


@query("f17_reject_classes", """
    select cast(id as varchar) request_id, case id%4 when 0 then 'INSUFFICIENT_STOCK' when 1 then 'EXCEEDS_ORDERED' when 2 then 'UNIQUE_VIOLATION' else 'FOREIGN_KEY_VIOLATION' end reject_code,
           case id%4 when 0 then 'InsufficientStock' when 1 then 'Validation' when 2 then 'Conflict' else 'NotFound' end reject_class from {pick_item}""")
def _(t, spark, folder):
    codes = F.array(*[F.lit(c) for c in ("INSUFFICIENT_STOCK", "EXCEEDS_ORDERED", "UNIQUE_VIOLATION", "FOREIGN_KEY_VIOLATION")])
    rows = t["pick_item"].select(F.col("id").cast("string").alias("request_id"), F.element_at(codes, (F.col("id") % 4 + 1).cast("int")).alias("reject_code"))
    return quality.with_class(rows)


# --- data quality ---------------------------------------------------------------------------------
# Faults are planted by expressions over whole tables, the same in both engines.

BAD_LINES = """
    select case when id%500=7 then id-1 else id end id, case when id%301=5 then -1 else sales_order_id end sales_order_id, line_no,
           case when id%401=5 then null else product_id end product_id, uom_id, qty_ordered, price_per_uom, is_deleted, timestamp'2024-01-01 00:00:00' created_at
    from {sales_order_line}"""


@query("q01_primary_key", "select cast(id as varchar) row_id, count(*) n_rows from {bad_lines} group by id having count(*)>1", bad_lines=BAD_LINES)
def _(t, spark, folder):
    return quality.primary_key(asked(spark, t, folder, BAD_LINES), "sales_order_line").select("row_id", "n_rows")


@query("q02_unique_move_keys", "select move_key row_id, count(*) n_rows from {inventory_tx} group by 1 having count(*)>1")
def _(t, spark, folder):
    return quality.repeated(t["inventory_tx"], "inventory_tx", ["move_key"]).select("row_id", "n_rows")


@query("q03_unique_buckets", """
    select concat_ws('|', cast(so_line_id%900 as varchar), cast(warehouse_id as varchar), coalesce(cast(bin_id as varchar),'-')) row_id, count(*) n_rows
    from {reservation} group by so_line_id%900, warehouse_id, bin_id having count(*)>1""")
def _(t, spark, folder):
    rows = t["reservation"].withColumn("so_line_id", F.col("so_line_id") % 900)
    return quality.repeated(rows, "reservation", ["so_line_id", "warehouse_id", "bin_id"], nulls_count=True).select("row_id", "n_rows")


@query("q04_unique_live", "select cast(name as varchar) row_id, count(*) n_rows from {product} where not is_deleted group by 1 having count(*)>1")
def _(t, spark, folder):
    return quality.repeated(tables.active(t["product"]), "product", ["name"]).select("row_id", "n_rows")


@query("q05_email_ignoring_case", "select lower(email) row_id, count(*) n_rows from {app_user} group by 1 having count(*)>1")
def _(t, spark, folder):
    return quality.email_ignoring_case(t["app_user"]).select("row_id", "n_rows")


@query("q06_foreign_keys", """
    select 'foreign_key:sales_order_id' rule, cast(id as varchar) row_id from {bad_lines} where sales_order_id not in (select id from {sales_order})
    union all select 'foreign_key:product_id', cast(id as varchar) from {bad_lines} where product_id is not null and product_id not in (select id from {product})""",
    bad_lines=BAD_LINES)
def _(t, spark, folder):
    return quality.foreign_keys(t, "sales_order_line", asked(spark, t, folder, BAD_LINES)).select("rule", "row_id")


BAD_RESERVATIONS = """
    select id, so_line_id, warehouse_id, bin_id, product_id, lot_id, qty_reserved, case when id%211=3 then qty_reserved+1 when id%223=4 then null else qty_picked end qty_picked,
           case when id%307=5 then 'LOST' else status end status, is_deleted, created_at from {reservation}"""


@query("q07_checks", "select cast(id as varchar) row_id from {bad} where qty_picked>qty_reserved", bad=BAD_RESERVATIONS)
def _(t, spark, folder):
    found = quality.row_rules(asked(spark, t, folder, BAD_RESERVATIONS), "reservation")
    return found.filter("reject_code = 'CHECK_VIOLATION'").select("row_id")


@query("q08_row_rules", """
    select 'not_null:qty_picked' rule, cast(id as varchar) row_id, 'NOT_NULL_VIOLATION' reject_code from {bad} where qty_picked is null
    union all select 'allowed:status', cast(id as varchar), 'ENUM_VIOLATION' from {bad} where status='LOST'
    union all select 'check:picked_within_reserved', cast(id as varchar), 'CHECK_VIOLATION' from {bad} where qty_picked>qty_reserved""", bad=BAD_RESERVATIONS)
def _(t, spark, folder):
    return quality.row_rules(asked(spark, t, folder, BAD_RESERVATIONS), "reservation").select("rule", "row_id", "reject_code")


def _every_rule() -> str:
    """SQL for the declared rules of all tables, over the columns that the derived tables have; counts of violations by rule."""
    found = []

    def rule(table, name, select):
        found.append(f"select '{table}' table_name, '{name}' rule, count(*) n from ({select}) x having count(*)>0")

    def repeats(table, name, columns, where, exempt):
        nulls = "".join(f" and {c} is not null" for c in columns) if exempt else ""
        rule(table, name, f"select 1 from {{{table}}} where {where}{nulls} group by {', '.join(columns)} having count(*)>1")

    for table, schema in model.SCHEMAS.items():
        columns = derived_columns(table)
        has = set(columns).issuperset
        repeats(table, "primary_key", ["id"], "true", True)
        rule(table, "primary_key", f"select count(*) from {{{table}}} where id is null having count(*)>0")
        for field in schema:
            if field.name in columns and field.name != "id":
                if not field.nullable:
                    rule(table, f"not_null:{field.name}", f"select 1 from {{{table}}} where {field.name} is null")
                if (table, field.name) in model.ALLOWED:
                    listed = ", ".join(f"'{v}'" for v in model.ALLOWED[table, field.name])
                    rule(table, f"allowed:{field.name}", f"select 1 from {{{table}}} where {field.name} not in ({listed})")
                if (table, field.name) in model.WIDTHS:
                    rule(table, f"length:{field.name}", f"select 1 from {{{table}}} where length({field.name})>{model.WIDTHS[table, field.name]}")
        for owner, name, condition in model.CHECKS:
            if owner == table:
                rule(table, f"check:{name}", f"select 1 from {{{table}}} where not ({condition})")
        for owner, c in model.UNIQUE:
            if owner == table and has(c):
                repeats(table, "unique:" + "+".join(c), c, "true", True)
        for owner, c in model.UNIQUE_GROUPS:
            if owner == table and has(c):
                repeats(table, "unique:" + "+".join(c), c, "true", False)
        for owner, c in model.UNIQUE_LIVE:
            if owner == table and has(c):
                repeats(table, "unique_live:" + "+".join(c), c, "not is_deleted", True)
        if table == "app_user":
            repeats(table, "unique:lower(email)", ["lower(email)"], "true", True)
        for r in model.REFERENCES:
            if r.child == table and r.column in columns:
                rule(table, f"foreign_key:{r.column}", f"select 1 from {{{table}}} c where {r.column} is not null and not exists (select 1 from {{{r.parent}}} p where p.id=c.{r.column})")
    return "select table_name, rule, cast(sum(n) as bigint) n from (" + " union all ".join(found) + ") v group by 1, 2"


# Tables with faults of many kinds; all other tables are as derived.
FAULTY = {
    "reservation": BAD_RESERVATIONS, "sales_order_line": BAD_LINES,
    "shipment": """select case when id%701=4 then null else id end id, shipment_number, case when id%409=2 then id+100000000 else sales_order_id end sales_order_id,
        case when id%503=3 then 77 else warehouse_id end warehouse_id, carrier_id, tracking_no, ship_date, is_deleted from {shipment}""",
}


@query("q08_all_tables", _every_rule())
def _(t, spark, folder):
    return quality.all_violations(t).groupBy("table_name", "rule").agg(F.count("*").alias("n"))


@query("q08_all_tables_faulty", _every_rule().replace("{reservation}", "{bad_reservation}").replace("{sales_order_line}", "{bad_line}").replace("{shipment}", "{bad_shipment}"),
       bad_reservation=FAULTY["reservation"], bad_line=FAULTY["sales_order_line"], bad_shipment=FAULTY["shipment"])
def _(t, spark, folder):
    bad = t.replacing(**{name: asked(spark, t, folder, text) for name, text in FAULTY.items()})
    return quality.all_violations(bad).groupBy("table_name", "rule").agg(F.count("*").alias("n"))


@query("q09_reservation_guard", """
    select cast(r.id as varchar) row_id, case when l.is_deleted or p.is_deleted then 'NOT_FOUND' when r.product_id<>l.product_id then 'PRODUCT_MISMATCH'
      when not r.is_deleted and s.q>l.qty_ordered*case when l.uom_id=2 then 12 else 1 end then 'EXCEEDS_ORDERED' when r.qty_picked>r.qty_reserved then 'CHECK_VIOLATION' end reject_code
    from {bad} r join {sales_order_line} l on l.id=r.so_line_id join {product} p on p.id=l.product_id
    left join (select so_line_id, sum(qty_reserved) q from {bad} where not is_deleted group by 1) s on s.so_line_id=l.id
    where l.is_deleted or p.is_deleted or r.product_id<>l.product_id or r.qty_picked>r.qty_reserved
       or (not r.is_deleted and s.q>l.qty_ordered*case when l.uom_id=2 then 12 else 1 end)""",
    bad="""select id, so_line_id, warehouse_id, bin_id, case when id%151=2 then product_id+1 else product_id end product_id, lot_id,
             case when id%131=3 then qty_reserved*40 else qty_reserved end qty_reserved, case when id%157=4 then qty_reserved*41 else qty_picked end qty_picked, status, is_deleted from {reservation}""")
def _(t, spark, folder):
    bad = asked(spark, t, folder, """select id, so_line_id, warehouse_id, bin_id, case when id%151=2 then product_id+1 else product_id end product_id, lot_id,
             cast(case when id%131=3 then qty_reserved*40 else qty_reserved end as decimal(18,3)) qty_reserved,
             cast(case when id%157=4 then qty_reserved*41 else qty_picked end as decimal(18,3)) qty_picked, status, is_deleted from {reservation}""")
    return quality.reservation_guard(t.replacing(reservation=bad)).select("row_id", "reject_code")


@query("q10_stock_reconciliation", """
    select coalesce(i.w, x.w) warehouse_id, coalesce(i.b, x.b) bin_id, coalesce(i.p, x.p) product_id, coalesce(i.l, x.l) lot_id,
           cast(coalesce(i.q,0) as double) qty_on_hand, cast(coalesce(x.q,0) as double) qty_ledger, coalesce(x.n,0) n_movements
    from (select warehouse_id w, bin_id b, product_id p, lot_id l, sum(qty_on_hand) q from {inventory} group by all) i
    full join (select warehouse_id w, bin_id b, product_id p, lot_id l, sum(qty_delta) q, count(*) n from {inventory_tx} group by all) x
      on i.w=x.w and i.p=x.p and i.b is not distinct from x.b and i.l is not distinct from x.l
    where coalesce(i.q,0)<>coalesce(x.q,0)""")
def _(t, spark, folder):
    return doubles(quality.stock_reconciliation(t), "qty_on_hand", "qty_ledger")


@query("q11_negative_balances", """
    select id, cast(r as double) running_qty from (select id, sum(qty_delta) over (partition by warehouse_id, bin_id, product_id, lot_id order by ts, id
      rows unbounded preceding) r from {inventory_tx}) z where r<0""")
def _(t, spark, folder):
    return doubles(quality.negative_balances(t).select("id", "running_qty"), "running_qty")


def kept_ledger(t, spark):
    """The ledger as it grew: a first batch closed in two steps, then a batch that also falls into closed days."""
    rows = t["inventory_tx"].withColumn("ts", F.col("ts").cast("timestamp"))
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    store = LedgerStore(spark, f"{shared_folder(spark)}/stockloom/{spark.sparkContext.applicationId}/ledger-{os.urandom(6).hex()}", rows.schema)
    late = F.xxhash64("id") % 5 == 0
    store.append(rows.filter(~late), 0)
    store.close((first + (last - first) / 4).date())
    store.close((first + (last - first) / 2).date())
    store.append(rows.filter(late), 1)
    return store


@query("q10_from_closing_balances", """
    select coalesce(i.w, x.w) warehouse_id, coalesce(i.b, x.b) bin_id, coalesce(i.p, x.p) product_id, coalesce(i.l, x.l) lot_id,
           cast(coalesce(i.q,0) as double) qty_on_hand, cast(coalesce(x.q,0) as double) qty_ledger, coalesce(x.n,0) n_movements
    from (select warehouse_id w, bin_id b, product_id p, lot_id l, sum(qty_on_hand) q from {inventory} group by all) i
    full join (select warehouse_id w, bin_id b, product_id p, lot_id l, sum(qty_delta) q, count(*) n from {inventory_tx} group by all) x
      on i.w=x.w and i.p=x.p and i.b is not distinct from x.b and i.l is not distinct from x.l
    where coalesce(i.q,0)<>coalesce(x.q,0)""")
def _(t, spark, folder):
    return doubles(quality.stock_reconciliation(t, kept_ledger(t, spark).balances()), "qty_on_hand", "qty_ledger")


@query("v15_after_closed_days", """
    with span as (select min(ts) a, max(ts) b from {inventory_tx}),
    r as (select id, ts, sum(qty_delta) over (partition by warehouse_id, bin_id, product_id, lot_id order by ts, id rows unbounded preceding) q from {inventory_tx})
    select id, cast(q as double) running_qty from r, span where cast(ts as date)>cast(a+(b-a)/2 as date)""")
def _(t, spark, folder):
    return doubles(kept_ledger(t, spark).running().select("id", "running_qty"), "running_qty")
