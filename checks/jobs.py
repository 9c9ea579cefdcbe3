"""Oracle pairs for the bulk jobs. Requests are derived from the driver data by SQL both engines run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import RUN_TS, doubles, query
from stockloom.model import BUCKET
from stockloom.plans.jobs import fulfil, intake, ledger, picking, receiving, reserving, shipping
from stockloom.sources.fixtures import placeholders, with_text_ids



def run_time():
    """The time every job is run at; a column, so it needs a session."""
    return F.lit(RUN_TS).cast("timestamp")

def asked(spark, t, folder, text):
    """Run a request derivation on Spark."""
    from stockloom.sources.fixtures import source

    return spark.sql(text, **{p: source(spark, folder, p[4:]) if p.startswith("src_") else t[p] for p in placeholders(text)})


def outcomes(rows, label, rejects, request="id"):
    """Accepted requests and rejects in one relation."""
    return rows.select(F.col(request).cast("string").alias("id"), F.lit(label).alias("outcome")).unionByName(
        rejects.select(F.col("request_id").alias("id"), F.col("reject_code").alias("outcome"))
    )


# --- intake ---------------------------------------------------------------------------------------

NEW_ORDERS = """
    select case when o_orderkey%4=0 then cast(o_orderkey as string) when o_orderkey%4=3 then concat('N',cast(o_orderkey-1 as string))
                else concat('N',cast(o_orderkey as string)) end id,
           o_orderkey seq, case when o_orderkey%50=2 then 'nobody' else cast(o_custkey as string) end customer_id,
           cast(o_orderdate as date) order_date, case when o_orderkey%70=1 then 'EURO' else 'EUR' end currency
    from {src_orders}"""


@query("b01_create_headers", """
    with judged as (select *, case when currency='EURO' then 'LENGTH_VIOLATION' when customer_id='nobody' then 'FOREIGN_KEY_VIOLATION' end fault from {new_orders}),
    ordered as (select *, row_number() over (partition by id, fault is null order by seq) rn from judged)
    select id, 'DRAFT' outcome from ordered where fault is null and rn=1 and id like 'N%'
    union all select id, min(fault) from ordered where fault is not null group by id""", new_orders=NEW_ORDERS)
def _(t, spark, folder):
    done = intake.create_headers(with_text_ids(t), "sales_order", asked(spark, t, folder, NEW_ORDERS), run_time())
    return done.inserts["sales_order"].select("id", F.col("status").alias("outcome")).unionByName(
        done.rejects.select(F.col("request_id").alias("id"), F.col("reject_code").alias("outcome"))
    )


NEW_SHIPMENTS = """
    select concat('N',cast(case when o_orderkey%10=9 then o_orderkey-1 else o_orderkey end as string)) id, o_orderkey seq,
           cast(o_orderkey as string) sales_order_id, cast(o_orderkey%5 as string) warehouse_id,
           case when o_orderkey%6=0 then null when o_orderkey%77=1 then '9' else cast(o_orderkey%3 as string) end carrier_id
    from {src_orders}"""


@query("b01_create_shipments", """
    with judged as (select *, carrier_id is not distinct from '9' bad from {new_shipments}),
    ordered as (select *, row_number() over (partition by id, bad order by seq) rn from judged)
    select id, 'created' outcome from ordered where not bad and rn=1
    union all select id, min(case when bad then 'FOREIGN_KEY_VIOLATION' else 'UNIQUE_VIOLATION' end) from ordered where bad or rn>1 group by id""",
    new_shipments=NEW_SHIPMENTS)
def _(t, spark, folder):
    done = intake.create_headers(with_text_ids(t), "shipment", asked(spark, t, folder, NEW_SHIPMENTS), run_time())
    return outcomes(done.inserts["shipment"], "created", done.rejects)


# Headers of the other kinds: some ids twice, some parents unknown.
def _header_requests(columns: str, bad: str, key: str = "o_orderkey", source: str = "src_orders") -> str:
    return f"""select concat('H',cast(case when {key}%11=3 then {key}-1 else {key} end as string)) id, {key} seq, {columns}, {bad} bad from {{{source}}}"""


OTHER_HEADERS = {
    "purchase_order": _header_requests(
        "cast(case when o_orderkey%53=1 then -1 else o_orderkey%10 end as string) supplier_id, cast(o_orderdate as date) order_date, 'EUR' currency", "o_orderkey%53=1"),
    "receipt": _header_requests(
        "cast(case when id%59=1 then -1 else id end as string) purchase_order_id, cast(id%5 as string) warehouse_id", "id%59=1", "id", "purchase_order"),
    "package": _header_requests(
        "cast(o_orderkey as string) sales_order_id, cast(case when o_orderkey%61=1 then 99 else o_orderkey%5 end as string) warehouse_id", "o_orderkey%61=1"),
    "transfer_order": _header_requests(
        "cast(o_orderkey%5 as string) from_warehouse_id, cast(case when o_orderkey%67=1 then 99 else (o_orderkey+1)%5 end as string) to_warehouse_id", "o_orderkey%67=1"),
}


def _headers_sql() -> str:
    parts = []
    for kind, status in (("purchase_order", "'DRAFT'"), ("receipt", "null"), ("package", "'OPEN'"), ("transfer_order", "'DRAFT'")):
        repeats = "false" if kind == "purchase_order" else "rn>1"  # an order whose id is known is left as it is
        parts.append(f"""
            select '{kind}' kind, id, 'created' outcome, {status} status, '7' created_by, {'true' if kind in ('receipt', 'transfer_order') else 'false'} timed
            from (select *, row_number() over (partition by id order by seq) rn from {{{kind}_requests}} where not bad) a where rn=1
            union all select '{kind}', id, min(code), null, null, false from (
              select id, case when bad then 'FOREIGN_KEY_VIOLATION' else 'UNIQUE_VIOLATION' end code
              from (select *, row_number() over (partition by id, bad order by seq) rn from {{{kind}_requests}}) b where bad or {repeats}) c group by id""")
    return " union all ".join(parts)


@query("b01_create_other_headers", _headers_sql(), **{f"{kind}_requests": text for kind, text in OTHER_HEADERS.items()})
def _(t, spark, folder):
    texts, parts = with_text_ids(t), []
    for kind, text in OTHER_HEADERS.items():
        requests = asked(spark, t, folder, text).drop("bad")
        done = intake.create_headers(texts, kind, requests, run_time()).signed(texts, F.lit("7"))
        rows = done.inserts[kind]
        state = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
        moment = [c for c in ("received_at", "requested_at") if c in rows.columns]
        timed = (F.col(moment[0]) == run_time()) if moment else F.lit(False)
        parts.append(rows.select(F.lit(kind).alias("kind"), "id", F.lit("created").alias("outcome"), state.alias("status"), "created_by", timed.alias("timed")))
        none = F.lit(None).cast("string")
        parts.append(done.rejects.select(F.lit(kind), "request_id", "reject_code", none, none, F.lit(False)).toDF(*parts[0].columns))
    return reduce(DataFrame.unionByName, parts)


NEW_LINES = """
    select concat('L',cast(id as string)) id, cast(sales_order_id as string) sales_order_id, (id*7)%1000003 seq,
           case when id%101=7 then 'none' else cast(product_id as string) end product_id, cast(uom_id as string) uom_id, qty_ordered, price_per_uom
    from {sales_order_line} where id%3<>1"""


@query("b02_add_numbered_lines", """
    select id, cast(coalesce(m.top,0)+row_number() over (partition by sales_order_id order by seq, id) as int) line_no, 'added' outcome
    from {new_lines} left join (select cast(sales_order_id as string) so, max(line_no) top from {sales_order_line} group by 1) m on m.so=sales_order_id
    where product_id<>'none'
    union all select id, null, 'FOREIGN_KEY_VIOLATION' from {new_lines} where product_id='none'""", new_lines=NEW_LINES)
def _(t, spark, folder):
    done = intake.add_numbered_lines(with_text_ids(t), "sales_order_line", asked(spark, t, folder, NEW_LINES), run_time())
    return done.inserts["sales_order_line"].select("id", "line_no", F.lit("added").alias("outcome")).unionByName(
        done.rejects.select(F.col("request_id").alias("id"), F.lit(None).cast("int").alias("line_no"), F.col("reject_code").alias("outcome"))
    )


NEW_ITEMS = """
    select concat('P',cast(id as string)) id, id seq, cast(case when id%90=4 then -1 else package_id end as string) package_id,
           cast(product_id as string) product_id, cast(lot_id as string) lot_id, case when id%85=3 then null else qty end qty
    from {package_item}"""


@query("b03_add_items", """
    select id, case when package_id='-1' then 'FOREIGN_KEY_VIOLATION' when qty is null then 'NOT_NULL_VIOLATION' else 'added' end outcome
    from {new_items}""", new_items=NEW_ITEMS)
def _(t, spark, folder):
    done = intake.add_lines(with_text_ids(t), "package_item", asked(spark, t, folder, NEW_ITEMS), run_time())
    return outcomes(done.inserts["package_item"], "added", done.rejects)


@query("b04_approve", "select id, 'APPROVED' status from {sales_order} where id%3<>1 and status='DRAFT' and not is_deleted")
def _(t, spark, folder):
    return intake.approve(t, "sales_order", t["sales_order"].filter("id % 3 <> 1").select("id"), run_time()).changes["sales_order"].select("id", "status")


@query("b04_approved_by", "select id, '7' updated_by from {sales_order} where status='DRAFT' and not is_deleted")
def _(t, spark, folder):
    done = intake.approve(t, "sales_order", t["sales_order"].select("id"), run_time()).signed(t, F.lit("7"))
    return done.changes["sales_order"].select("id", "updated_by")


# --- receiving ------------------------------------------------------------------------------------

RECEIPTS = """
    select concat(cast(l.id as string),'-',cast(k as string)) id, l.id*3+k seq, timestamp'2024-03-01 00:00:00' + (k) * interval 1 hour ts,
           cast(l.purchase_order_id as string) receipt_id, cast(l.id as string) po_line_id, cast(l.product_id as string) product_id,
           cast(case when l.id%11=0 then 3 else l.uom_id end as string) uom_id,
           cast(case when l.id%13=0 and k=1 then 0 else 1+(l.id+k*13)%20 end as decimal(18,3)) qty_received,
           cast(case when l.product_id%2=0 then l.product_id end as string) lot_id
    from {purchase_order_line} l cross join (select 0 k union all select 1 union all select 2) x"""

RECEIVED = """
    select q.*, case when c0 is not null then c0 when not fits then 'CHECK_VIOLATION' else 'received' end outcome from (
      select z.*, case when k=0 then a0 when k=1 then a1 else a2 end fits from (
        select y.*, a0, a1, (case when a0 and v0 then q0 else 0 end)+(case when a1 and v1 then q1 else 0 end)+q2<=room a2 from (
          select x.*, (case when a0 and v0 then q0 else 0 end)+q1<=room a1 from (
            select p.*, q0<=room a0 from (
              select r.*, cast(right(r.id,1) as int) k,
                     case when rc.id is null or l.id is null or l.is_deleted or o.is_deleted then 'NOT_FOUND'
                          when r.uom_id='3' or p.is_deleted then 'MISSING_CONVERSION' when r.qty_received<=0 then 'INVALID_QTY' end c0,
                     l.qty_ordered-l.qty_received room, o.id po, r.qty_received*case when r.uom_id='2' then 12 else 1 end base_qty, rc.warehouse_id,
                     max(case when right(r.id,1)='0' then r.qty_received end) over (partition by r.po_line_id) q0,
                     max(case when right(r.id,1)='1' then r.qty_received end) over (partition by r.po_line_id) q1,
                     max(case when right(r.id,1)='2' then r.qty_received end) over (partition by r.po_line_id) q2,
                     max(case when right(r.id,1)='0' then r.qty_received end) over (partition by r.po_line_id)>0 v0,
                     max(case when right(r.id,1)='1' then r.qty_received end) over (partition by r.po_line_id)>0 v1
              from {receipts} r left join {receipt} rc on cast(rc.id as string)=r.receipt_id
              left join {purchase_order_line} l on cast(l.id as string)=r.po_line_id left join {purchase_order} o on o.id=l.purchase_order_id
              left join {product} p on cast(p.id as string)=r.product_id) p) x) y) z) q"""


def received(t, spark, folder):
    return receiving.receive_goods(with_text_ids(t), asked(spark, t, folder, RECEIPTS), run_time())


@query("b05_receive_goods", "select id, outcome from {received}", receipts=RECEIPTS, received=RECEIVED)
def _(t, spark, folder):
    done = received(t, spark, folder)
    return outcomes(done.inserts["receipt_line"], "received", done.rejects)


@query("b05_stock_after", """
    select s.warehouse_id, s.product_id, s.lot_id, cast(coalesce(i.qty_on_hand,0)+s.more as double) qty_on_hand
    from (select cast(warehouse_id as string) warehouse_id, product_id, lot_id, sum(base_qty) more from {received} where outcome='received' group by all) s
    left join {inventory} i on cast(i.warehouse_id as string)=s.warehouse_id and i.bin_id is null and cast(i.product_id as string)=s.product_id
     and cast(i.lot_id as string) is not distinct from s.lot_id""", receipts=RECEIPTS, received=RECEIVED)
def _(t, spark, folder):
    return doubles(received(t, spark, folder).changes["inventory"].select("warehouse_id", "product_id", "lot_id", "qty_on_hand"), "qty_on_hand")


@query("b05_orders_after", """
    select cast(o.id as string) id, 'RECEIVED' status from {purchase_order} o
    where o.status<>'RECEIVED' and o.id in (select po from {received} where outcome='received') and not exists (
      select 1 from {purchase_order_line} l left join (select po_line_id, sum(qty_received) more from {received} where outcome='received' group by 1) r
        on r.po_line_id=cast(l.id as string)
      where l.purchase_order_id=o.id and not l.is_deleted and l.qty_received+coalesce(r.more,0)<l.qty_ordered)""",
    receipts=RECEIPTS, received=RECEIVED)
def _(t, spark, folder):
    return received(t, spark, folder).changes["purchase_order"].select("id", "status")


# --- reserving ------------------------------------------------------------------------------------

RESERVE = """
    select concat('R',cast(id as string),'-',cast(k as string)) id, ((id*7919)%1000003)*2+k seq, cast(id as string) so_line_id,
           cast(case when id%97=1 then product_id+1 else product_id end as string) product_id, cast(product_id%5 as string) warehouse_id,
           cast(case when k=0 or id%5=0 then null else product_id%5+5*(id%5) end as string) bin_id,
           cast(case when product_id%2=0 and id%3<>1 then product_id end as string) lot_id,
           cast(case when uom_id=2 then 1+id%4 else 1+(id+k*5)%17 end as decimal(18,3)) qty_reserved
    from {sales_order_line} cross join (select 0 k union all select 1) x"""

RESERVE_SOUND = """
    select r.*, l.product_id p, l.qty_ordered*case when l.uom_id=2 then 12 else 1 end line_limit,
           r.qty_reserved*case when l.uom_id=2 then 12 else 1 end need,
           case when l.is_deleted then 'NOT_FOUND' when r.product_id<>cast(l.product_id as string) then 'PRODUCT_MISMATCH'
                when pr.is_deleted then 'MISSING_CONVERSION' end fault,
           concat(r.warehouse_id,'/',coalesce(r.bin_id,'-'),'/',r.product_id,'/',coalesce(r.lot_id,'-')) b
    from {reserve} r join {sales_order_line} l on cast(l.id as string)=r.so_line_id left join {product} pr on cast(pr.id as string)=r.product_id"""

AVAILABLE_NOW = """
    select concat(cast(i.warehouse_id as string),'/',coalesce(cast(i.bin_id as string),'-'),'/',cast(i.product_id as string),'/',coalesce(cast(i.lot_id as string),'-')) b,
           greatest(sum(i.qty_on_hand)-coalesce(max(h.held),0),0) available
    from {inventory} i left join (select warehouse_id, bin_id, product_id, lot_id, sum(qty_reserved-qty_picked) held from {reservation}
      where not is_deleted and status in ('OPEN','PICKED') group by all) h
      on h.warehouse_id=i.warehouse_id and h.bin_id is not distinct from i.bin_id and h.product_id=i.product_id and h.lot_id is not distinct from i.lot_id
    where not i.is_deleted group by i.warehouse_id, i.bin_id, i.product_id, i.lot_id"""

RESERVED = """
    with recursive line_left as (
      select cast(l.id as string) line, coalesce(sum(r.qty_reserved) filter (where not r.is_deleted),0) used from {sales_order_line} l
      left join {reservation} r on r.so_line_id=l.id group by l.id),
    slot as (
      select distinct concat(cast(so_line_id as string),'@',cast(warehouse_id as string),'/',coalesce(cast(bin_id as string),'-'),'/',
                             cast(product_id as string),'/',coalesce(cast(lot_id as string),'-')) s from {reservation}),
    queue as (
      select r.*, row_number() over (partition by r.p order by r.seq, r.id) rn, coalesce(a.available,0) available,
             r.line_limit-x.used line_room, concat(r.so_line_id,'@',r.b) s, t.s is not null taken
      from {reserve_sound} r left join {available_now} a on a.b=r.b join line_left x on x.line=r.so_line_id
      left join slot t on t.s=concat(r.so_line_id,'@',r.b) where r.fault is null),
    walk as (
      select p, cast(0 as bigint) rn, cast('' as varchar) id, cast('' as varchar) outcome,
             map([''], [cast(0 as double)]) used from (select distinct p from queue) z
      union all
      select p, rn, id, outcome,
             case when outcome='reserved' then map_concat(used, map([b, so_line_id, s],
               [coalesce(used[b],0)+need, coalesce(used[so_line_id],0)+need, cast(1 as double)])) else used end
      from (select w.p, q.rn, q.id, q.b, q.so_line_id, q.s, cast(q.need as double) need, w.used,
              case when q.need > q.available-coalesce(w.used[q.b],0) then 'INSUFFICIENT_AVAILABLE'
                   when q.need > q.line_room-coalesce(w.used[q.so_line_id],0) then 'EXCEEDS_ORDERED'
                   when q.taken or coalesce(w.used[q.s],0)>0 then 'UNIQUE_VIOLATION' else 'reserved' end outcome
            from walk w join queue q on q.p=w.p and q.rn=w.rn+1) step)
    select id, outcome from walk where rn>0 union all select id, fault from {reserve_sound} where fault is not null"""


@query("b06_reserve_stock", RESERVED, reserve=RESERVE, reserve_sound=RESERVE_SOUND, available_now=AVAILABLE_NOW)
def _(t, spark, folder):
    done = reserving.reserve_stock(with_text_ids(t), asked(spark, t, folder, RESERVE), run_time())
    return outcomes(done.inserts["reservation"], "reserved", done.rejects)


# --- picking --------------------------------------------------------------------------------------

@query("b07_create_picklists", """
    select concat('PL',cast(l.sales_order_id as string)) picklist_id, cast(r.id as string) reservation_id, cast(r.product_id as string) product_id,
           cast(r.qty_reserved-r.qty_picked as double) qty_to_pick, 'OPEN' status
    from {reservation} r join {sales_order_line} l on l.id=r.so_line_id and not l.is_deleted
    where not r.is_deleted and r.status in ('OPEN','PICKED') and r.qty_reserved>r.qty_picked""")
def _(t, spark, folder):
    text = "select concat('PL',cast(id as string)) id, cast(id as string) sales_order_id, cast(id%5 as string) warehouse_id from {sales_order}"
    done = picking.create_picklists(with_text_ids(t), asked(spark, t, folder, text), run_time())
    return doubles(done.inserts["pick_item"].select("picklist_id", "reservation_id", "product_id", "qty_to_pick", "status"), "qty_to_pick")


CONFIRM = """
    select concat('C',cast(id as string)) id, (id*7919)%1000003 seq, timestamp'2024-05-01 00:00:00' + ((id*7919)%1000003) * interval 1 second ts,
           cast(id as string) pick_item_id, case when id%7=0 then qty_to_pick+1 else qty_to_pick-qty_picked end qty
    from {pick_item}"""

CONFIRM_SOUND = """
    select c.*, i.product_id, i.reservation_id, i.picklist_id,
           concat(cast(r.warehouse_id as string),'/',coalesce(cast(i.bin_id as string),'-'),'/',cast(i.product_id as string),'/',coalesce(cast(i.lot_id as string),'-')) b,
           case when i.is_deleted or r.is_deleted then 'NOT_FOUND' when c.qty<=0 or c.qty>i.qty_to_pick-i.qty_picked then 'INVALID_QTY'
                when l.is_deleted or p.is_deleted then 'NOT_FOUND'
                when s.total>l.qty_ordered*case when l.uom_id=2 then 12 else 1 end then 'EXCEEDS_ORDERED' end fault
    from {confirm} c join {pick_item} i on cast(i.id as string)=c.pick_item_id join {reservation} r on r.id=i.reservation_id
    join {sales_order_line} l on l.id=r.so_line_id join {product} p on p.id=l.product_id
    left join (select so_line_id, sum(qty_reserved) total from {reservation} where not is_deleted group by 1) s on s.so_line_id=l.id"""

BUCKET_KEY = """concat(cast(warehouse_id as string),'/',coalesce(cast(bin_id as string),'-'),'/',cast(product_id as string),'/',coalesce(cast(lot_id as string),'-'))"""

STOCK = f"select {BUCKET_KEY} b, sum(qty_on_hand) balance from {{inventory}} group by 1"

# One-by-one rule per bucket over {moves}(id, b, delta, o1, o2): a row is refused when it would go below zero.
FOLD = """
    with recursive queue as (
      select m.*, row_number() over (partition by m.b order by o1, o2) rn from {moves} m),
    walk as (
      select q.b, cast(0 as bigint) rn, cast('' as varchar) id, cast(coalesce(max(s.balance),0) as decimal(38,3)) balance, true ok
      from queue q left join {stock} s on s.b=q.b group by q.b
      union all
      select w.b, q.rn, q.id, cast(case when w.balance+q.delta>=0 then w.balance+q.delta else w.balance end as decimal(38,3)), w.balance+q.delta>=0
      from walk w join queue q on q.b=w.b and q.rn=w.rn+1)
    select id, ok, balance from walk where rn>0"""

CONFIRM_MOVES = "select id, b, -qty delta, seq o1, id o2 from {confirm_sound} where fault is null"
CONFIRMED = dict(confirm=CONFIRM, confirm_sound=CONFIRM_SOUND, stock=STOCK, moves=CONFIRM_MOVES, fold=FOLD)


@query("b09_confirm_picks", """
    select id, fault outcome from {confirm_sound} where fault is not null
    union all select id, case when ok then 'picked' else 'INSUFFICIENT_STOCK' end from {fold}""", **CONFIRMED)
def _(t, spark, folder):
    done = picking.confirm_picks(with_text_ids(t), asked(spark, t, folder, CONFIRM), run_time())
    return outcomes(done.inserts["inventory_tx"].withColumn("id", F.concat(F.lit("C"), "ref_id")), "picked", done.rejects)


@query("b09_after_picks", """
    with done as (select c.pick_item_id, c.qty from {confirm_sound} c join {fold} f on f.id=c.id and f.ok),
    item as (select i.*, i.qty_picked+d.qty picked, case when i.qty_picked+d.qty>=i.qty_to_pick then 'PICKED' else i.status end new_status, d.qty
             from {pick_item} i left join done d on d.pick_item_id=cast(i.id as string))
    select 'pick_item' kind, cast(id as string) id, new_status status, cast(picked as double) qty_picked from item where qty is not null
    union all
    select 'reservation', cast(r.id as string), case when r.qty_picked+i.qty>=r.qty_reserved then 'PICKED' else r.status end,
           cast(r.qty_picked+i.qty as double) from {reservation} r join item i on i.reservation_id=r.id and i.qty is not null
    union all
    select 'picklist', cast(k.id as string), 'CLOSED', null from {picklist} k where k.status<>'CLOSED'
      and k.id in (select picklist_id from item where qty is not null)
      and not exists (select 1 from item i where i.picklist_id=k.id and not i.is_deleted and coalesce(i.new_status, i.status)<>'PICKED')""", **CONFIRMED)
def _(t, spark, folder):
    done = picking.confirm_picks(with_text_ids(t), asked(spark, t, folder, CONFIRM), run_time())
    parts = [
        done.changes[name].select(
            F.lit(name).alias("kind"), "id", "status", (F.lit(None) if name == "picklist" else F.col("qty_picked")).cast("double").alias("qty_picked")
        )
        for name in ("pick_item", "reservation", "picklist")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("b13_close_picklists", """
    select id, 'CLOSED' status from {picklist} k where status<>'CLOSED' and id in (select picklist_id from {pick_item})
      and not exists (select 1 from {pick_item} i where i.picklist_id=k.id and not i.is_deleted and i.status<>'PICKED')""")
def _(t, spark, folder):
    return picking.closed_picklists(t, run_time()).select("id", "status")


# --- shipping -------------------------------------------------------------------------------------

SHIPPED_ORDER = """
    select cast(s.id as string) shipment_id, s.sales_order_id, cast(i.product_id as string) product_id, cast(i.lot_id as string) lot_id, i.qty_picked qty
    from {pick_item} i join {picklist} k on k.id=i.picklist_id and not k.is_deleted join {reservation} r on r.id=i.reservation_id
    join {sales_order_line} l on l.id=r.so_line_id join {shipment} s on s.sales_order_id=l.sales_order_id and s.warehouse_id=k.warehouse_id and not s.is_deleted
    where not i.is_deleted and i.qty_picked>0"""

SHIPPED_WAREHOUSE = """
    select cast(s.id as string) shipment_id, s.sales_order_id, cast(i.product_id as string) product_id, cast(i.lot_id as string) lot_id, i.qty_picked qty
    from {pick_item} i join {picklist} k on k.id=i.picklist_id and not k.is_deleted
    join (select warehouse_id, max(id) id, max_by(sales_order_id, id) sales_order_id from {shipment} where not is_deleted group by 1) s on s.warehouse_id=k.warehouse_id
    where not i.is_deleted and i.qty_picked>0"""

ITEMS = "select shipment_id, product_id, lot_id, cast(qty as double) qty_shipped from {shipped}"


def shipped_items(done):
    return doubles(done.inserts["shipment_item"].select("shipment_id", "product_id", "lot_id", "qty_shipped"), "qty_shipped")


@query("b10_ship_order_picks", ITEMS, shipped=SHIPPED_ORDER)
def _(t, spark, folder):
    return shipped_items(shipping.ship_picks(with_text_ids(t), t["shipment"].select(F.col("id").cast("string").alias("shipment_id")), run_time()))


@query("b10_ship_warehouse_picks", ITEMS, shipped=SHIPPED_WAREHOUSE)
def _(t, spark, folder):
    newest = t["shipment"].filter("not is_deleted").groupBy("warehouse_id").agg(F.max("id").cast("string").alias("shipment_id"))
    return shipped_items(shipping.ship_picks(with_text_ids(t), newest.select("shipment_id"), run_time(), scope="warehouse"))


ORDERED = "select sales_order_id, sum(qty_ordered) ordered from {sales_order_line} where not is_deleted group by 1"
SHIPPED_QTY = """
    select s.sales_order_id, sum(i.qty_shipped) shipped from {shipment_item} i join {shipment} s on s.id=i.shipment_id
    where not s.is_deleted and not i.is_deleted group by 1"""


@query("b10_orders_after", """
    select cast(o.id as string) id, case when coalesce(x.shipped,0)+coalesce(n.more,0)>=coalesce(d.ordered,0) and coalesce(d.ordered,0)>0
           then 'SHIPPED' else 'PART_SHIPPED' end status
    from {sales_order} o left join {ordered} d on d.sales_order_id=o.id left join {shipped_qty} x on x.sales_order_id=o.id
    left join (select sales_order_id, sum(qty) more from {shipped} group by 1) n on n.sales_order_id=o.id
    where not o.is_deleted and o.id in (select sales_order_id from {shipment} where not is_deleted)""",
    shipped=SHIPPED_ORDER, ordered=ORDERED, shipped_qty=SHIPPED_QTY)
def _(t, spark, folder):
    done = shipping.ship_picks(with_text_ids(t), t["shipment"].select(F.col("id").cast("string").alias("shipment_id")), run_time())
    return done.changes["sales_order"].select("id", "status")


@query("b11_ship_status", """
    select id, due status from (
      select o.id, o.status, case when d.ordered>0 and coalesce(x.shipped,0)>=d.ordered then 'SHIPPED' when x.shipped>0 then 'PART_SHIPPED' end due
      from {sales_order} o left join {ordered} d on d.sales_order_id=o.id left join {shipped_qty} x on x.sales_order_id=o.id
      where not o.is_deleted and o.status<>'CANCELLED') z where due is not null and due<>status""", ordered=ORDERED, shipped_qty=SHIPPED_QTY)
def _(t, spark, folder):
    return shipping.ship_statuses(t, run_time()).select("id", "status")


@query("b12_received_status", """
    select id, 'RECEIVED' status from {purchase_order} o where not is_deleted and status not in ('CANCELLED','RECEIVED')
      and id in (select purchase_order_id from {purchase_order_line})
      and not exists (select 1 from {purchase_order_line} l where l.purchase_order_id=o.id and not l.is_deleted and l.qty_received<l.qty_ordered)""")
def _(t, spark, folder):
    return receiving.received_orders(t, run_time()).select("id", "status")


# --- movements ------------------------------------------------------------------------------------

POSTABLE = f"""
    select cast(x.id as string) id, {BUCKET_KEY} b, x.qty_delta delta, x.ts o1, x.id o2,
           case when x.qty_delta=0 then 'CHECK_VIOLATION' when product_id not in (select id from {{product}}) then 'FOREIGN_KEY_VIOLATION'
                when bin_id is not null and bin_id not in (select id from {{warehouse_bin}}) then 'FOREIGN_KEY_VIOLATION' end fault0, x.move_key
    from {{inventory_tx}} x"""
POST_CHECKED = """
    select *, case when fault0 is not null then fault0
                   when move_key in (select move_key from {stored_part}) then 'UNIQUE_VIOLATION'
                   when row_number() over (partition by fault0, move_key order by o1, o2)>1 then 'UNIQUE_VIOLATION' end fault from {postable}"""
POST_MOVES = "select id, b, delta, o1, o2 from {checked} where fault is null"
# Every fourth movement counts as stored before all of them are asked for.
STORED_PART = "id%4=0"
POSTING = dict(stored_part=f"select move_key from {{inventory_tx}} where {STORED_PART}", postable=POSTABLE, checked=POST_CHECKED, moves=POST_MOVES, stock=STOCK, fold=FOLD)


def partly_stored(t):
    return t.replacing(inventory_tx=t["inventory_tx"].filter(STORED_PART))


def posting(t):
    return ledger.post_movements(partly_stored(t), t["inventory_tx"], run_time())


@query("b08_post_movements", """
    select id, fault outcome from {checked} where fault is not null
    union all select id, case when ok then 'posted' else 'INSUFFICIENT_STOCK' end from {fold}""", **POSTING)
def _(t, spark, folder):
    done = posting(t)
    return outcomes(done.inserts["inventory_tx"], "posted", done.rejects)


@query("b08_stock_after", """
    select m.b, cast(coalesce(max(s.balance),0)+sum(m.delta) as double) qty_on_hand from {moves} m join {fold} f on f.id=m.id and f.ok
    left join {stock} s on s.b=m.b group by m.b""", **POSTING)
def _(t, spark, folder):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in BUCKET]
    stock = posting(t).changes["inventory"].select(F.concat_ws("/", *parts).alias("b"), "qty_on_hand")
    return doubles(stock, "qty_on_hand")


@query("b08_stock_signed", """
    select m.b, max(case when s.b is null then '7' end) created_by, max(case when s.b is not null then '7' end) updated_by
    from {moves} m join {fold} f on f.id=m.id and f.ok left join {stock} s on s.b=m.b group by m.b""", **POSTING)
def _(t, spark, folder):
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in BUCKET]
    stock = posting(t).signed(t, F.lit("7")).changes["inventory"]
    return stock.select(F.concat_ws("/", *parts).alias("b"), "created_by", "updated_by")


ADJUST = """
    select concat('A',cast(event_id as string)) id, ts, user_id%5 warehouse_id, cast(null as int) bin_id, 1+user_id%7 product_id, cast(null as bigint) lot_id,
           cast(case when event_id%40=0 then 0 else value-60 end as decimal(18,3)) qty_delta, event_type ref_type, event_id ref_id
    from {src_events}"""


@query("b15_adjust_stock", """
    select id, 'CHECK_VIOLATION' outcome, cast(null as varchar) reason from {adjust} where qty_delta=0
    union all select f.id, case when f.ok then 'posted' else 'INSUFFICIENT_STOCK' end,
      case when not f.ok then null when a.qty_delta>=0 then 'ADJUST_POS' else 'ADJUST_NEG' end from {fold} f join {adjust} a on a.id=f.id""",
    adjust=ADJUST, moves=f"select id, {BUCKET_KEY} b, qty_delta delta, ts o1, id o2 from {{adjust}} where qty_delta<>0", stock=STOCK, fold=FOLD)
def _(t, spark, folder):
    done = ledger.adjust_stock(t, asked(spark, t, folder, ADJUST), run_time())
    return done.inserts["inventory_tx"].select("id", F.lit("posted").alias("outcome"), "reason").unionByName(
        done.rejects.select(F.col("request_id").alias("id"), F.col("reject_code").alias("outcome"), F.lit(None).cast("string").alias("reason"))
    )


def return_requests(table, header):
    return f"""
    select concat('X',cast(id as string)) id, timestamp'2024-06-01 00:00:00' + (id%86400) * interval 1 second ts, cast({header} as string) {header},
           cast(product_id as string) product_id, cast(null as string) lot_id, cast(1+id%3 as string) uom_id, qty,
           cast(product_id%5 as string) warehouse_id, cast(null as string) bin_id
    from {{{table}}}"""


def return_moves(sign):
    return f"""
    select r.id, {BUCKET_KEY.replace('product_id', 'r.product_id')} b, {sign}r.qty*case when r.uom_id='2' then 12 else 1 end delta, r.ts o1, r.id o2,
           case when r.uom_id='3' or p.is_deleted then 'MISSING_CONVERSION' end fault
    from {{returns}} r join {{product}} p on cast(p.id as string)=r.product_id"""


RETURN_OUTCOME = """
    select id, fault outcome from {measured} where fault is not null
    union all select id, case when ok then 'posted' else 'INSUFFICIENT_STOCK' end from {fold}"""
SOUND_MOVES = "select id, b, delta, o1, o2 from {measured} where fault is null"
CUSTOMER_RETURNS = return_requests("customer_return_line", "customer_return_id")
SUPPLIER_RETURNS = return_requests("supplier_return_line", "supplier_return_id")


@query("b16_customer_returns", RETURN_OUTCOME, returns=CUSTOMER_RETURNS, measured=return_moves(""), moves=SOUND_MOVES, stock=STOCK, fold=FOLD)
def _(t, spark, folder):
    done = ledger.receive_customer_returns(with_text_ids(t), asked(spark, t, folder, CUSTOMER_RETURNS), run_time())
    return outcomes(done.inserts["customer_return_line"], "posted", done.rejects)


@query("b17_supplier_returns", RETURN_OUTCOME, returns=SUPPLIER_RETURNS, measured=return_moves("-"), moves=SOUND_MOVES, stock=STOCK, fold=FOLD)
def _(t, spark, folder):
    done = ledger.ship_supplier_returns(with_text_ids(t), asked(spark, t, folder, SUPPLIER_RETURNS), run_time())
    return outcomes(done.inserts["supplier_return_line"], "posted", done.rejects)


# --- transfers ------------------------------------------------------------------------------------

TRANSFER_STOCK = """
    select concat('T',cast(h.from_warehouse_id as string),':',cast(l.product_id as string),':',coalesce(cast(l.lot_id as string),'-')) id,
           h.from_warehouse_id warehouse_id, cast(null as int) bin_id, l.product_id, l.lot_id, cast(30+l.product_id%90 as decimal(18,3)) qty_on_hand,
           false is_deleted
    from (select distinct h.from_warehouse_id, l.product_id, l.lot_id from {transfer_order_line} l join {transfer_order} h on h.id=l.transfer_order_id) l
    join (select distinct from_warehouse_id from {transfer_order}) h on h.from_warehouse_id=l.from_warehouse_id"""

TRANSFERS = """
    select concat('T',cast(id as string)) id, (id*7919)%1000003 seq, requested_at ts, cast(id as string) transfer_id, cast(null as string) bin_id
    from {transfer_order}"""

TRANSFER_NEEDS = """
    select q.id request, q.seq, cast(h.from_warehouse_id as string) wh, l.uom_id,
           concat(cast(h.from_warehouse_id as string),'/-/',cast(l.product_id as string),'/',coalesce(cast(l.lot_id as string),'-')) b,
           l.qty*case when l.uom_id=2 then 12 else 1 end need
    from {transfers} q join {transfer_order} h on cast(h.id as string)=q.transfer_id
    join {transfer_order_line} l on l.transfer_order_id=h.id join {product} p on p.id=l.product_id and not p.is_deleted"""

# One-by-one rule over whole requests: {demands}(request, seq, grp, b, need), {capacity}(b, grp, available).
GROUP_FOLD = """
    with recursive wanted as (
      select grp, request, seq, list(struct_pack(b := b, need := need)) needs
      from (select grp, request, seq, b, cast(sum(need) as double) need from {demands} group by all) z group by grp, request, seq),
    queue as (select *, row_number() over (partition by grp order by seq, request) rn from wanted),
    walk as (
      select grp, cast(0 as bigint) rn, cast('' as varchar) request, true ok, map_from_entries(list(struct_pack(k := b, v := cast(available as double)))) room
      from {capacity} where grp in (select grp from queue) and b in (select b from {demands}) group by grp
      union all
      select grp, rn, request, ok, case when ok then map_concat(room, map([x.b for x in needs], [room[x.b]-x.need for x in needs])) else room end
      from (select w.grp, q.rn, q.request, q.needs, w.room, len([x for x in q.needs if x.need > coalesce(w.room[x.b],0)])=0 ok
            from walk w join queue q on q.grp=w.grp and q.rn=w.rn+1) step)
    select request, ok from walk where rn>0"""


@query("b14_transfer_out", """
    select f.request id, case when f.ok then 'posted' else 'INSUFFICIENT_STOCK' end outcome from {group_fold} f
    union all select distinct request, 'MISSING_CONVERSION' from {needs} where uom_id is null or uom_id=3
    union all select id, 'posted' from {transfers} where id not in (select request from {needs})""",
    transfers=TRANSFERS, needs=TRANSFER_NEEDS, transfer_stock=TRANSFER_STOCK, group_fold=GROUP_FOLD,
    demands="select request, seq, wh grp, b, need from {needs} where request not in (select request from {needs} where uom_id is null or uom_id=3)",
    capacity=f"select {BUCKET_KEY} b, cast(warehouse_id as string) grp, qty_on_hand available from {{transfer_stock}}")
def _(t, spark, folder):
    text_tables = with_text_ids(t.replacing(inventory=asked(spark, t, folder, TRANSFER_STOCK)))
    done = ledger.post_transfers(text_tables, asked(spark, t, folder, TRANSFERS), run_time(), "out")
    return outcomes(done.changes["transfer_order"].withColumn("id", F.concat(F.lit("T"), "id")), "posted", done.rejects)


@query("b14_transfer_in", """
    select cast(l.id as string) ref_id, concat('TO_IN:',cast(l.id as string)) move_key, cast(h.to_warehouse_id as string) warehouse_id,
           cast(n.need as double) qty_delta
    from {transfer_order_line} l join {transfer_order} h on h.id=l.transfer_order_id join {product} p on p.id=l.product_id and not p.is_deleted
    join (select id, qty*case when uom_id=2 then 12 else 1 end need from {transfer_order_line}) n on n.id=l.id
    where l.transfer_order_id not in (select l2.transfer_order_id from {transfer_order_line} l2 join {product} p2 on p2.id=l2.product_id and not p2.is_deleted
                                      where l2.uom_id is null or l2.uom_id=3)""")
def _(t, spark, folder):
    done = ledger.post_transfers(with_text_ids(t), asked(spark, t, folder, TRANSFERS), run_time(), "in")
    return doubles(done.inserts["inventory_tx"].select("ref_id", "move_key", "warehouse_id", "qty_delta"), "qty_delta")


# --- whole orders ---------------------------------------------------------------------------------

ORDER_STOCK = """
    select concat('I',cast(id as string)) id, id%5 warehouse_id, cast(null as int) bin_id, id product_id, cast(null as bigint) lot_id,
           cast(200+id%300 as decimal(18,3)) qty_on_hand, false is_deleted
    from {product}"""

ORDER_REQUESTS = """
    select concat('F',cast(sales_order_id*5+product_id%5 as string)) id, min((sales_order_id*7919)%1000003)*5+min(product_id%5) seq,
           cast(min(o.customer_id) as string) customer_id, min(o.order_date) order_date, min(o.due_date) due_date, 'USD' currency,
           cast(product_id%5 as string) warehouse_id, cast(null as string) bin_id, cast(null as string) lot_id,
           cast(sales_order_id%3 as string) carrier_id, 'TRK' tracking_no, min(o.order_date) ship_date
    from {sales_order_line} l join {sales_order} o on o.id=l.sales_order_id group by sales_order_id, product_id%5"""

ORDER_LINES = """
    select concat('FL',cast(id as string)) id, line_no seq, concat('F',cast(sales_order_id*5+product_id%5 as string)) sales_order_id,
           cast(product_id as string) product_id, cast(uom_id as string) uom_id, qty_ordered, price_per_uom
    from {sales_order_line}"""

ORDER_NEEDS = """
    select l.sales_order_id request, o.seq, o.warehouse_id grp, l.product_id b, l.qty_ordered*case when l.uom_id='2' then 12 else 1 end need, l.id line_id
    from {order_lines} l join {order_requests} o on o.id=l.sales_order_id join {customer} c on cast(c.id as string)=o.customer_id and not c.is_deleted
    join {product} p on cast(p.id as string)=l.product_id and not p.is_deleted"""

FULFILLED = dict(
    order_lines=ORDER_LINES, order_requests=ORDER_REQUESTS, order_needs=ORDER_NEEDS, group_fold=GROUP_FOLD, order_stock=ORDER_STOCK,
    demands="select request, seq, grp, b, need from {order_needs}",
    capacity="""select b, grp, greatest(q-held,0) available from (
      select cast(i.product_id as string) b, cast(i.warehouse_id as string) grp, i.qty_on_hand q, coalesce((select sum(r.qty_reserved-r.qty_picked) from {reservation} r
        where not r.is_deleted and r.status in ('OPEN','PICKED') and r.bin_id is null and r.lot_id is null and r.product_id=i.product_id
          and r.warehouse_id=i.warehouse_id),0) held from {order_stock} i) z""",
)


@query("b18_fulfil_orders", """
    select o.id, case when f.request is null then 'fulfilled' when f.ok then 'fulfilled' else 'INSUFFICIENT_AVAILABLE' end outcome,
           case when coalesce(f.ok, true) then case when coalesce(s.shipped,0)>=s.ordered then 'SHIPPED' else 'PART_SHIPPED' end end so_status,
           case when coalesce(f.ok, true) then coalesce(s.reservations,0) else 0 end reservations
    from {order_requests} o left join {group_fold} f on f.request=o.id
    left join (select l.sales_order_id, sum(l.qty_ordered) ordered, sum(n.need) shipped, count(n.need) reservations from {order_lines} l
               left join {order_needs} n on n.line_id=l.id group by 1) s on s.sales_order_id=o.id""", **FULFILLED)
def _(t, spark, folder):
    tables = with_text_ids(t.replacing(inventory=asked(spark, t, folder, ORDER_STOCK)))
    done = fulfil.fulfil_orders(tables, asked(spark, t, folder, ORDER_REQUESTS), asked(spark, t, folder, ORDER_LINES), run_time())
    status = done.result.inserts["sales_order"].select(F.col("id").alias("sales_order_id"), F.col("status").alias("so_status"))
    fulfilled = done.outcome.join(status, "sales_order_id").select(
        F.col("sales_order_id").alias("id"), F.lit("fulfilled").alias("outcome"), "so_status",
        F.coalesce(F.size("reservation_ids"), F.lit(0)).cast("bigint").alias("reservations"),
    )
    return fulfilled.unionByName(
        done.result.rejects.select(
            F.col("request_id").alias("id"), F.col("reject_code").alias("outcome"), F.lit(None).cast("string").alias("so_status"),
            F.lit(0).cast("bigint").alias("reservations"),
        )
    )
