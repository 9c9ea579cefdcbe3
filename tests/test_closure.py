"""Work limited to the keys asked for: key closure, name candidates, tree paths by doubling, reruns of picklists and shipping."""

import random

import pytest
from pyspark.sql import functions as F

from stockloom.operators import hierarchy
from stockloom.operators.closure import within
from stockloom.operators.hierarchy import tree_paths
from stockloom.plans import search
from stockloom.plans.documents import order_fulfillment_doc
from stockloom.plans.jobs.picking import create_picklists
from stockloom.plans.views import so_line_open
from stockloom.sources.fixtures import derived_columns, derived_tables, with_text_ids
from tests.seed import make as _make

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return derived_tables(spark, FOLDER)


def test_derived_columns_are_those_of_the_tables(t):
    for name in t:
        assert derived_columns(name) == t[name].columns


def test_closure_keeps_what_belongs_to_the_keys(spark, t):
    keys = _make(spark, "k bigint", [(3,), (7,), (999_999,)])
    cut = within(t, "sales_order", keys, ["sales_order_line", "reservation", "pick_item", "picklist", "shipment", "shipment_item"])
    lines = t["sales_order_line"].filter("sales_order_id in (3, 7)")
    held = t["reservation"].join(lines.select(F.col("id").alias("so_line_id")), "so_line_id", "left_semi")
    assert cut["sales_order_line"].count() == lines.count() > 0
    assert {r.id for r in cut["reservation"].collect()} == {r.id for r in held.collect()}
    picks = t["pick_item"].join(held.select(F.col("id").alias("reservation_id")), "reservation_id", "left_semi")
    assert {r.id for r in cut["picklist"].collect()} == {r.picklist_id for r in picks.collect()}
    assert cut["product"].count() == t["product"].count()
    with pytest.raises(ValueError, match="no reference"):
        within(t, "sales_order", keys, ["bom"])


def test_keyed_views_equal_whole_views_on_the_keys(spark, t):
    keys = t["sales_order"].select("id").filter("id between 40 and 70")
    whole = order_fulfillment_doc(t).join(keys.withColumnRenamed("id", "sales_order_id"), "sales_order_id", "left_semi")
    assert sorted(map(str, order_fulfillment_doc(t, keys).collect())) == sorted(map(str, whole.select(*order_fulfillment_doc(t).columns).collect()))
    lines = so_line_open(t).join(keys.withColumnRenamed("id", "sales_order_id"), "sales_order_id", "left_semi")
    assert {r.id for r in so_line_open(t, keys).collect()} == {r.id for r in lines.collect()}


def test_rows_grouped_follow_the_request(spark, t):
    """The reservations are cut down before they are grouped: the aggregate stands above a semi-join in the plan."""
    keys = _make(spark, "k bigint", [(3,)])
    plan = so_line_open(t, keys)._jdf.queryExecution().optimizedPlan().toString()
    grouped = plan[plan.index("Aggregate [so_line_id") :]
    assert "LeftSemi" in grouped.split("Relation")[0]


def test_name_candidates_lose_no_similar_pair(spark):
    rng = random.Random(2)
    words = ["small", "smal", "ring", "rings", "red", "widget", "widgets", "bolt", "blue", "of", "the", "steel"]
    names = _make(spark, "id bigint, name string", [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for k in range(300)] + [(900, None), (901, "")])
    queries = _make(spark, "query_id bigint, query string", [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for k in range(25)] + [(90, ""), (91, "zz")])
    for least in (0.3, 0.5, 0.8, 1.0):
        distinct, asked, pairs = search.name_candidates(names, queries, least)
        every = distinct.crossJoin(asked).withColumn("_s", F.size(F.array_intersect("_grams", "_asked")))
        every = every.withColumn("similarity", F.try_divide(F.col("_s"), F.size("_grams") + F.size("_asked") - F.col("_s"))).filter(F.col("similarity") >= least)
        want = {(r.query_id, r.name): r.similarity for r in every.collect()}
        got = {(r.query_id, r.name): r.similarity for r in search.similar_names(names, queries, least).collect()}
        assert got == want
        assert pairs.count() < distinct.count() * asked.count() * 0.9


def test_deep_chain_takes_few_rounds_and_cycles_end(spark, monkeypatch):
    rows = [(0, "c0", "n0", None)] + [(k, f"c{k}", f"n{k}", k - 1) for k in range(1, 1000)]
    rows += [(2000, "x", "x", 2001), (2001, "y", "y", 2000), (2002, "z", "z", 2002), (2003, "w", "w", 5555), (2004, "v", "v", 2003)]
    written = []
    real = hierarchy.staged
    monkeypatch.setattr(hierarchy, "staged", lambda df, label: written.append(label) or real(df, label))
    got = {r.id: r for r in tree_paths(_make(spark, "id bigint, code string, name string, parent_id bigint", rows)).collect()}
    assert set(got) == set(range(1000))
    assert got[999].depth == 999 and got[999].path_code == "/".join(f"c{k}" for k in range(1000)) and got[7].path_name == "n0/n1/n2/n3/n4/n5/n6/n7"
    assert len(written) <= 2 * 12


def test_picklists_reject_faults_and_rerun_adds_nothing(spark, t, run_ts):
    texts = with_text_ids(t)
    orders = [r.id for r in texts["sales_order"].orderBy("id").limit(60).collect()]
    asked = [(f"P{k}", order, "1") for k, order in enumerate(orders)] + [("BAD", orders[0], "77"), (None, orders[1], "1"), ("P0", orders[2], "2")]
    requests = _make(spark, "id string, sales_order_id string, warehouse_id string", asked)
    done = create_picklists(texts, requests, run_ts)
    codes = {r.request_id: r.reject_code for r in done.rejects.collect()}
    assert codes == {"BAD": "FOREIGN_KEY_VIOLATION", None: "NOT_NULL_VIOLATION"}
    assert done.inserts["picklist"].count() == 60
    items = done.inserts["pick_item"]
    assert items.count() == items.select("id").distinct().count() > 0
    after = done.applied(texts)
    again = create_picklists(after, requests, run_ts)
    assert again.inserts["picklist"].isEmpty() and again.inserts["pick_item"].isEmpty()
