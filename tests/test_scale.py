"""Steps that have to stay in proportion to their input: how they are planned, and that they give the same rows."""

from pyspark.sql import functions as F

from checks import load, streams
from checks.documents import requests_for_all, stored_documents
from stockloom.operators import hierarchy
from stockloom.plans import quality, search
from stockloom.plans.jobs import shipping
from stockloom.sources.fixtures import derived_tables
from stockloom.sources.keyed import KeyedTable
from stockloom.sources.tables import Tables
from stockloom.streaming import refresh


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_tested_by_value_and_not_by_row(spark):
    rows = {
        "sales_order": spark.createDataFrame([(1,), (2,)], "id bigint"),
        "product": spark.createDataFrame([("7",), ("8",)], "id string"),
        "sales_order_line": spark.createDataFrame(
            [(10, 1, "7"), (11, 1, "7"), (11, 1, "7"), (12, 3, "7"), (12, 3, "7"), (None, 3, "9"), (13, None, None)], "id bigint, sales_order_id int, product_id string"
        ),
    }
    found = quality.all_foreign_keys(Tables(rows.__getitem__), ["sales_order_line"])
    assert sorted((r["rule"], str(r["row_id"]), r["n_rows"]) for r in found.collect()) == [
        ("foreign_key:product_id", "None", 1), ("foreign_key:sales_order_id", "12", 1), ("foreign_key:sales_order_id", "12", 1), ("foreign_key:sales_order_id", "None", 1),
    ]
    assert {r["table_name"] for r in found.collect()} == {"sales_order_line"}
    assert "Generate" not in plan(found)  # no row per reference
    sound = {**rows, "sales_order_line": rows["sales_order_line"].filter("id < 12")}
    assert quality.all_foreign_keys(Tables(sound.__getitem__), ["sales_order_line"]).isEmpty()


def test_rules_are_listed_for_rows_that_break_one_only(spark):
    rows = spark.createDataFrame([(1, "OPEN", 5, 2), (2, "LOST", 5, 6), (3, None, 5, None)], "id bigint, status string, qty_reserved int, qty_picked int")
    rows = rows.withColumns({c: F.col(c).cast("decimal(18,3)") for c in ("qty_reserved", "qty_picked")})
    found = quality.row_rules(rows, "reservation")
    assert sorted((r["row_id"], r["rule"]) for r in found.collect()) == [
        ("2", "allowed:status"), ("2", "check:picked_within_reserved"), ("3", "not_null:qty_picked"), ("3", "not_null:status"),
    ]
    assert any("Filter" in line and " OR " in line for line in plan(found).splitlines())


def test_token_search_groups_no_pairs(spark):
    tokens = "array<struct<token:string,weight:string>>"
    catalogue = spark.createDataFrame(
        [("product", "1", [("red", "A"), ("ring", "B"), ("red", "B")]), ("product", "2", [("red", "A")]), ("product", "2", [("ring", "C")]), ("lot", None, [("ring", "D")])],
        f"entity_type string, entity_id string, tokens {tokens}",
    )
    queries = spark.createDataFrame([(1, "red ring red"), (2, "ring"), (3, "red blue"), (4, "red"), (4, "red"), (5, "ring"), (5, "blue"), (6, "red"), (6, "ring"), (None, "..")], "query_id int, query string")
    found = search.token_search(catalogue, queries)
    assert plan(found).startswith("Project")
    got = sorted((r["query_id"], r["entity_type"], str(r["entity_id"]), round(r["rank"], 3)) for r in found.collect())
    assert got == [  # 5 and 6 stand for two texts: an entity that holds the words of one is found, one that holds both is not
        (1, "product", "1", 1.8), (1, "product", "2", 1.2), (2, "lot", "None", 0.1), (2, "product", "1", 0.4), (2, "product", "2", 0.2),
        (4, "product", "1", 2.8), (4, "product", "2", 2.0), (5, "lot", "None", 0.1), (5, "product", "1", 0.4), (5, "product", "2", 0.2), (6, "lot", "None", 0.1),
    ]


def test_names_are_linked_by_class(spark):
    names = spark.createDataFrame([(1, "super widget"), (2, "super widget"), (3, "blue bolt"), (4, None)], "id int, name string")
    queries = spark.createDataFrame([(-1, "super widgets"), (-2, "super widgets"), (-3, None)], "query_id int, query string")
    rows = search.similar_name_classes(names, queries, 0.5).collect()
    assert sorted((r["kind"], r["class_id"], r["id"]) for r in rows) == [
        ("link", -2, 1), ("name", 1, 1), ("name", 1, 2), ("name", 3, 3), ("name", 4, 4), ("query", -3, -3), ("query", -2, -2), ("query", -2, -1),
    ]


def test_every_query_stands_beside_every_copy_of_a_similar_name(spark, tmp_path):
    names = {k: ("red widget", "red widgets", "blue bolt", "steel")[k % 4] for k in range(1, 13)}
    parts = [(k, name, "Brand#11", "ECONOMY", 1) for k, name in names.items()]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in range(1, 8)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = load().QUERIES["f14_similar_names"](spark, str(tmp_path)).collect()
    asked = {-k: ("smal ring", "red widgets", "blue bolt")[k % 3] for k in range(1, 8)}
    close = {("red widgets", "red widget"), ("red widgets", "red widgets"), ("blue bolt", "blue bolt")}
    want = [(q, k, name) for q, text in asked.items() for k, name in names.items() if (text, name) in close]
    assert sorted((r["query_id"], r["id"], r["name"]) for r in rows) == sorted(want)


def test_equal_queries_are_compared_once_and_keep_their_rows(spark):
    names = spark.createDataFrame([(1, "super widget"), (2, "super widget"), (2, "super widget"), (None, "blue bolt"), (4, None)], "id int, name string")
    asked = [(1, "super widgets"), (1, "super widgets"), (1, "blue bolts"), (2, "super widgets"), (None, "super widgets"), (3, None)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    found = search.similar_names(names, queries, 0.5)
    assert sorted((r["query_id"], r["id"] or 0) for r in found.collect()) == [(1, 0), (1, 1), (1, 1), (1, 2), (1, 2), (1, 2), (1, 2), (2, 1), (2, 2), (2, 2)]
    distinct, texts, _ = search.name_candidates(names, queries.select(F.col("query").alias("query_id"), "query").distinct(), 0.5)
    assert texts.count() == 3 and distinct.count() == 3


def test_finished_paths_are_written_once(spark, monkeypatch):
    written, write = [], hierarchy.staged
    monkeypatch.setattr(hierarchy, "staged", lambda df, label: written.append(write(df, label)) or written[-1])
    nodes = spark.createDataFrame([(k, f"c{k}", f"n{k}", k - 1 if k else None) for k in range(9)], "id int, code string, name string, parent_id int")
    assert {r["id"]: r["path_code"] for r in hierarchy.tree_paths(nodes).collect()} == {k: "/".join(f"c{j}" for j in range(k + 1)) for k in range(9)}
    assert [df.filter("_above is null").count() for df in written] == [1, 1, 2, 4, 1, 0]


def test_stored_rows_pass_as_they_are_unless_a_key_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "k bigint, v string")
    table = KeyedTable(spark, str(tmp_path), rows.schema, ["k"], parts=4)
    table.put(rows.filter("k < 10"), 0)
    table.put(rows.filter("k >= 10"), 1)
    assert "Aggregate" not in plan(table.rows()) and sorted(map(tuple, table.rows().collect())) == sorted(map(tuple, rows.collect()))
    table.put(rows.filter("k = 3").withColumn("v", F.lit("new")), 2)
    asked = spark.createDataFrame([(3,), (4,), (15,), (99,)], "k bigint")
    found = table.lookup(asked)
    assert sorted(map(tuple, found.collect())) == [(3, "new"), (4, "v4"), (15, "v15")]
    text = plan(found)
    assert text.index("Aggregate") < text.index("LeftSemi")  # the rows asked for come before newest ones are told


def test_fresh_documents_meet_stored_ones_only_if_there_are_any(spark, tmp_path, monkeypatch, run_ts):
    met, upsert = [], refresh.upsert_rows
    monkeypatch.setattr(refresh, "upsert_rows", lambda *given: met.append(1) or upsert(*given))
    t = derived_tables(spark, "/root/testdata/sf0.001")
    batch = requests_for_all(t).filter("sales_order_id % 10 = 2")
    write = refresh.document_writer(lambda: t, str(tmp_path), run_ts)
    write(batch, 0)
    assert not met
    write(batch, 1)
    stored = refresh.document_table(spark, f"{tmp_path}/documents", stored_documents(t).schema).rows()
    assert met and stored.count() == stored_documents(t).filter("_id % 10 = 2").count() > 0


def test_picked_items_are_found_once(spark, run_ts):
    t = derived_tables(spark, "/root/testdata/sf0.001")
    done = shipping.ship_picks(t, t["shipment"].select(F.col("id").alias("shipment_id")), run_ts)
    assert plan(done.inserts["shipment_item"]).count("LeftSemi") == 1  # ids known already; the items are found once


def test_slices_come_from_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "fresh_folder", lambda spark, label: str(tmp_path / label))
    rows = spark.createDataFrame([(k, f"2024-01-01 00:00:{k:02d}") for k in range(30)], "id int, ts string")
    seen = []
    streams.in_time_slices(spark, rows, lambda moves: seen.append(spark.read.parquet(str(tmp_path / "time-slices")).count()))
    assert seen == [10, 20, 30] and len(list((tmp_path / "sliced").glob("_slice=*"))) == 3
