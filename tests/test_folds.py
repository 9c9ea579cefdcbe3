"""The distributed one-by-one rules against a plain loop on random input."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stockloom.operators.admission import admit
from stockloom.operators.overdraft import refused_withdrawals
from stockloom.operators.parts import connected_parts
from tests.seed import make as _make
from stockloom.operators.running import cut_by_rows, ranks, running_totals

def make(spark, rows, schema):
    return _make(spark, schema, rows)


START = datetime.datetime(2024, 1, 1)


@pytest.mark.parametrize("seed_, block_rows", [(1, 1_000_000), (2, 9), (3, 25)])
def test_refused_withdrawals(spark, seed_, block_rows):
    rng = random.Random(seed_)
    moves, opening = [], {b: rng.randrange(0, 30) for b in range(6)}
    for i in range(300):
        hot = 0 if rng.random() < 0.4 else rng.randrange(1, 6)
        moves.append((i, START + datetime.timedelta(hours=rng.randrange(200)), hot, Decimal(rng.choice([-9, -7, -4, -2, 3, 5, 8, 6]))))
    expected, balance = set(), dict(opening)
    for i, _, b, delta in sorted(moves, key=lambda m: (m[1], m[0])):
        if balance[b] + delta < 0:
            expected.add(i)
        else:
            balance[b] += delta
    df = make(spark, moves, "id bigint, ts timestamp, b int, delta decimal(18,3)").withColumn("bucket", F.struct("b", F.lit(None).cast("int").alias("x")))
    stock = make(spark, [(b, Decimal(q)) for b, q in opening.items()], "b int, balance decimal(18,3)").select(
        F.struct("b", F.lit(None).cast("int").alias("x")).alias("bucket"), "balance"
    )
    refused = refused_withdrawals(df.select("id", "ts", "bucket", "delta"), stock, ["ts", "id"], block_rows)
    assert sorted(r["id"] for r in refused.collect()) == sorted(expected)


@pytest.mark.parametrize("seed_, fold_rows", [(1, 10), (2, 60), (3, 1000)])
def test_admission_of_whole_requests(spark, seed_, fold_rows):
    rng = random.Random(seed_)
    capacity = {f"r{i}": rng.randrange(0, 60) for i in range(8)}
    demands, requests = [], {}
    for i in range(150):
        chosen = {"r0"} if rng.random() < 0.4 else set()
        chosen |= {f"r{rng.randrange(9)}" for _ in range(rng.randrange(1, 3))}
        requests[i] = {r: rng.randrange(0, 12) for r in chosen}
        demands += [(i, rng.randrange(50), "k", r, Decimal(q)) for r, q in requests[i].items()]
    order = {i: next(d[1] for d in demands if d[0] == i) for i in requests}
    demands = [(i, order[i], k, r, q) for i, _, k, r, q in demands]
    left, refused = dict(capacity), set()
    for i in sorted(requests, key=lambda x: (order[x], x)):
        if all(left.get(r, 0) >= q for r, q in requests[i].items()):
            for r, q in requests[i].items():
                left[r] = left.get(r, 0) - q
        else:
            refused.add(i)
    done = admit(
        make(spark, demands, "request bigint, seq bigint, kind string, resource string, need decimal(18,3)"),
        make(spark, [(r, Decimal(q)) for r, q in capacity.items()], "resource string, available decimal(18,3)"),
        fold_rows=fold_rows, slice_rows=25,
    )
    assert sorted(r["request"] for r in done.refused.collect()) == sorted(refused)
    assert {r["request"] for r in done.shortages.collect()} == refused


def test_refused_request_uses_nothing(spark):
    demands = [(i, i, "k", "r", Decimal(q)) for i, q in enumerate([5, 8, 3, 2])]
    done = admit(
        make(spark, demands, "request bigint, seq bigint, kind string, resource string, need decimal(18,3)"),
        make(spark, [("r", Decimal(10))], "resource string, available decimal(18,3)"),
    )
    assert [r["request"] for r in done.refused.collect()] == [1]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_totals_do_not_depend_on_slices(spark, width):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaab"), rng.randrange(100), rng.randrange(-5, 9)) for i in range(300)]
    df = make(spark, rows, "id bigint, k string, o bigint, v bigint")
    got = running_totals(df, ["k"], ["o", "id"], {"total": F.col("v")}, width)
    sums, expected = {}, {}
    for i, k, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[k] = sums.get(k, 0) + v
        expected[i] = sums[k]
    assert {r["id"]: r["total"] for r in got.collect()} == expected
    ranked = ranks(df, ["k"], ["o", "id"], "n", width)
    assert sorted(r["n"] for r in ranked.filter("k = 'b'").collect()) == list(range(1, sum(r[1] == "b" for r in rows) + 1))


def test_rows_of_one_key_at_one_instant_are_cut_by_number(spark):
    rows = [(None, None, 1)] * 400 + [("a", 5, 1)] * 400 + [("b", k, 1) for k in range(7)]
    df = make(spark, rows, "k string, o bigint, v bigint")
    short, long = cut_by_rows(df, ["k"], ["o"], 50)
    assert {r["k"] for r in short.collect()} == {"b"}
    sizes = [r["count"] for r in long.groupBy("k", "_slice").count().collect()]
    assert sum(sizes) == 800 and max(sizes) <= 200
    got = running_totals(df, ["k"], ["o"], {"total": F.col("v")}, 50).collect()
    for key, n in ((None, 400), ("a", 400), ("b", 7)):
        assert sorted(r["total"] for r in got if r["k"] == key) == list(range(1, n + 1))


def test_admission_takes_few_steps_when_small_and_full_requests_alternate(spark):
    full, rows, expected, left = 500, [], set(), {"r": 500, "s": 900}
    for i in range(400):
        need = 1 if i % 2 == 0 else full - i // 2
        resource = "r" if i < 300 else "s"
        rows.append((i, i, "k", resource, Decimal(need)))
        if left[resource] >= need:
            left[resource] -= need
        else:
            expected.add(i)
    demands = make(spark, rows, "request bigint, seq bigint, kind string, resource string, need decimal(18,3)")
    done = admit(demands, make(spark, [("r", Decimal(500)), ("s", Decimal(900))], "resource string, available decimal(18,3)"), fold_rows=100)
    assert {r["request"] for r in done.refused.collect()} == expected
    assert done.rounds <= 5 and done.folds <= 3


def test_connected_parts(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 100)]
    got = {r["id"]: r["part"] for r in connected_parts(make(spark, edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in (100, 101, 102, 200)}}
    assert connected_parts(make(spark, [], "a bigint, b bigint")).isEmpty()
