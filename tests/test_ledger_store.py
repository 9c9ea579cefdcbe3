"""Ledger kept by day with closing balances: late movements, replays, pruned reads."""

import datetime
import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from stockloom.sources.ledger_store import LedgerStore
from tests.seed import make as _make

SHAPE = "id bigint, ts timestamp, warehouse_id bigint, bin_id bigint, product_id bigint, lot_id bigint, qty_delta decimal(18,3)"
FIRST = datetime.datetime(2024, 1, 1)


def moves(rng, begin, n):
    at = lambda: FIRST + datetime.timedelta(hours=rng.randrange(24 * 20))
    return [(begin + k, at() if rng.random() > 0.03 else None, 1, rng.choice([None, 2]), rng.randrange(3), None, Decimal(rng.choice([-2, 1, 5]))) for k in range(n)]


def sums(rows):
    out = defaultdict(lambda: [Decimal(0), 0])
    for r in rows:
        out[r[2:6]][0] += r[6]
        out[r[2:6]][1] += 1
    return {k: tuple(v) for k, v in out.items()}


def stored(df):
    return {(r.warehouse_id, r.bin_id, r.product_id, r.lot_id): (r.qty, r.n_movements) for r in df.collect()}


def test_balances_from_closed_and_open_days(spark, tmp_path):
    rng, rows = random.Random(3), []
    store = LedgerStore(spark, str(tmp_path), _make(spark, SHAPE, []).schema)
    assert store.balances().collect() == [] and store.running().collect() == []
    store.close(datetime.date(2024, 1, 2))  # nothing to close yet
    for batch, closed in enumerate([None, datetime.date(2024, 1, 5), datetime.date(2024, 1, 5), datetime.date(2024, 1, 12)]):
        new = moves(rng, 1000 * batch, 80)
        rows += new
        for _ in range(2):  # the second time is a replay
            store.append(_make(spark, SHAPE, new), batch)
        if closed:
            for _ in range(2):
                store.close(closed)
        assert stored(store.balances()) == sums(rows)
    late = moves(rng, 9000, 60)
    rows += late
    store.append(_make(spark, SHAPE, late), 7)
    assert stored(store.balances()) == sums(rows)

    expected, balance = {}, defaultdict(Decimal)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or FIRST, r[0])):
        balance[r[2:6]] += r[6]
        if r[1] and r[1].date() > datetime.date(2024, 1, 12):
            expected[r[0]] = balance[r[2:6]]
    assert {r.id: r.running_qty for r in store.running().collect()} == expected


def test_open_rows_are_read_by_partition(spark, tmp_path):
    rng = random.Random(4)
    store = LedgerStore(spark, str(tmp_path), _make(spark, SHAPE, []).schema)
    store.append(_make(spark, SHAPE, [m for m in moves(rng, 0, 300) if m[1]]), 0)
    store.close(datetime.date(2024, 1, 15))
    store.append(_make(spark, SHAPE, [(5000, FIRST, 1, None, 1, None, Decimal(1))]), 1)
    plan = store.open_rows()._jdf.queryExecution().toString()
    scan = plan[plan.index("PartitionFilters: [") :]
    assert "day" in scan[:200] and "batch" in scan[:200]
    days = {r.d for r in store.open_rows().select(F.to_date("ts").alias("d")).collect()}
    assert min(days) == FIRST.date() and all(d > datetime.date(2024, 1, 15) for d in days - {FIRST.date()})
