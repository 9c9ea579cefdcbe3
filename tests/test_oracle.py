"""Every registered query of the model against its SQL on the smallest data set."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import load
from checks.compare import TABLES, _rows

REGISTRY = load()

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = REGISTRY.QUERIES[name](spark, FOLDER)
    got = _rows(df.columns, df.collect())
    cursor = duck.execute(REGISTRY.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == _rows(columns, cursor.fetchall())


def test_every_query_of_the_model_is_registered_with_sql():
    assert set(REGISTRY.QUERIES) == set(REGISTRY.ORACLES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_entry_returns_rows(spark):
    assert not entry(spark).isEmpty()
