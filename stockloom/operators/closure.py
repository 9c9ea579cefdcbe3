"""The rows of the model that belong to a set of keys, found along the declared references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.model import REFERENCES
from stockloom.sources.tables import Tables, where_in_keys


def within(t: Tables, root: str, keys: DataFrame, tables: Sequence[str]) -> Tables:
    """Tables in which ``root`` and ``tables`` hold only what belongs to the ids ``keys`` (first column) of ``root``.

    In the order given, each table is cut down by a semi-join with one cut down before it: to the rows that
    refer to it or, where none can, to the rows it refers to. Nothing is grouped or joined on the way, so what
    comes after a scan follows the number of keys. All other tables stay whole.
    """
    cut = {root: where_in_keys(t[root], keys, "id")}
    for table in tables:
        down = [r for r in REFERENCES if r.child == table and r.parent in cut]
        up = [r for r in REFERENCES if r.parent == table and r.child in cut]
        if down:
            rows = where_in_keys(t[table], cut[down[0].parent].select("id"), down[0].column)
        elif up:
            rows = where_in_keys(t[table], cut[up[0].child].select(up[0].column), "id")
        else:
            raise ValueError(f"no reference ties {table} to {', '.join(cut)}")
        cut[table] = rows
    return t.replacing(**{name: rows.select(*t[name].columns) for name, rows in cut.items()})


def ids_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The ids of ``rows`` that ``stored`` holds too, as text. The stored table is filtered by the rows' ids."""
    known = stored.select(F.col("id").cast("string").alias("_known"))
    return known.join(rows.select(F.col("id").cast("string").alias("_known")), "_known", "left_semi")


def not_among_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose id is not among those of ``ids_stored``."""
    return rows.join(known, F.col("id").cast("string") == F.col("_known"), "left_anti")


def not_stored(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose id ``stored`` does not hold; ids are compared as text. The stored table is filtered by the rows' ids first."""
    return not_among_ids(rows, ids_stored(rows, stored))
