"""Looking up columns of a referenced table by its key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.sources.tables import active


def columns_of(table: DataFrame, key: str, live: bool = True, **columns: str) -> DataFrame:
    """``table`` cut down to its id, named like the referring column, and the renamed ``columns``.

    With ``live`` the soft-deleted rows are left out first: an inner join then drops the referring
    row, while a left join keeps it and blanks the looked-up columns.
    """
    rows = active(table) if live else table
    return rows.select(F.col("id").alias(key), *[F.col(old).alias(new) for new, old in columns.items()])
