"""Row predicates that recur across the model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = object()

PO_OPEN = ("DRAFT", "APPROVED")
SO_OPEN = ("DRAFT", "APPROVED", "PART_SHIPPED")
TRANSFER_OPEN = ("DRAFT", "IN_TRANSIT")
RESERVATION_HOLDING = ("OPEN", "PICKED")


def in_status(column: str, states) -> Column:
    return F.col(column).isin(*states)


def same(left: Column, right: Column) -> Column:
    """Equality in which two nulls are equal."""
    return left.eqNullSafe(right)


def differs(left: Column, right: Column) -> Column:
    return ~left.eqNullSafe(right)


def all_same(left: str, right: str, columns) -> Column:
    """Null-safe equality of several columns of two aliased sides."""
    return reduce(lambda a, b: a & b, [same(F.col(f"{left}.{c}"), F.col(f"{right}.{c}")) for c in columns])


def where_given(df: DataFrame, **values) -> DataFrame:
    """``ANY`` sets no condition, ``None`` asks for null, any other value for equality."""
    for name, value in values.items():
        if value is not ANY:
            df = df.filter(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return df


def effective_on(day: Column, start: str, end: str) -> Column:
    """Open-ended validity interval, both ends included."""
    return (F.col(start).isNull() | (F.col(start) <= day)) & (F.col(end).isNull() | (F.col(end) >= day))


def remainder(total: Column, used: Column) -> Column:
    """``total - used``, never below zero."""
    return F.greatest(total - used, F.lit(0))


def not_among(value: Column, listed: Column) -> Column:
    return ~F.array_contains(listed, value)
