"""Key expressions: repeatable row ids, movement keys, null-free bucket columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.model import BUCKET, ZERO_ID

# Prefix of a movement key by the kind of row that caused the movement.
MOVE_PREFIX = {
    "receipt_line": "RECEIPT:",
    "pick_item": "PICK:",
    "transfer_out": "TO_OUT:",
    "transfer_in": "TO_IN:",
    "customer_return_line": "RMA_IN:",
    "supplier_return_line": "RTV_OUT:",
    "adjustment": "ADJ:",
}


def derived_id(*natural_key) -> Column:
    """An id that a rerun reproduces: a digest of the natural key, with nulls kept distinct."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in map(_column, natural_key)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def move_key(kind: str, *parts) -> Column:
    texts = [F.coalesce(_column(p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(MOVE_PREFIX[kind]), F.concat_ws(":", *texts))


def adjustment_reason(delta: Column) -> Column:
    return F.when(delta >= 0, F.lit("ADJUST_POS")).otherwise(F.lit("ADJUST_NEG"))


def without_null(column: str) -> Column:
    """The column with null replaced by the zero id, for uniqueness only."""
    return F.coalesce(F.col(column).cast("string"), F.lit(ZERO_ID))


def bucket(columns=BUCKET) -> Column:
    """The stock bucket as one non-null value; two buckets with the same nulls are equal."""
    return F.struct(*[F.col(c) for c in columns])


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
