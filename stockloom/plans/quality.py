"""Constraints as bulk checks (Q1-Q11). A check returns violations and never changes data.

Shape of a violation: table_name, rule, row_id, reject_code, n_rows. Uniqueness rules give one row
per repeated key with the number of rows holding it; all other rules give one row per bad row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.keys import bucket
from stockloom.functions.predicates import RESERVATION_HOLDING, differs, in_status
from stockloom.functions.units import converted
from stockloom.model import ALLOWED, BUCKET, CHECKS, REFERENCES, REJECT_CLASSES, SCHEMAS, UNIQUE, UNIQUE_GROUPS, UNIQUE_LIVE, WIDTHS
from stockloom.operators.lookup import columns_of
from stockloom.plans.views import inventory_tx_running
from stockloom.session import staged
from stockloom.sources.tables import Tables, active


def _violation(df: DataFrame, table: str, rule: Column, row_id: Column, code: Column, n_rows: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(table).alias("table_name"), rule.alias("rule"), row_id.cast("string").alias("row_id"), code.alias("reject_code"),
        (F.lit(1) if n_rows is None else n_rows).cast("bigint").alias("n_rows"),
    )


def _key_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])


def repeated(df: DataFrame, table: str, columns: Sequence[str], nulls_count: bool = False, rule: str | None = None) -> DataFrame:
    """Q2-Q4: values held by more than one row; unless ``nulls_count``, a null exempts its row."""
    rows = df if nulls_count else df.dropna(subset=list(columns))
    groups = rows.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
    name = rule or "unique:" + "+".join(columns)
    return _violation(groups, table, F.lit(name), _key_text(columns), F.lit("UNIQUE_VIOLATION"), F.col("_n"))


def primary_key(df: DataFrame, table: str) -> DataFrame:
    """Q1: the id is present and unique."""
    missing = df.filter(F.col("id").isNull()).agg(F.count("*").alias("_n")).filter("_n > 0")
    return repeated(df, table, ["id"], rule="primary_key").unionByName(
        _violation(missing, table, F.lit("primary_key"), F.lit(None), F.lit("NOT_NULL_VIOLATION"), F.col("_n"))
    )


def email_ignoring_case(users: DataFrame) -> DataFrame:
    """Q5."""
    return repeated(users.select(F.lower("email").alias("email")), "app_user", ["email"], rule="unique:lower(email)")


def foreign_keys(t: Tables, table: str, rows: DataFrame | None = None) -> DataFrame | None:
    """Q6: rows whose reference has no parent row; a null reference is exempt."""
    rows = t[table] if rows is None else rows
    checks = []
    for reference in REFERENCES:
        if reference.child != table or reference.column not in rows.columns:
            continue
        parents = t[reference.parent].select(F.col("id").alias(reference.column))
        orphans = rows.filter(F.col(reference.column).isNotNull()).select("id", reference.column).join(parents, reference.column, "left_anti")
        checks.append(_violation(orphans, table, F.lit(f"foreign_key:{reference.column}"), F.col("id"), F.lit("FOREIGN_KEY_VIOLATION")))
    return reduce(DataFrame.unionByName, checks) if checks else None


def all_foreign_keys(t: Tables, tables: Iterable[str] = tuple(SCHEMAS)) -> DataFrame:
    """Q6 for many tables at once. Ids are compared as text, or as whole numbers where all of them are.

    Per parent, the values of all columns that refer to it and its own ids are grouped by value, so a value that many rows
    hold is shuffled once a task; the values without a parent are written. Only columns that refer to a parent with
    such values are read again, for the rows that hold them.
    """
    by_parent: dict[str, list] = {}
    for table in tables:
        for r in REFERENCES:
            if r.child == table and r.column in t[table].columns:
                by_parent.setdefault(r.parent, []).append(r)
    kinds = {p: _key_kind(t[p].schema["id"], *[t[r.child].schema[r.column] for r in own]) for p, own in by_parent.items()}
    unmatched = []
    for parent, own in by_parent.items():
        pointed = [t[r.child].select(F.col(r.column).cast(kinds[parent]).alias("key"), F.lit(False).alias("_known")).dropna(subset=["key"]) for r in own]
        ids = t[parent].select(F.col("id").cast(kinds[parent]).alias("key"), F.lit(True).alias("_known"))
        values = reduce(DataFrame.unionByName, [*pointed, ids]).groupBy("key").agg(F.max("_known").alias("_known"))
        unmatched.append(values.filter(~F.col("_known")).select(F.lit(parent).alias("parent"), F.col("key").cast("string").alias("key")))
    unmatched = staged(reduce(DataFrame.unionByName, unmatched), "unmatched-keys")
    bad_parents = {r["parent"] for r in unmatched.select("parent").distinct().collect()}  # at most one row a table
    orphans = []
    for r in (r for p, own in by_parent.items() if p in bad_parents for r in own):
        keys = unmatched.filter(F.col("parent") == r.parent).select(F.col("key").cast(kinds[r.parent]).alias("_key"))
        rows = t[r.child].select("id", F.col(r.column).cast(kinds[r.parent]).alias("_key")).join(keys, "_key", "left_semi")
        orphans.append(_violation(rows, r.child, F.lit(f"foreign_key:{r.column}"), F.col("id"), F.lit("FOREIGN_KEY_VIOLATION")))
    empty = "table_name string, rule string, row_id string, reject_code string, n_rows bigint"
    return reduce(DataFrame.unionByName, orphans or [unmatched.sparkSession.createDataFrame([], empty)])


def _key_kind(*fields) -> str:
    """The type to compare these columns in."""
    return "bigint" if all(f.dataType.typeName() in ("byte", "short", "integer", "long") for f in fields) else "string"


def _single_row_rules(df: DataFrame, table: str) -> list[tuple[str, str, Column]]:
    """Name, code and condition of every rule that a single row can break; the condition holds where it does."""
    rules: list[tuple[str, str, Column]] = []

    def rule(name, code, broken):
        rules.append((name, code, broken))

    for field in SCHEMAS[table]:
        if field.name in df.columns and field.name != "id":
            if not field.nullable:
                rule(f"not_null:{field.name}", "NOT_NULL_VIOLATION", F.col(field.name).isNull())
            if (table, field.name) in ALLOWED:
                rule(f"allowed:{field.name}", "ENUM_VIOLATION", ~F.col(field.name).isin(*ALLOWED[table, field.name]))
            if (table, field.name) in WIDTHS:
                rule(f"length:{field.name}", "LENGTH_VIOLATION", F.length(field.name) > WIDTHS[table, field.name])
    for owner, name, condition in CHECKS:
        if owner == table:
            rule(f"check:{name}", "CHECK_VIOLATION", ~F.expr(condition))
    return rules


def _broken_rules(df: DataFrame, table: str) -> list[Column]:
    """One (rule, code) struct per rule that a single row can break; null where the row keeps it."""
    return [F.when(broken, F.struct(F.lit(name).alias("rule"), F.lit(code).alias("code"))) for name, code, broken in _single_row_rules(df, table)]


def row_rules(df: DataFrame, table: str) -> DataFrame:
    """Q7, Q8: every rule that one row alone can break, found in a single pass; only rows that break one are looked at rule by rule."""
    broken = reduce(lambda a, b: a | b, [c for _, _, c in _single_row_rules(df, table)], F.lit(False))
    found = df.filter(broken).select("id", F.explode(F.filter(F.array(*_broken_rules(df, table)), lambda x: x.isNotNull())).alias("_v"))
    return _violation(found, table, F.col("_v.rule"), F.col("id"), F.col("_v.code"))


def with_orphan_flag(t: Tables, table: str, rows: DataFrame, into: str = "_orphan") -> DataFrame:
    """Add ``into``: whether any reference of the row lacks its parent. Rows are neither lost nor repeated."""
    orphan = F.lit(False)
    for reference in REFERENCES:
        if reference.child == table and reference.column in rows.columns:
            flag = f"_has_{reference.column}"
            parents = t[reference.parent].select(F.col("id").alias(reference.column), F.lit(True).alias(flag))
            rows = rows.join(parents, reference.column, "left")
            orphan = orphan | (F.col(reference.column).isNotNull() & F.col(flag).isNull())
    return rows.withColumn(into, orphan).drop(*[c for c in rows.columns if c.startswith("_has_")])


def insert_fault(t: Tables, table: str, rows: DataFrame, into: str = "_fault") -> DataFrame:
    """Add ``into``: the code of the first rule that forbids inserting the row, or null."""
    codes = F.transform(F.filter(F.array(*_broken_rules(rows, table)), lambda x: x.isNotNull()), lambda x: x["code"])
    flagged = with_orphan_flag(t, table, rows)
    return flagged.withColumn(
        into, F.coalesce(F.array_min(codes), F.when(F.col("_orphan"), F.lit("FOREIGN_KEY_VIOLATION")))
    ).drop("_orphan")


def table_violations(t: Tables, table: str) -> DataFrame:
    """All declared rules of one table."""
    return _own_violations(t, table).unionByName(all_foreign_keys(t, [table])) if any(r.child == table for r in REFERENCES) else _own_violations(t, table)


def _own_violations(t: Tables, table: str) -> DataFrame:
    """The rules that need no other table."""
    df = t[table]
    parts = [primary_key(df, table), row_rules(df, table)]
    parts += [repeated(df, table, c) for owner, c in UNIQUE if owner == table and set(c) <= set(df.columns)]
    parts += [repeated(df, table, c, nulls_count=True) for owner, c in UNIQUE_GROUPS if owner == table and set(c) <= set(df.columns)]
    parts += [repeated(active(df), table, c, rule="unique_live:" + "+".join(c)) for owner, c in UNIQUE_LIVE if owner == table and set(c) <= set(df.columns)]
    if table == "app_user":
        parts.append(email_ignoring_case(df))
    return reduce(DataFrame.unionByName, parts)


def all_violations(t: Tables, tables: Iterable[str] = tuple(SCHEMAS)) -> DataFrame:
    """Every declared rule of every table; the references of all tables are tested together."""
    tables = list(tables)
    return reduce(DataFrame.unionByName, [_own_violations(t, table) for table in tables]).unionByName(all_foreign_keys(t, tables))


def reservation_guard(t: Tables) -> DataFrame:
    """Q9: stored reservations that the reservation rules would refuse.

    The line must be active, its product active and equal to the reserved one, the total of all
    non-deleted reservations of the line within the ordered quantity in the base unit, and the
    picked quantity within the reserved one.
    """
    lines = columns_of(t["sales_order_line"], "so_line_id", _line_product="product_id", _uom="uom_id", _ordered="qty_ordered")
    products = columns_of(t["product"], "_line_product", _base="base_uom_id")
    totals = active(t["reservation"]).groupBy("so_line_id").agg(F.sum("qty_reserved").alias("_total"))
    limits = converted(lines.join(products, "_line_product", "left"), t["uom_conversion"], "_ordered", "_uom", "_base", "_limit")
    joined = t["reservation"].join(limits.join(totals, "so_line_id", "left"), "so_line_id", "left")
    code = (
        F.when(F.col("_line_product").isNull(), F.lit("NOT_FOUND"))
        .when(F.col("_base").isNull(), F.lit("NOT_FOUND"))
        .when(differs(F.col("product_id"), F.col("_line_product")), F.lit("PRODUCT_MISMATCH"))
        .when(F.col("_limit").isNull(), F.lit("MISSING_CONVERSION"))
        .when(~F.col("is_deleted") & (F.col("_total") > F.col("_limit")), F.lit("EXCEEDS_ORDERED"))
        .when(F.col("qty_picked") > F.col("qty_reserved"), F.lit("CHECK_VIOLATION"))
    )
    bad = joined.withColumn("_code", code).filter(F.col("_code").isNotNull())
    return _violation(bad, "reservation", F.lit("reservation_guard"), F.col("id"), F.col("_code"))


def stock_reconciliation(t: Tables, balances: DataFrame | None = None) -> DataFrame:
    """Q10: per bucket, stock on hand against the sum of its ledger, where they differ.

    A difference without any ledger row is an opening balance. ``balances`` (bucket columns, qty,
    n_movements; see ``LedgerStore.balances``) takes the place of summing the whole ledger.
    """
    stock = t["inventory"].groupBy(bucket().alias("bucket")).agg(F.sum("qty_on_hand").alias("qty_on_hand"))
    if balances is None:
        ledger = t["inventory_tx"].groupBy(bucket().alias("bucket")).agg(F.sum("qty_delta").alias("qty_ledger"), F.count("*").alias("n_movements"))
    else:
        ledger = balances.select(bucket().alias("bucket"), F.col("qty").alias("qty_ledger"), "n_movements")
    return (
        stock.join(ledger, "bucket", "full")
        .select(
            "bucket.*", F.coalesce("qty_on_hand", F.lit(0)).alias("qty_on_hand"), F.coalesce("qty_ledger", F.lit(0)).alias("qty_ledger"),
            F.coalesce("n_movements", F.lit(0)).cast("bigint").alias("n_movements"),
        )
        .filter(F.col("qty_on_hand") != F.col("qty_ledger"))
    )


def negative_balances(t: Tables) -> DataFrame:
    """Q11: ledger rows after which a bucket is below zero."""
    return inventory_tx_running(t).filter("running_qty < 0").select("id", "ts", *BUCKET, "qty_delta", "running_qty")


def with_class(rejects: DataFrame) -> DataFrame:
    """add the class of failure that belongs to the reject code."""
    chain = reduce(
        lambda c, pair: c.when(F.col("reject_code") == pair[0], F.lit(pair[1])), REJECT_CLASSES.items(), F.when(F.lit(False), F.lit(""))
    )
    return rejects.withColumn("reject_class", chain.otherwise(F.lit("Infrastructure")))


def holding(df: DataFrame) -> DataFrame:
    """Active reservations that still hold stock."""
    return active(df).filter(in_status("status", RESERVATION_HOLDING))
