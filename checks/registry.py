"""Collects queries and their oracle SQL."""

from __future__ import annotations

from stockloom.sources.fixtures import DERIVATIONS, derived_tables, placeholders

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-06-30"
RUN_TS = "2024-07-01 00:00:00"


def with_inputs(select: str, **views: str) -> str:
    """Complete ``select`` with the derivations and views its ``{names}`` stand for, as CTEs."""
    ordered: dict[str, str] = {}

    def need(name):
        if name.startswith("src_") or name in ordered:
            return
        text = views[name] if name in views else DERIVATIONS[name]
        for other in placeholders(text):
            need(other)
        ordered[name] = text

    for name in placeholders(select):
        need(name)

    def filled(text):
        return text.format(**{p: p[4:] if p.startswith("src_") else f"f_{p}" for p in placeholders(text)})

    ctes = ", ".join(f"f_{name} as ({filled(text)})" for name, text in ordered.items())
    body = filled(select).strip()
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes}, {body[len('with recursive'):].strip()}"
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[len('with'):].strip()}"
    return f"with {ctes} {body}"


def query(name: str, oracle: str | None = None, **views: str):
    """Register ``f(tables, spark, folder) -> DataFrame`` under ``name``."""

    def register(build):
        QUERIES[name] = lambda spark, folder: build(derived_tables(spark, folder), spark, folder)
        if oracle is not None:
            ORACLES[name] = with_inputs(oracle, **views)
        return build

    return register


def doubles(df, *columns):
    """Decimals as doubles, so that both engines show one type."""
    return df.withColumns({c: df[c].cast("double") for c in columns})
