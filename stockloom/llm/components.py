"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stockloom.operators.parts import connected_parts


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); a component is named by its least id.

    The steps end only when one changes no edge (see ``connected_parts``).
    """
    return connected_parts(edges).withColumnRenamed("part", "component")
