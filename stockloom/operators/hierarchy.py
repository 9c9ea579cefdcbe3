"""Tree paths by doubling, and graph explosion one level of joins at a time.

Each round is written to the shared folder before the next one starts, so the plan does not grow
with the depth and a lost executor costs at most one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions.predicates import not_among
from stockloom.session import staged


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Paths from the roots down. ``nodes``: id, code, name, parent_id.

    A node appears only if all its ancestors do; nodes of a cycle never reach a root and do not appear.
    Each round joins every open stretch of a path with the one above it, so its length doubles: the rounds
    are the logarithm of the depth.
    """
    root = F.col("parent_id").isNull()
    start = nodes.select(
        "id", "code", "name", "parent_id", F.col("parent_id").alias("_above"), F.col("code").alias("path_code"), F.col("name").alias("path_name"),
        F.when(root, 0).otherwise(1).alias("depth"),
    )
    stretches = staged(start, "tree-stretches")
    done, stretches = [stretches.filter(F.col("_above").isNull())], stretches.filter(F.col("_above").isNotNull())
    while True:
        # Finished stretches stay as those above the open ones, and are neither lengthened nor written again.
        above = reduce(DataFrame.unionByName, [stretches, *done]).select(
            F.col("id").alias("_id"), F.col("_above").alias("_next"), F.col("path_code").alias("_code"), F.col("path_name").alias("_name"), F.col("depth").alias("_depth")
        )
        longer = stretches.join(above, F.col("_above") == F.col("_id")).select(
            "id", "code", "name", "parent_id", F.col("_next").alias("_above"),
            F.concat("_code", F.lit("/"), "path_code").alias("path_code"), F.concat("_name", F.lit("/"), "path_name").alias("path_name"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        longer = staged(longer, "tree-stretches")
        finished = longer.filter(F.col("_above").isNull())
        if finished.isEmpty():  # every depth from the least open one on is taken, so what is left hangs on no root
            break
        done.append(finished)
        stretches = longer.filter(F.col("_above").isNotNull())
    return reduce(DataFrame.unionByName, done).drop("_above")


def explode_graph(edges: DataFrame, max_level: int | None = None) -> DataFrame:
    """All paths below every root. ``edges``: root (id of the edge set), parent, child, qty.

    Returns root, parent, child, qty, level, one row per path. Quantities multiply along a path and
    are kept at six decimals, in the widest decimal: long paths pass twelve digits. A path never enters a child it already holds, so cycles end; the
    first step is taken without that test.
    """
    level = staged(
        edges.select("root", "parent", "child", F.col("qty").cast("decimal(38,6)").alias("qty"), F.lit(1).alias("level"), F.array("parent", "child").alias("path")),
        "graph-level",
    )
    below = edges.select(F.col("parent").alias("child"), F.col("child").alias("_next"), F.col("qty").alias("_qty"))
    levels, depth = [], 1
    while not level.isEmpty():
        levels.append(level.drop("path"))
        if depth == max_level:
            break
        level = staged(
            level.join(below, "child")
            .filter(not_among(F.col("_next"), F.col("path")))
            .select(
                "root", "parent", F.col("_next").alias("child"),
                (F.col("qty") * F.col("_qty")).cast("decimal(38,6)").alias("qty"),
                (F.col("level") + 1).alias("level"),
                F.concat("path", F.array("_next")).alias("path"),
            ),
            "graph-level",
        )
        depth += 1
    return reduce(DataFrame.unionByName, levels or [level.drop("path")])
