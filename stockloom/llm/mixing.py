"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected number of copies is in proportion to its
preference, which comes from its size and from a column if one is named, and never above ``max_copies``;
in each source the level of this proportion is set so that the expected words are the target. The whole part of
that number is allocated for certain. The fraction is an inclusion probability ``pi``: documents are
ranked by their random odds over their inclusion odds, ``(u / (1 - u)) / (pi / (1 - pi))``, and the first
ones are taken until the source's words are reached. ``u`` comes from a digest of the id, so a rerun, lost
executors or another partitioning give the same mix.

A sample's size is fixed in words, not in rows. Documents are sampled in three strata of size (above 1/16
of the source, above 1/256, the rest); what one stratum takes too much or too little is made up in the
next, so a source misses its target by half of one small document. The first two strata hold at most 272
documents of a source. The rest is cut in slices along the rank: slice sums find the one slice that holds
the cut, and only its rows are ranked. No step sorts a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.words import unused, word_count
from stockloom.session import staged

SLICES = 4096
FIXED_POINT = 4096.0
PARTS_OF_PREFERENCE = 64
# Least size in words and preference from there on: documents of middle length are preferred.
SIZE_PREFERENCE = ((0, 1.0), (50, 2.0), (1000, 1.5))


def sizes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", preference: str | None = None,
    size_preference: tuple[tuple[int, float], ...] = SIZE_PREFERENCE,
) -> DataFrame:
    """Id, source, preference (in 64ths, a whole number) and size in words of every row; null text has size 0."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        (F.col(preference).cast("double") if preference else F.lit(1.0)).alias("_own"),
        word_count(text_col).alias("size"),
    )
    of_size = F.lit(0.0)
    for least, value in size_preference:
        of_size = F.when(F.col("size") >= least, F.lit(float(value))).otherwise(of_size)
    own = F.greatest(F.coalesce("_own", F.lit(0.0)), F.lit(0.0))
    return rows.withColumn("preference", F.floor(own * of_size * PARTS_OF_PREFERENCE + 0.5).cast("long")).drop("_own")


def source_targets(sized: DataFrame, *, weights: tuple[int, ...], share: tuple[int, int], max_copies: int) -> DataFrame:
    """One row per source: size, weight and target.

    Sources by code point, null last, take the weights in turn. All of them share ``share`` (a fraction)
    of all sizes. A target stops at ``max_copies`` times its source's size and the excess is shared anew
    by weight until none is above: the level ``tau`` with sum(min(cap, weight * tau)) = total is found by
    sorting the sources by cap / weight. One row per source goes through these windows.
    """
    over, under = share
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    totals = totals.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    totals = totals.withColumn("cap", F.col("source_size") * max_copies)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(over) * F.sum("source_size").over(everything) - F.lit(under) * F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.lit(under) * F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    ).cast("double")
    totals = totals.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level"))
    totals = totals.withColumn("_tau", F.first(fits, ignorenulls=True).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("_tau") * F.col("weight"), F.col("cap").cast("double")))
    return totals.select("source", "source_size", "weight", target.alias("target"))


def with_levels(sized: DataFrame, targets: DataFrame, *, max_copies: int) -> DataFrame:
    """``targets`` with the ``level`` at which sum(size * min(max_copies, level * preference)) is the target; null: all are capped.

    Documents of one source and preference go as one row through a window, the most preferred, which reach
    the cap first, at its head. There are as many rows as different preferences in a source.
    """
    classes = sized.filter("preference > 0").groupBy("source", "preference").agg(F.sum("size").alias("_held"))
    t = targets.select(F.col("source").alias("_source"), "target")
    classes = classes.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    falling = Window.partitionBy("source").orderBy(F.desc("preference"))
    capped = F.coalesce(F.sum("_held").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_pull = F.sum(F.col("_held") * F.col("preference")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    level = F.when(open_pull > 0, (F.col("target") - (capped * max_copies).cast("double")) / open_pull.cast("double"))
    found = classes.withColumn("_level", level).filter(F.col("_level") * F.col("preference") <= max_copies)
    best = found.groupBy(F.col("source").alias("_source")).agg(F.max(F.struct("preference", "_level")).alias("_best"))
    joined = targets.join(best, F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select(*targets.columns, F.col("_best._level").alias("level"))


def ranked(sized: DataFrame, targets: DataFrame, *, max_copies: int, seed: int) -> DataFrame:
    """Every row with its certain copies ``whole``, inclusion probability ``pi``, rank ``q`` and stratum."""
    t = targets.select(F.col("source").alias("_source"), "source_size", "level", "target")
    rows = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = F.least(F.lit(float(max_copies)), F.coalesce(F.col("level") * F.col("preference"), F.lit(float(max_copies))))
    copies = F.when((F.col("preference") > 0) & (F.col("source_size") > 0), F.greatest(copies, F.lit(0.0)))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + 0.5) / float(1 << 48)
    rows = rows.withColumn("_copies", F.coalesce(copies, F.lit(0.0))).withColumn("_u", u)
    rows = rows.withColumn("whole", F.floor("_copies")).withColumn("pi", F.col("_copies") - F.col("whole"))
    q = F.when(F.col("pi") > 0, (F.col("_u") / (1.0 - F.col("_u"))) * ((1.0 - F.col("pi")) / F.col("pi")))
    stratum = F.when(F.col("size") * 16 > F.col("source_size"), 1).when(F.col("size") * 256 > F.col("source_size"), 2).otherwise(3)
    return rows.withColumn("q", q).withColumn("stratum", stratum).drop("_copies", "_u", "level")


def _last_taken(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the last (q, doc_id) taken and the words taken up to it, for rows with ``_base`` words before them.

    A row is taken if its middle lies before the goal. Rows of one rank and id are taken together.
    """
    units = rows.groupBy("source", "q", "doc_id", "_base").agg(F.sum("size").alias("size"))
    g = goals.select(F.col("source").alias("_source"), F.col("goal"))
    units = units.join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    until = F.col("_base") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    units = units.withColumn("_until", until).filter(F.col("_until") * 2 - F.col("size") <= F.col("goal") * 2)
    last = units.groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("cut"), F.max("_until").alias("taken"))
    return last


def _cut_small(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """The same for any number of rows: slice sums first, ranks only in the slice that holds the cut."""
    sliced = rows.withColumn("slice", F.floor(F.col("q") / (1.0 + F.col("q")) * SLICES))
    sums = sliced.groupBy("source", "slice").agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    g = goals.select(F.col("source").alias("_source"), F.col("goal"))
    sums = sums.withColumn("_base", F.sum("_sum").over(along) - F.col("_sum")).join(g, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Slices past the goal take nothing; those wholly before it take all; the last that begins before it is ranked.
    edge = sums.filter(F.col("_base") <= F.col("goal")).groupBy("source").agg(F.max(F.struct("slice", "_base")).alias("e"))
    edge = edge.select(F.col("source").alias("_source"), F.col("e.slice").alias("_slice"), F.col("e._base").alias("_base"))
    inside = sliced.join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice")))
    cut = _last_taken(inside.select("source", "q", "doc_id", "size", "_base"), goals)
    c = cut.select(F.col("source").alias("_cut_source"), "cut", "taken")
    found = edge.join(c, F.col("_source").eqNullSafe(F.col("_cut_source")), "left")
    return found.select(F.col("_source").alias("source"), F.col("_slice").alias("slice"), "cut")


def cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: in each stratum the last rank taken (null: none), for the small ones after their last whole slice."""
    open_rows = rows.filter(F.col("pi") > 0)
    expected = [F.sum(F.when(F.col("stratum") == k, F.floor(F.col("pi") * F.col("size") * FIXED_POINT)).otherwise(0)) for k in (1, 2)]
    goals = rows.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("rest"),
        (expected[0] / FIXED_POINT).alias("e1"),
        (expected[1] / FIXED_POINT).alias("e2"),
    )

    def with_cut(goals: DataFrame, cut: DataFrame, k: int) -> DataFrame:
        c = cut.select(F.col("source").alias("_source"), F.col("cut").alias(f"cut{k}"), F.col("taken").alias(f"t{k}"))
        joined = goals.join(c, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        return joined.withColumn(f"t{k}", F.coalesce(F.col(f"t{k}"), F.lit(0)))

    large = open_rows.filter("stratum < 3").withColumn("_base", F.lit(0).cast("long"))
    goals = with_cut(goals, _last_taken(large.filter("stratum = 1"), goals.withColumn("goal", F.col("e1"))), 1)
    goals = with_cut(goals, _last_taken(large.filter("stratum = 2"), goals.withColumn("goal", F.col("e1") + F.col("e2") - F.col("t1"))), 2)
    small = _cut_small(open_rows.filter("stratum = 3"), goals.withColumn("goal", F.col("rest") - F.col("t1") - F.col("t2")))
    s = small.select(F.col("source").alias("_source"), "slice", F.col("cut").alias("cut3"))
    return goals.join(s, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "cut1", "cut2", "cut3", "slice")


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    max_copies: int = 2,
    seed: int = 20240601,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    preference: str | None = None,
    size_preference: tuple[tuple[int, float], ...] = SIZE_PREFERENCE,
) -> DataFrame:
    """Copies of every document in the mix: doc_id, source, size, source_size, target, pi, copies, taken.

    ``share`` is the fraction of all words that the mix aims at. A document's expected copies are in proportion
    to its preference within its source: ``size_preference`` by its size, times the column ``preference`` if
    one is named (null or below 0: none), rounded to 64ths.

    Null text counts as empty; null sources are one source, the last; a document of no words takes none.
    Rows of one id are taken or left together, each with its own size. An empty table gives an empty mix.
    Only the named columns are read, so extra columns cannot clash.
    """
    sized = staged(sizes(docs, id_col=id_col, text_col=text_col, source_col=source_col, preference=preference, size_preference=size_preference), "mix-sizes")
    targets = source_targets(sized, weights=weights, share=share, max_copies=max_copies)
    targets = staged(with_levels(sized, targets, max_copies=max_copies), "mix-targets")
    rows = staged(ranked(sized, targets, max_copies=max_copies, seed=seed), "mix-ranked")
    c = staged(cuts(rows, targets), "mix-cuts").withColumnRenamed("source", "_source").withColumnRenamed("slice", "_slice")
    place = F.struct("q", "doc_id")
    slice_of = F.floor(F.col("q") / (1.0 + F.col("q")) * SLICES)
    taken = (
        F.when(F.col("q").isNull(), False)
        .when(F.col("stratum") == 1, place <= F.col("cut1"))
        .when(F.col("stratum") == 2, place <= F.col("cut2"))
        .otherwise((slice_of < F.col("_slice")) | ((slice_of == F.col("_slice")) & F.col("cut3").isNotNull() & (place <= F.col("cut3"))))
    )
    copies = F.col("whole") + F.coalesce(taken, F.lit(False)).cast("long")
    joined = rows.join(c, F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", "pi", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each row as often as it is taken.

    Rows are matched by id, source and size, which decide the number of copies: rows that agree in all
    three have the same. Columns of any name are kept.
    """
    id_col, text_col, source_col = (options.get(f"{c}_col", d) for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    mine = unused(docs, "mix_id", "mix_source", "mix_size", "mix_copies", "mix_copy", "mix_words")
    copies = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).filter("copies > 0").toDF(*mine[:4])
    rows = docs.withColumn(mine[5], word_count(text_col))
    same = rows[id_col].eqNullSafe(F.col(mine[0])) & rows[source_col].eqNullSafe(F.col(mine[1])) & (F.col(mine[5]) == F.col(mine[2]))
    repeated = rows.join(copies, same).withColumn(mine[4], F.explode(F.sequence(F.lit(1), F.col(mine[3]).cast("int"))))
    return repeated.select(*docs.columns)
