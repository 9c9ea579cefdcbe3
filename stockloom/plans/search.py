"""Search over the catalogue and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.text import trigrams, words


def token_search(catalogue: DataFrame, queries: DataFrame) -> DataFrame:
    """entities that hold every word of a query.

    ``catalogue``: entity_type, entity_id, label, tokens. ``queries``: query_id, query. The rank is the
    sum of the weights of the matched tokens. Entities meet a query through an equality join on its rarest
    word only (on one word more for each that need not match, if an id stands for several queries), and the
    other words are looked for in the entity's own tokens: one pair at a time, with nothing to group afterwards.
    """
    entities = catalogue.groupBy("entity_type", "entity_id").agg(F.flatten(F.collect_list("tokens")).alias("_tokens"))
    postings = entities.withColumn("_held", F.array_distinct(F.transform("_tokens", lambda x: x["token"]))).withColumn("token", F.explode("_held"))
    rarity = postings.groupBy("token").agg(F.count(F.lit(1)).alias("_entities"))

    wanted = queries.withColumn("_words", F.array_distinct(words(F.col("query"))))
    terms = wanted.select("query_id", F.size("_words").alias("_n"), F.explode("_words").alias("token")).groupBy("query_id", "token").agg(
        F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_times")
    )
    asked = terms.join(rarity, "token", "left").groupBy("query_id").agg(
        F.max("_n").alias("_n"), F.sort_array(F.collect_list(F.struct(F.coalesce("_entities", F.lit(0)).alias("entities"), "token", "_times"))).alias("_terms")
    )
    asked = asked.select(
        "query_id", "_n", F.transform("_terms", lambda x: x["token"]).alias("_asked"),
        F.map_from_entries(F.transform("_terms", lambda x: F.struct(x["token"], x["_times"]))).alias("_times"),
    )
    probes = asked.select("*", F.posexplode(F.slice("_asked", F.lit(1), F.size("_asked") - F.col("_n") + 1)).alias("_before", "token"))

    met_before = F.arrays_overlap(F.slice("_asked", F.lit(1), F.col("_before")), F.col("_held"))
    matched = postings.join(probes, "token").filter(~met_before & (F.size(F.array_intersect("_asked", "_held")) == F.col("_n")))

    def weight(letter):
        return F.when(letter == "A", 1.0).when(letter == "B", 0.4).when(letter == "C", 0.2).otherwise(0.1)

    times = lambda x: F.coalesce(F.try_element_at("_times", x["token"]), F.lit(0))
    rank = F.aggregate("_tokens", F.lit(0.0), lambda total, x: total + weight(x["weight"]) * times(x))
    return matched.select("query_id", "entity_type", "entity_id", rank.alias("rank"))


def similar_names(names: DataFrame, queries: DataFrame, at_least: float = 0.3) -> DataFrame:
    """names whose trigrams overlap those of a query: shared / (both together), from ``at_least`` (over 0) up.

    ``names``: id, name. ``queries``: query_id, query. Equal names and equal queries are compared once, and only
    those that ``name_candidates`` leaves. The ids of both are attached afterwards: the rows grow with the copies of a name
    times those of a query, so the names of a text are dealt out to slots and its queries go to each of them.
    """
    asked_by = queries.filter(F.col("query_id").isNotNull()).select("query_id", "query")
    distinct, asked, pairs = name_candidates(names, asked_by.select(F.col("query").alias("query_id"), "query").distinct(), at_least)
    both = pairs.join(distinct, "name").join(asked, "query_id")
    shared = F.size(F.array_intersect("_grams", "_asked"))
    scored = both.withColumn("similarity", shared / (F.size("_grams") + F.size("_asked") - shared))
    similar = scored.filter(F.col("similarity") >= at_least).select(F.col("query_id").alias("query"), "name", "similarity")
    slots = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = similar.join(names, "name").withColumn("_slot", F.pmod(F.xxhash64("id"), F.lit(slots))).repartition(slots, "query", "_slot")
    everywhere = asked_by.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slots - 1).cast("bigint"))))
    return named.join(everywhere.hint("merge"), ["query", "_slot"]).select("query_id", "id", "name", "similarity")


def similar_name_classes(names: DataFrame, queries: DataFrame, at_least: float = 0.3) -> DataFrame:
    """F14 in a shorter form, for names and queries with many copies: links between texts, and who has which text.

    The least id stands for all rows of one text. Returns kind, class_id, id, name, similarity: a ``link`` ties the class
    of a query to that of a similar name (``id``); ``query`` and ``name`` rows tell the class of each query and each name.
    So the rows follow the input, where every query beside every copy of a name would grow with its square.
    """
    given = {"query": queries.select(F.col("query_id").alias("id"), F.col("query").alias("name")), "name": names.select("id", "name")}
    classes = {kind: rows.groupBy("name").agg(F.min("id").alias("class_id")) for kind, rows in given.items()}
    links = similar_names(
        classes["name"].select(F.col("class_id").alias("id"), "name"), classes["query"].select(F.col("class_id").alias("query_id"), F.col("name").alias("query")), at_least
    ).select(F.lit("link").alias("kind"), F.col("query_id").alias("class_id"), "id", "name", "similarity")
    for kind, rows in given.items():
        of = classes[kind].withColumnRenamed("name", "_text")
        members = rows.join(of, F.col("name").eqNullSafe(F.col("_text")))
        links = links.unionByName(members.select(F.lit(kind).alias("kind"), "class_id", "id", "name", F.lit(None).cast("double").alias("similarity")))
    return links


def name_candidates(names: DataFrame, queries: DataFrame, at_least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names with their trigrams, queries with theirs, and the pairs (query_id, name) that can be similar.

    Two sets of similarity t hold at least t times the larger one in common. So a pair is left out if one set
    is shorter than t times the other; and as each set can miss only part of the common trigrams, a similar
    pair shares one among the first of both in one fixed order. With the rarest trigrams first, common ones
    bring no pairs together. No similar pair is lost.
    """
    distinct = names.select("name").distinct().withColumn("_grams", trigrams(F.col("name")))
    asked = queries.select("query_id", trigrams(F.col("query")).alias("_asked"))
    rarity = distinct.select(F.explode("_grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("_held"))

    def first_grams(rows: DataFrame, key: str, grams: str, size: str) -> DataFrame:
        """(key, size, gram) for the first trigrams of each set; its size less what a similar set must share, and one."""
        each = rows.select(key, F.size(grams).alias(size), F.explode(grams).alias("gram")).join(rarity, "gram", "left")
        ordered = each.groupBy(key, size).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("_held", F.lit(0)), "gram"))).alias("_in_order"))
        kept = F.col(size) - F.ceil(F.col(size) * at_least - 1e-9) + 1
        return ordered.select(key, size, F.explode(F.slice("_in_order", F.lit(1), kept.cast("int"))).alias("_g")).select(key, size, F.col("_g.gram").alias("gram"))

    left = first_grams(distinct, "name", "_grams", "_size")
    right = first_grams(asked, "query_id", "_asked", "_n")
    long_enough = (F.least("_size", "_n") + 1e-9) >= F.greatest("_size", "_n") * at_least
    return distinct, asked, left.join(right, "gram").filter(long_enough).select("query_id", "name").distinct()


def json_equals(column: str, path: str, value: str) -> Column:
    """the JSON text holds ``value`` at ``path``."""
    return F.get_json_object(F.col(column), path) == F.lit(value)


def json_has(column: str, path: str) -> Column:
    return F.get_json_object(F.col(column), path).isNotNull()


def json_contains(column: str, **members: str) -> Column:
    """the JSON object contains all ``members`` at its top level."""
    condition = F.lit(True)
    for name, value in members.items():
        condition = condition & json_equals(column, f"$.{name}", value)
    return condition
