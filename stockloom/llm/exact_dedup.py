"""Exact dedup over an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normalised form. The directory maps the first bits of a key to a
bucket. It starts at depth 0; while a bucket holds more than ``capacity`` entries, the directory doubles
and the bucket splits by its next bit, up to all 64. Doublings work on the counts of prefixes, 16 bits at a
time: only the keys of slots that are still overfull are counted by the next 16. Entries that share a key
cannot be split; they chain in their bucket.

Texts of one key are compared byte by byte: the owner of a key range groups by key and the text itself.
Copies combine in the tasks that read them, so a group of any size reaches its owner as one row a task.
The index holds one entry per distinct text, without the text: bucket, key, place in the chain, digest,
first id, number of copies. It is written in key order, each file a range of buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.words import SPACE_RUN, text_or_empty, unused
from stockloom.session import staged

CAPACITY = 200_000
STEP = 16


def normalised(column: str) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(column), SPACE_RUN, " ")


def prefix(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a 64-bit key as a number; depth 0 gives 0."""
    if depth in (0, 64):
        return key if depth else F.lit(0).cast("long")
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, *, capacity: int = CAPACITY, step: int = STEP) -> list[DataFrame]:
    """Directory tables, one for every ``step`` bits in use: ``slot`` (the first step, 2 * step, ... bits), ``depth`` and ``bucket``.

    A bucket is the shortest prefix that holds no more than ``capacity`` entries, or a whole key. A slot whose
    bucket is deeper is not in its table but continues in the next one.
    """
    tables, known = [], keys.select("key")
    for bits in range(step, 64 + step, step):
        bits = min(bits, 64)
        open_slots = staged(known.groupBy(prefix(F.col("key"), bits).alias("slot")).count(), "dedup-slots")
        found = []
        for depth in range(max(0, bits - step) + (bits > step), bits + 1):
            if depth == 0:  # one bucket for everything
                everything = open_slots.agg(F.sum("count")).first()[0] or 0
                judged = open_slots.withColumns({"node": F.lit(0).cast("long"), "held": F.lit(everything)})
            else:
                node = F.shiftrightunsigned(F.col("slot"), bits - depth) if bits > depth else F.col("slot")
                held = open_slots.groupBy(node.alias("node")).agg(F.sum("count").alias("held"))
                judged = staged(open_slots.withColumn("_node", node).join(held, F.col("_node") == F.col("node")).drop("_node"), "dedup-slots")
            fits = (F.col("held") <= capacity) | F.lit(depth == 64)
            name = F.format_string(f"%02d-%0{(max(depth, 1) + 3) // 4}x", F.lit(depth), F.col("node"))
            found.append(judged.filter(fits).select("slot", F.lit(depth).alias("depth"), name.alias("bucket")))
            open_slots = judged.filter(~fits).select("slot", "count")
            if open_slots.isEmpty():
                break
        tables.append(reduce(DataFrame.unionByName, found))
        if depth < bits or depth == 64 or open_slots.isEmpty():
            break
        deeper = open_slots.select(F.col("slot").alias("_slot"))
        known = known.join(deeper, prefix(F.col("key"), bits) == F.col("_slot"), "left_semi")
    return tables


def bucket_of(rows: DataFrame, tables: list[DataFrame], step: int = STEP) -> DataFrame:
    """``rows`` (with key) with the ``bucket`` that the directory leads to."""
    open_rows, found = rows, []
    for k, table in enumerate(tables, 1):
        t = table.select(F.col("slot").alias("_slot"), "bucket")
        at_slot = prefix(F.col("key"), min(k * step, 64)) == F.col("_slot")
        found.append(open_rows.join(t, at_slot).drop("_slot"))
        open_rows = open_rows.join(t, at_slot, "left_anti")
    return reduce(DataFrame.unionByName, found)


@dataclass
class Index:
    """The directory's tables and the entries, all on the shared folder."""

    directory: list[DataFrame]
    entries: DataFrame


def build_index(rows: DataFrame, *, capacity: int = CAPACITY) -> Index:
    """Index of ``rows`` (doc_id, text): one entry per distinct text.

    Grouping by the text is the comparison of bytes: two texts are one entry only if all bytes agree.
    """
    texts = rows.select("doc_id", F.col("text").alias("text"), F.xxhash64("text").alias("key"))
    distinct = texts.groupBy("key", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    distinct = staged(distinct.select("key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "dedup-texts")
    slots = [staged(table, "dedup-directory") for table in directory(distinct, capacity=capacity)]
    chain = F.row_number().over(Window.partitionBy("key").orderBy("text_sha256")) - 1
    placed = bucket_of(distinct, slots).withColumn("chain", chain)
    entries = placed.select("bucket", "key", "chain", "text_sha256", "keep_id", "group_size")
    entries = entries.repartitionByRange("key").sortWithinPartitions("key", "chain")
    return Index(slots, staged(entries, "dedup-index"))


def probe(rows: DataFrame, index: Index) -> DataFrame:
    """Each row of ``rows`` (doc_id, key, text_sha256) with its entry: keep_id and group_size."""
    e = index.entries.select(F.col("key").alias("_key"), F.col("text_sha256").alias("_sha"), "bucket", "keep_id", "group_size")
    return rows.join(e, (F.col("key") == F.col("_key")) & (F.col("text_sha256") == F.col("_sha"))).drop("_key", "_sha")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Of equal texts the row with the smallest id stays. Null text counts as empty, so null and empty texts
    are one group. Null ids come last; a group of null ids only keeps all of them as it has no smallest.
    Rows that repeat an id and text are counted each; all rows with the kept id stay. Empty tables give
    empty results. Only the named columns are read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("text"))
    index = build_index(rows, capacity=capacity)
    keyed = rows.select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("text_sha256"))
    found = probe(keyed, index)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket")


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names: one row for each distinct text.

    Of rows that repeat an id and text the one with the least digest of all its columns stays; rows of one id
    with different texts stay each.
    """
    keep_id, keep_sha, sha, digest = unused(docs, "keep_id", "keep_sha", "text_sha", "row_digest")
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, **options)
    kept = groups.filter("kept").groupBy(F.col("doc_id").alias(keep_id), F.col("text_sha256").alias(keep_sha)).agg(F.count(F.lit(1)).alias("rows"))
    marked = docs.withColumn(sha, F.sha2(normalised(text_col), 256))
    same = F.col(id_col).eqNullSafe(F.col(keep_id)) & (F.col(sha) == F.col(keep_sha))
    single = marked.join(kept.filter("rows = 1").drop("rows"), same, "left_semi").select(*docs.columns)
    repeated = marked.join(kept.filter("rows > 1").drop("rows"), same, "left_semi")
    repeated = repeated.withColumn(digest, F.xxhash64(*[F.col(c) for c in docs.columns]))
    least = repeated.groupBy(F.col(id_col).alias(keep_id), F.col(sha).alias(keep_sha)).agg(F.min(F.struct(digest, *docs.columns)).alias("least"))
    return single.unionByName(least.select("least.*").select(*docs.columns))
