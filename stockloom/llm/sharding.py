"""Sharding by jump consistent hashing.

The shard of a key follows from the key and the number of shards alone: a linear congruential generator
seeded by the key jumps ahead over the shard numbers, and the last landing below the number of shards is
the shard. There is no ring and no table; with one more shard a key stays or moves into the new shard.

Slots number the rows of a shard without gaps. A shard grows with the data, so it is not ranked in one
task: its rows fall into slices by a hash of the key, slice counts give each slice its first slot, and only
the rows of a slice are ranked together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.words import text_or_empty
from stockloom.session import staged

# Multiplier and increment of the generator, as two 32-bit halves.
MULTIPLIER = 2862933555777941757
INCREMENT = 1

_LOW32 = (1 << 32) - 1
_LOW16 = (1 << 16) - 1
STEPS = 48


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """The generator's next 64-bit state, in halves so that no product leaves a signed long."""
    by_high, by_low = MULTIPLIER >> 32, MULTIPLIER & _LOW32

    def times_low(x: Column) -> tuple[Column, Column]:
        """x * by_low for a 32-bit x, as (carry into the high half, low half not yet cut)."""
        upper = F.shiftright(x, 16) * by_low
        return F.shiftright(upper, 16), x.bitwiseAND(_LOW16) * by_low + F.shiftleft(upper.bitwiseAND(_LOW16), 16)

    carry, sum_low = times_low(low)
    sum_low = sum_low + INCREMENT
    _, cross = times_low(high)
    sum_high = F.shiftright(sum_low, 32) + carry + (low * by_high).bitwiseAND(_LOW32) + cross.bitwiseAND(_LOW32)
    return sum_high.bitwiseAND(_LOW32), sum_low.bitwiseAND(_LOW32)


def _jump(state: Column, shards: int) -> Column:
    """One jump: the landing becomes the shard while it is below ``shards``."""
    high, low = _next_state(state["high"], state["low"])
    ahead = ((state["next"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
    moved = F.struct(state["next"].alias("shard"), ahead.alias("next"), high.alias("high"), low.alias("low"))
    return F.when(state["next"] < shards, moved).otherwise(state)


def jump_state(key: Column, shards: int) -> Column:
    """Struct whose ``shard`` is the key's shard and whose ``next`` is the first landing past the last shard.

    A key needs about ln(shards) jumps, never more than ``shards``; the rare ones beyond ``STEPS`` go on.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("shard"), zero.alias("next"), F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(_LOW32).alias("low"))
    first = min(STEPS, shards)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, lambda s, _: _jump(s, shards))
    if shards <= STEPS:
        return state
    more = F.aggregate(F.sequence(F.lit(first + 1), F.lit(shards)), state, lambda s, _: _jump(s, shards))
    return F.when(state["next"] < shards, more).otherwise(state)


def stable_key(df: DataFrame, column: str) -> Column:
    """A long for any key type: integers as they are, others by hash, null as the hash of nothing."""
    if dict(df.dtypes)[column] in ("bigint", "int", "smallint", "tinyint"):
        return F.coalesce(F.col(column).cast("long"), F.xxhash64(F.lit(None).cast("string")))
    return F.xxhash64(F.col(column))


def assign_shards(docs: DataFrame, *, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rows_per_slice: int = 250_000) -> DataFrame:
    """Every row with its size, checksum, shard, slot and the shard it would have with one shard more.

    Null text counts as no bytes (size 1, checksum 0). A null id is a key of its own. Repeated ids share a
    shard and get a slot each, in order of size and checksum. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        stable_key(docs, id_col).alias("_key"),
    )
    rows = rows.withColumn("_state", jump_state(F.col("_key"), shards))
    rows = rows.withColumn("shard", F.col("_state.shard").cast("int"))
    rows = rows.withColumn("grown_shard", F.when(F.col("_state.next") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int"))
    rows = staged(rows.drop("_state"), "shards")
    slices = max(1, rows.count() // (rows_per_slice * shards) + 1)
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("_key", F.lit("slice")), F.lit(slices)))
    counts = rows.groupBy("shard", "_slice").count()
    along = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("shard").alias("_shard"), F.col("_slice").alias("_at"), F.coalesce(F.sum("count").over(along), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_slice").orderBy("doc_id", "size", "text_crc32")
    rows = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    rows = rows.join(first, (F.col("shard") == F.col("_shard")) & (F.col("_slice") == F.col("_at")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_first") + F.col("_rank")).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, folder: str, *, shards: int = 16, id_col: str = "doc_id", files_per_shard: int = 1) -> None:
    """Write all columns of the documents to one folder per shard (``shard=0`` and so on).

    ``files_per_shard`` spreads each shard over as many tasks; raise it with the data.
    """
    shard = jump_state(stable_key(docs, id_col), shards)["shard"].cast("int")
    spread = F.pmod(F.xxhash64(F.col(id_col), F.lit("file")), F.lit(files_per_shard))
    out = docs.withColumn("shard", shard).repartition(shards * files_per_shard, "shard", spread)
    out.write.mode("errorifexists").partitionBy("shard").parquet(folder)
