"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn's id is a digest of its role and text. Conversations are laid out in blocks of ``width`` turns, one
row per conversation and block with one id column per position. ``GROUP BY block, prior, ROLLUP (id 1, ...,
id width)`` aggregates all prefixes of a block together, and ``grouping_id`` tells how deep each group is.
Long conversations go on in further blocks, keyed by the node in which the block before ended (``prior``):
a digest of all earlier blocks, found for all blocks at once by doubling, so the number of rounds is the
logarithm of the longest conversation's blocks.

Every node belongs to its smallest member. A member is the smallest of a node's members from some depth on
and down to its end, so sums over a subtree are sums, over the members, of what they own below: a second
ROLLUP of the same columns gives children, leaves and saved tokens without any join between nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.words import text_or_empty, word_count
from stockloom.operators.running import SLICE_ROWS, ranks, running_totals
from stockloom.session import staged

WIDTH = 8
GROUP = 20
ENDS_PER_PIECE = 512


def _longs(digest: Column) -> tuple[Column, Column]:
    """The first 128 bits of a hexadecimal digest as two longs."""
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def _digest(*numbers: Column) -> Column:
    """SHA-256 of the numbers that are not null, in order."""
    return F.sha2(F.concat_ws(",", *[n.cast("string") for n in numbers]), 256)


def turns_of(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv, turn, hi and lo (the turn's id) and words. Null role and text are empty.

    Rows without a conversation belong to none and are left out.
    """
    role = text_or_empty(role_col)
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text_or_empty(text_col)), 256)
    hi, lo = _longs(F.col("_digest"))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), digest.alias("_digest"), word_count(text_col).alias("words")
    )
    return rows.select("conv", "turn", hi.alias("hi"), lo.alias("lo"), "words")


def in_order(turns: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The turns with ``pos`` from 1 in their conversation: null turns first, turns of one number by their ids.

    A conversation with very many turns is numbered in slices.
    """
    return ranks(turns, ["conv"], ["turn", "hi", "lo"], "pos", slice_rows).select("conv", "pos", "hi", "lo", "words")


def rebuilt(own: DataFrame, group: int = GROUP) -> DataFrame:
    """Conversations as (conv, pos, hi, lo, words, len), with one row at ``pos`` 0 for each, even a turnless one.

    The first h turns of conversation c are those of c - c % ``group``, h being crc32(c) % 4; c's own turns
    after its first h follow.
    """
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    lent = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    convs = convs.select("conv", "n", lent.alias("h"), (F.col("conv") - F.col("conv") % group).alias("donor"))
    donors = convs.select(F.col("conv").alias("_donor"), F.col("n").alias("_n"))
    convs = convs.join(donors, F.col("donor") == F.col("_donor"), "left")
    taken = F.least("h", F.coalesce("_n", F.lit(0)))
    length = taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = staged(convs.select("conv", "h", "donor", taken.alias("taken"), length.alias("len")), "trie-conversations")
    heads = own.filter("pos <= 3").select(F.col("conv").alias("_donor"), "pos", "hi", "lo", "words")
    first = convs.join(heads, F.col("donor") == F.col("_donor")).filter("pos <= h").select("conv", "pos", "hi", "lo", "words", "len")
    later = own.join(convs, "conv").filter("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "hi", "lo", "words", "len")
    none = F.lit(None).cast("long")
    marks = convs.select("conv", F.lit(0).cast("long").alias("pos"), none.alias("hi"), none.alias("lo"), none.alias("words"), "len")
    return first.unionByName(later).unionByName(marks)


def _ids(width: int) -> list[str]:
    return [f"{part}{k}" for k in range(1, width + 1) for part in ("hi", "lo")]


def blocks_of(turns: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per conversation and block of ``width`` positions: len, the id columns hi1, lo1, ... and words1, ..."""
    at = F.greatest(F.col("pos") - 1, F.lit(0))
    rows = turns.withColumns({"block": F.floor(at / width).cast("long"), "_slot": F.when(F.col("pos") > 0, at % width + 1)})
    slots = [F.max(F.when(F.col("_slot") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, width + 1) for c in ("hi", "lo", "words")]
    return rows.groupBy("conv", "block").agg(F.max("len").alias("len"), *slots)


def with_prior(blocks: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks with prior_hi and prior_lo: what identifies all earlier turns of the conversation; null in block 0."""
    longest = blocks.agg(F.max("block")).first()[0] or 0
    none = F.lit(None).cast("long")
    first = blocks.filter("block = 0").withColumns({"prior_hi": none, "prior_lo": none})
    if not longest:
        return first
    hi, lo = _longs(_digest(*[F.col(c) for c in _ids(width)]))
    followed = blocks.filter(F.col("len") > (F.col("block") + 1) * width).select("conv", "block", hi.alias("hi"), lo.alias("lo"))
    prefix, step = staged(followed, "trie-prefix"), 1
    while step < longest:
        before = prefix.select("conv", (F.col("block") + step).alias("block"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
        both = _digest(F.col("_hi"), F.col("_lo"), F.col("hi"), F.col("lo"))
        joined = prefix.filter(F.col("block") >= step).join(before, ["conv", "block"]).select("conv", "block", *[c.alias(n) for c, n in zip(_longs(both), ("hi", "lo"))])
        prefix, step = staged(prefix.filter(F.col("block") < step).unionByName(joined), "trie-prefix"), 2 * step
    prior = prefix.select("conv", (F.col("block") + 1).alias("block"), F.col("hi").alias("prior_hi"), F.col("lo").alias("prior_lo"))
    return first.unionByName(blocks.filter("block > 0").join(prior, ["conv", "block"]))


def _rolled_up(rows: DataFrame, aggregates: str, width: int) -> DataFrame:
    """One row per prefix of the blocks: the ids, ``aggregates`` and ``deep``, the number of turns it has in its block.

    Groups deeper than their conversation are no prefixes; an empty prefix counts in the first block only.
    """
    columns = ", ".join(f"(hi{k}, lo{k})" for k in range(1, width + 1))
    ids = ", ".join(_ids(width))
    grouped = rows.sparkSession.sql(
        f"SELECT block, prior_hi, prior_lo, {ids}, grouping_id() AS gid, {aggregates} FROM {{rows}} GROUP BY block, prior_hi, prior_lo, ROLLUP ({columns})",
        rows=rows,
    )
    deep = F.lit(width) - F.bit_count(F.col("gid")) / 2
    grouped = grouped.withColumn("deep", deep.cast("int")).drop("gid")
    last = F.element_at(F.array(*[F.col(f"hi{k}") for k in range(1, width + 1)]), F.greatest("deep", F.lit(1)))
    return grouped.filter(F.when(F.col("deep") == 0, F.col("block") == 0).otherwise(last.isNotNull()))


def _key(width: int, depth: Column | None = None) -> Column:
    """What names a node: block, prior and the ids up to ``depth`` (all that are there without it)."""
    ids = [F.col(c).cast("string") for c in ("prior_hi", "prior_lo")]
    for k in range(1, width + 1):
        for c in (f"hi{k}", f"lo{k}"):
            ids.append(F.col(c).cast("string") if depth is None else F.when(depth >= k, F.col(c).cast("string")))
    return F.substring(F.sha2(F.concat_ws(",", F.col("block").cast("string"), *ids), 256), 1, 32)


def _end_digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces come sorted by node and place; a node may go on in the next batch. Only a digest is kept of it."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, piece in zip(batch["key"], batch["piece"]):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def _ends(rows: DataFrame, width: int, per_piece: int) -> DataFrame:
    """(key, ends_sha256) of the nodes in which a conversation ends; their ids are joined in pieces of bounded size."""
    last = rows.filter(F.col("block") == F.floor(F.greatest(F.col("len") - 1, F.lit(0)) / width))
    place = F.floor(F.col("conv") / per_piece).alias("place")
    pieces = last.groupBy(_key(width).alias("key"), place).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    joined = pieces.select("key", "place", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("piece"))
    return joined.repartition("key").sortWithinPartitions("key", "place").select("key", "piece").mapInPandas(_end_digests, "key string, ends_sha256 string")


def _owned_by_block(nodes: DataFrame, width: int, many_blocks: bool) -> DataFrame:
    """Per smallest member and block: saved1, ... by position, and ``later``, what it owns in later blocks."""
    slot = (F.col("depth") - 1) % width + 1
    block = F.floor((F.col("depth") - 1) / width).cast("long")
    owned = nodes.filter("depth > 0").groupBy("conv_id", block.alias("block")).agg(
        *[F.coalesce(F.max(F.when(slot == k, F.col("saved"))), F.lit(0)).alias(f"saved{k}") for k in range(1, width + 1)]
    )
    if not many_blocks:
        return owned.withColumn("later", F.lit(0).cast("long"))
    total = reduce(lambda a, b: a + b, [F.col(f"saved{k}") for k in range(1, width + 1)])
    backwards = running_totals(owned.withColumn("_back", -F.col("block")), ["conv_id"], ["_back"], {"_below": total})
    return backwards.withColumn("later", (F.col("_below") - total).cast("long")).drop("_back", "_below")


def trie(conversations: DataFrame, *, group: int = GROUP, width: int = WIDTH, per_piece: int = ENDS_PER_PIECE, slice_rows: int = SLICE_ROWS, **columns: str) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations (see ``rebuilt``), from the textless root down.

    Columns, all long but the digest: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, members but one times words of the last
    turn) and ends_sha256 (of the ascending decimal ids of the members that end here, joined by commas).
    Only the named ``columns`` are read. Rows without a conversation are left out, null turns come first,
    turns of one number are in order of their ids (repeated rows are repeated turns), and an empty table
    gives no node.
    """
    turns = staged(turns_of(conversations, **columns), "trie-turns")
    own = staged(in_order(turns, slice_rows), "trie-positions")
    blocks = staged(blocks_of(rebuilt(own, group), width), "trie-blocks")
    rows = staged(with_prior(blocks, width), "trie-rows")

    depth = F.col("block") * width + F.col("deep")
    spoken = ", ".join(f"max(words{k}) AS words{k}" for k in range(1, width + 1))
    nodes = _rolled_up(rows, f"min(conv) AS conv_id, count(1) AS n_convs, max(len) AS longest, {spoken}", width)
    last_words = F.element_at(F.array(*[F.col(f"words{k}") for k in range(1, width + 1)]), F.greatest("deep", F.lit(1)))
    saved = F.when(F.col("deep") > 0, (F.col("n_convs") - 1) * last_words).otherwise(F.lit(0))
    nodes = nodes.select(_key(width).alias("key"), "conv_id", depth.alias("depth"), saved.alias("saved"), (F.col("longest") == depth).alias("ends"))
    nodes = staged(nodes, "trie-nodes")

    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owns_from"), F.max("ends").cast("long").alias("leaf"), F.sum("saved").cast("long").alias("all_saved")
    )
    owned = _owned_by_block(nodes, width, many_blocks=rows.filter("block > 0").select("conv").limit(1).count() > 0)
    own_row = rows.join(owners.withColumnRenamed("conv_id", "_owner"), F.col("conv") == F.col("_owner"), "left").drop("_owner")
    own_row = own_row.join(owned.withColumnsRenamed({"conv_id": "_owner", "block": "_block"}), (F.col("conv") == F.col("_owner")) & (F.col("block") == F.col("_block")), "left")
    above = F.col("owns_from") > (F.col("block") + 1) * width  # owns nothing here, but all of what it owns lies further down
    below = F.coalesce("later", F.when(above, F.col("all_saved")), F.lit(0)).cast("long")
    sums, under = [], below
    for k in range(width, 0, -1):
        under = under + F.coalesce(F.col(f"saved{k}"), F.lit(0))
        sums.append(under.alias(f"under{k}"))
    next_depth = [F.col("block") * width + k + 1 for k in range(width + 1)]
    child = [F.coalesce((F.col("owns_from") <= d) & (d <= F.col("len")), F.lit(False)).cast("long").alias(f"child{k}") for k, d in enumerate(next_depth)]
    full = staged(
        own_row.select("conv", "block", "len", "prior_hi", "prior_lo", *_ids(width), "owns_from", F.coalesce("leaf", F.lit(0)).alias("leaf"), *sums, *child),
        "trie-sums",
    )

    gathered = [f"sum(under{k}) AS under{k}" for k in range(1, width + 1)] + [f"sum(child{k}) AS child{k}" for k in range(width + 1)]
    found = _rolled_up(full, f"min(conv) AS conv_id, count(1) AS n_convs, sum(leaf) AS n_leaves, {', '.join(gathered)}", width)
    found = found.select(
        _key(width).alias("key"), "conv_id", depth.alias("depth"), "n_convs",
        F.element_at(F.array(*[F.col(f"child{k}") for k in range(width + 1)]), F.col("deep") + 1).alias("n_children"), "n_leaves",
        F.element_at(F.array(*[F.col(f"under{k}") for k in range(1, width + 1)]), F.greatest("deep", F.lit(1))).alias("saved_tokens"),
    )
    found = found.join(_ends(full, width, per_piece).withColumnRenamed("key", "_end"), F.col("key") == F.col("_end"), "left")

    # The node above the first one that a conversation owns: found by its key, except for the root.
    root = full.agg(F.min("conv")).first()[0]
    above_block = F.floor((F.col("owns_from") - 2) / width)
    probes = full.filter((F.col("owns_from") >= 2) & (F.col("block") == above_block)).select(
        F.col("conv").alias("_conv"), _key(width, (F.col("owns_from") - 2) % width + 1).alias("_above")
    )
    branch = probes.join(nodes.select("key", F.col("conv_id").alias("_parent")), F.col("_above") == F.col("key")).select("_conv", "_parent")
    start = owners.select(F.col("conv_id").alias("_owner"), "owns_from")
    found = found.join(start, F.col("conv_id") == F.col("_owner")).join(branch, F.col("conv_id") == F.col("_conv"), "left")
    parent = (
        F.when(F.col("depth") == 0, F.lit(None))
        .when(F.col("owns_from") < F.col("depth"), F.col("conv_id"))
        .when(F.col("depth") == 1, F.lit(root))
        .otherwise(F.col("_parent"))
    )
    nobody = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"),
    )
