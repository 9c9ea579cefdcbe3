"""N-gram Jaccard join by chosen paths.

Every document becomes its set of word shingles, and equal sets become one. A set is embedded as ``width``
tokens (position, MinHash value); two sets share a token with a probability equal to their similarity.

A run starts all sets in one root. At each node a few positions are sampled (one for certain, a second
with probability 1 / similarity - 1, so a pair at the threshold keeps one common child on average), and the
sets move to the child named by the node, the position and their token. Nodes of up to ``small`` sets are
compared by brute force. In a larger one all sets are compared with one leader: similar ones are linked to
it, those close enough to it that it can stand for them go no further, and the others split again. After
``depth`` levels what is left is compared in blocks. Runs are repeated until a pair at the threshold is met
with probability ``recall``.

Comparisons of signatures only need to bring similar sets into one candidate group, so they emit a spanning
forest, never pairs. Inside a candidate group the exact check compares whole shingle sets block by block
and returns counts and forests again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.components import components
from stockloom.llm.shingles import forget_words, linked, mix64, roots, seeds, shingle_set, signature
from stockloom.session import staged

WIDTH = 128
SMALL = 64
DEPTH = 4
BLOCK_SETS = 1024
BLOCK_SHINGLES = 400_000
NEAR_LEADER = 0.95
SLACK = 0.2


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs that bring a pair at ``similarity`` together at ``depth`` with probability ``recall``."""
    second = 1 / similarity - 1
    lost = 0.0
    for _ in range(depth):
        lost = (1 - similarity + similarity * lost) * (1 - second * similarity + second * similarity * lost)
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def _key(hashes: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(hashes.tobytes()) if len(hashes) else ""


def _signatures(shingle_words: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        multipliers = seeds(WIDTH)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text, shingle_words)
                if len(s):
                    out.append((doc_id, len(s), _key(s), signature(s, multipliers).tobytes()))
                else:
                    out.append((doc_id, 0, None, None))
            yield pd.DataFrame(out, columns=["doc_id", "n", "set_key", "sig"])
        forget_words()

    return sets


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), WIDTH)


def _children(nodes: np.ndarray, sigs: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for the sampled positions of each row's node."""
    rows, children = [], []
    for salt in (1, 2):
        draw = mix64(nodes + mix64(np.array([salt], dtype=np.uint64)))
        taken = np.arange(len(nodes)) if salt == 1 else np.flatnonzero((draw >> np.uint64(40)).astype(np.float64) / (1 << 24) < second)
        at = (draw[taken] % np.uint64(WIDTH)).astype(np.int64)
        token = sigs[taken, at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32))
        rows.append(taken)
        children.append(mix64(mix64(nodes[taken]) ^ mix64(token + np.uint64(0xD6E8FEB86659FD93))))
    return np.concatenate(rows), np.concatenate(children)


def _start(runs: int, second: float):
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            sigs, reps = _matrix(batch["sig"]), batch["rep"].to_numpy()
            for run in range(runs):
                rows, child = _children(np.full(len(reps), run + 1, dtype=np.uint64), sigs, second)
                yield pd.DataFrame({"node": child.view(np.int64), "rep": reps[rows]}).drop_duplicates()

    return expand


def _split(similarity: float, second: float):
    """Large nodes: links to the leader (kind 0: rep, leader) and the next level's rows (kind 1: rep, child)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            sigs, reps = _matrix(batch["sig"]), batch["rep"].to_numpy()
            same = (sigs == _matrix(batch["leader_sig"])).mean(axis=1)
            leader = batch["leader"].to_numpy()
            link = (same >= similarity - SLACK) & (reps != leader)
            yield pd.DataFrame({"kind": 0, "other": leader[link], "rep": reps[link]})
            open_rows = np.flatnonzero((same < NEAR_LEADER) | (reps == leader))
            rows, child = _children(batch["node"].to_numpy().view(np.uint64)[open_rows], sigs[open_rows], second)
            yield pd.DataFrame({"kind": 1, "other": child.view(np.int64), "rep": reps[open_rows][rows]}).drop_duplicates()

    return split


def _forest(reps: np.ndarray, adjacent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = roots(adjacent)
    inner = root != np.arange(len(root))
    return reps[inner], reps[root[inner]]


def _similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """True where two signatures agree in a share of at least ``least`` of their positions."""
    out = np.empty((len(a), len(b)), dtype=bool)
    for at in range(0, len(a), 64):
        out[at : at + 64] = (a[at : at + 64, None, :] == b[None, :, :]).mean(axis=2) >= least
    return out


def _runs_of(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of batches sorted by ``key``, each whole; a group is bounded by its caller."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        values = batch[key].to_numpy()
        edges = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), len(values)]
        for begin, end in zip(edges, edges[1:]):
            part = batch.iloc[begin:end]
            if rest and rest[0][key].iloc[0] != part[key].iloc[0]:
                yield rest[0] if len(rest) == 1 else pd.concat(rest)
                rest = []
            rest.append(part)
    if rest:
        yield rest[0] if len(rest) == 1 else pd.concat(rest)


def _leaves(similarity: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for group in _runs_of(batches, "node"):
            sigs = _matrix(group["sig"])
            x, y = _forest(group["rep"].to_numpy(), _similar(sigs, sigs, similarity - SLACK))
            a.append(x)
            b.append(y)
            if len(a) >= 20_000:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return compare


def _leaf_cell(similarity: float):
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sigs, reps = _matrix(group["sig"]), group["rep"].to_numpy()
        left, right = np.flatnonzero(group["block"] == group["i"]), np.flatnonzero(group["block"] == group["j"])
        near = np.zeros((len(reps), len(reps)), dtype=bool)
        near[np.ix_(left, right)] = _similar(sigs[left], sigs[right], similarity - SLACK)
        x, y = _forest(reps, near | near.T)
        return pd.DataFrame({"a": x, "b": y})

    return compare


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """Rows (with ``blocks``) once for each pair of blocks that holds their own block."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return rows.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other")).drop("_other")


def candidate_groups(sets: DataFrame, *, similarity: float, recall: float, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """(id, component) of the sets (rep, sig) that chosen paths bring together; sets that met none are absent."""
    second = 1 / similarity - 1
    level = staged(sets.select("rep", "sig").mapInPandas(_start(runs_for(recall, similarity, depth), second), "node long, rep long"), "paths")
    leaves, edges, large = [], [], None
    for step in range(1, depth + 1):
        counts = level.groupBy("node").agg(F.count(F.lit(1)).alias("held"), F.min("rep").alias("leader")).filter("held > 1")
        counts = staged(counts.withColumnRenamed("node", "_node"), "nodes")
        met = level.join(counts, F.col("node") == F.col("_node")).drop("_node")
        leaves.append(met.filter(F.col("held") <= small).select("node", "rep"))
        large = met.filter(F.col("held") > small)
        big = counts.filter(F.col("held") > small)
        if step == depth or big.isEmpty():
            break
        lead = big.select("_node", F.col("leader").alias("_rep")).join(sets.select(F.col("rep").alias("_rep"), F.col("sig").alias("leader_sig")), "_rep")
        known = large.join(sets.select("rep", "sig"), "rep").join(lead.select("_node", "leader_sig"), F.col("node") == F.col("_node"))
        done = known.select("node", "rep", "sig", "leader", "leader_sig").mapInPandas(_split(similarity, second), "kind int, other long, rep long")
        done = staged(done, "paths")
        edges.append(done.filter("kind = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")))
        level = done.filter("kind = 1").select(F.col("other").alias("node"), "rep").distinct()
    leaf_rows = leaves[0]
    for more in leaves[1:]:
        leaf_rows = leaf_rows.unionByName(more)
    leaf_rows = leaf_rows.join(sets.select("rep", "sig"), "rep")
    edges.append(leaf_rows.repartition("node").sortWithinPartitions("node").select("node", "rep", "sig").mapInPandas(_leaves(similarity), "a long, b long"))
    rest = large.withColumn("blocks", F.ceil(F.col("held") / BLOCK_SETS)).join(sets.select("rep", "sig"), "rep")
    rest = _cells(rest.select("node", "rep", "sig", "blocks"), "node")
    edges.append(rest.groupBy("node", "i", "j").applyInPandas(_leaf_cell(similarity), "a long, b long"))
    all_edges = edges[0]
    for more in edges[1:]:
        all_edges = all_edges.unionByName(more)
    return components(all_edges)


def _exact(group: pd.DataFrame, similarity: float, shingle_words: int) -> pd.DataFrame:
    """Links of the sets of one cell: counts of linked copies, and the least set of each part they form."""
    sets = [shingle_set(t, shingle_words) for t in group.pop("text")]
    if group["rep"].duplicated().any():
        keys = [_key(s) for s in sets]
        best = {rep: k for k, rep in sorted(enumerate(group["rep"]), key=lambda x: keys[x[0]])}
        keep = sorted(best.values())
        group, sets = group.iloc[keep], [sets[k] for k in keep]
    reps, copies = group["rep"].to_numpy(), group["copies"].to_numpy().astype(np.float64)
    left, right = np.flatnonzero(group["block"] == group["i"]), np.flatnonzero(group["block"] == group["j"])
    near = np.zeros((len(reps), len(reps)), dtype=bool)
    near[np.ix_(left, right)] = linked([sets[k] for k in left], [sets[k] for k in right], similarity)
    near |= near.T
    np.fill_diagonal(near, False)
    links = np.array([copies[row].sum() for row in near], dtype=np.int64)
    order = np.argsort(reps, kind="stable")
    root = roots(near[np.ix_(order, order)])
    return pd.DataFrame({"rep": reps[order], "links": links[order], "root": reps[order][root]})


def _exact_small(similarity: float, shingle_words: int):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _runs_of(batches, "component"):
            yield _exact(group, similarity, shingle_words)
        forget_words()

    return compare


def near_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = 0.8,
    shingle_words: int = 5,
    recall: float = 0.999,
    small: int = SMALL,
    depth: int = DEPTH,
) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), links and n_shingles.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least ``similarity``;
    classes are the connected parts; ``links`` counts the other documents linked to one, copies included.
    A text of fewer than ``shingle_words`` words is one shingle. Null, empty and blank texts have no
    shingle, no link and a class of their own. Rows without an id are left out of the join and get a null
    class. Rows that repeat an id are one document, the one whose set has the greatest digest. Only the named
    columns are read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shingled = rows.filter("doc_id is not null").mapInPandas(_signatures(shingle_words), "doc_id long, n long, set_key string, sig binary")
    shingled = shingled.groupBy("doc_id").agg(F.max(F.struct("set_key", "n", "sig")).alias("s")).select("doc_id", "s.n", "s.set_key", "s.sig")
    shingled = staged(shingled, "shingles")
    full = shingled.filter("n > 0")
    sets = staged(full.groupBy("set_key", "sig", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    groups = staged(candidate_groups(sets, similarity=similarity, recall=recall, small=small, depth=depth), "candidates")
    members = groups.join(sets.select("rep", "copies", "n"), F.col("id") == F.col("rep")).select("component", "rep", "copies", "n")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    sizes = members.groupBy(F.col("component").alias("_component")).agg(blocks.alias("blocks"))
    members = members.join(sizes, F.col("component") == F.col("_component")).drop("_component", "n")
    texts = rows.join(members, F.col("doc_id") == F.col("rep")).select("component", "rep", "copies", "blocks", "text")
    texts = staged(texts.repartition("component", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), F.lit(64)))), "candidate-texts")
    one = texts.filter("blocks = 1").withColumn("block", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    one = one.repartition("component").sortWithinPartitions("component")
    schema = "rep long, links long, root long"
    whole = one.mapInPandas(_exact_small(similarity, shingle_words), schema)
    cells = _cells(texts.filter("blocks > 1"), "component").groupBy("component", "i", "j")
    parts = cells.applyInPandas(lambda group: _exact(group, similarity, shingle_words), schema)
    found = staged(whole.withColumn("whole", F.lit(True)).unionByName(parts.withColumn("whole", F.lit(False))), "links")
    forest = found.filter("not whole and rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    joined = components(forest).select(F.col("id").alias("_id"), F.col("component").alias("_class"))
    verdict = found.groupBy("rep").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    verdict = verdict.join(joined, F.col("rep") == F.col("_id"), "left").select("rep", "links", F.coalesce("_class", "root").alias("class_id"))
    by_set = sets.select(F.col("set_key").alias("_key"), F.col("rep").alias("_rep"), "copies")
    result = shingled.select("doc_id", "n", "set_key").join(by_set, F.col("set_key") == F.col("_key"), "left")
    result = result.join(verdict, F.col("_rep") == F.col("rep"), "left")
    result = result.select(
        "doc_id",
        F.coalesce("class_id", "_rep", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("links"),
        F.col("n").alias("n_shingles"),
    )
    null = rows.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(0).cast("long").alias("n_shingles"))
    return result.unionByName(null)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that stay, with all their columns: of each class the one with the least id, and rows without an id."""
    classes = near_classes(docs, id_col=id_col, **options).filter("doc_id = class_id").select(F.col("class_id").alias("_class_id")).distinct()
    return docs.join(classes, docs[id_col] == F.col("_class_id"), "left_semi").unionByName(docs.filter(docs[id_col].isNull()))
