"""Whitening of embeddings from a QR of their centred rows.

Entries become integers floor(``scale`` * c). The fit list, each distinct integer vector once, is written to
the shared folder. Its size and sums are exact. Every task reduces its centred rows, block after block, to
one triangular factor; factors are stacked and reduced eight at a time until one is left, a square matrix
of the dimension. ``bidiagonal`` finds its leading singular values and right vectors on the driver: no
covariance is ever formed from products of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.bidiagonal import principal
from stockloom.session import staged

SCALE = 256
FAN_IN = 8
BLOCK_ENTRIES = 1 << 19


@dataclass(frozen=True)
class Whitening:
    """Exact size ``n`` and ``sums`` of the fit list; ``directions`` (columns), their variances, and the trace of the covariance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray
    trace: float


def integer_vectors(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and x, the integers of each vector; vectors that are null or hold a null or non-finite entry are left out.

    Vectors shorter than the longest are filled up with zeros.
    """
    bad = F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.filter(F.col(vector_col).isNotNull() & ~bad)
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale))
    rows = rows.select(F.col(id_col).alias("vec_id"), x.alias("x"))
    sizes = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if sizes[0] == sizes[1]:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(sizes[1]) - F.size("x"))))


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    """The column x as integer matrices of bounded size."""
    height = max(dimension, BLOCK_ENTRIES // dimension)
    for batch in batches:
        for at in range(0, batch.num_rows, height):
            yield batch.column("x").slice(at, height).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _factors(n: int, sums: list[int]):
    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, total, block = np.zeros((0, len(sums))), np.array(sums), None
        batches = iter(batches)

        def noted():
            nonlocal block
            for batch in batches:
                if batch.num_rows:
                    block = batch.column("block")[0].as_py()
                    yield batch

        for x in _blocks(noted(), len(sums)):
            r = np.linalg.qr(np.vstack([r, (x * n - total) / n]), mode="r")
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    return reduce_rows


def _stacked(dimension: int):
    def reduce_factors(group: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, dimension))
        for block, own in sorted(zip(group["block"], group["r"])):
            r = np.linalg.qr(np.vstack([r, np.asarray(own).reshape(-1, dimension)]), mode="r")
        return pd.DataFrame({"block": [group["block"].iloc[0] // FAN_IN], "r": [r.ravel()]})

    return reduce_factors


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """Fit to ``vectors`` (x), each once, of one length; None if there is nothing to fit to."""
    per_entry = vectors.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s"), F.count(F.lit(1)).alias("n"))
    entries = sorted(per_entry.collect())  # a row per dimension
    if not entries:
        return None
    n, sums = entries[0]["n"], [e["s"] for e in entries]
    schema = "block int, r array<double>"
    factors = vectors.select("x", F.spark_partition_id().alias("block")).mapInArrow(_factors(n, sums), schema)
    factors = staged(factors, "whitening-factors")
    last = factors.agg(F.max("block")).first()[0]
    while last:
        factors = factors.groupBy(F.floor(F.col("block") / FAN_IN)).applyInPandas(_stacked(len(sums)), schema)
        last //= FAN_IN
    r = np.asarray(factors.first()["r"]).reshape(-1, len(sums))
    square = np.zeros((len(sums), len(sums)))
    square[: len(r)] = r
    squares, directions = principal(square, components)
    return Whitening(n, sums, squares / n, directions, float((square**2).sum() / n))


def _projector(w: Whitening):
    total, scaled = np.array(w.sums), w.directions / np.sqrt(w.variances)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x * w.n - total) / w.n) @ scaled

    return project


def identity_error(vectors: DataFrame, w: Whitening) -> float:
    """Largest entry, in size, of the covariance of the whitened ``vectors`` less the identity."""
    k, dimension = len(w.variances), len(w.sums)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, total = _projector(w), np.zeros(k + k * k)
        for x in _blocks(batches, dimension):
            y = project(x)
            total += np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_pydict({"m": pa.array([total], pa.list_(pa.float64()))})

    parts = vectors.select("x").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("at", "m"))
    rows = sorted(parts.groupBy("at").agg(F.sum("m")).collect())  # k + k * k rows
    m = np.array([r[1] for r in rows]) / w.n
    return float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())


def _whitened(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, dimension = _projector(w), len(w.sums)
        for batch in batches:
            for at in range(0, batch.num_rows, max(dimension, BLOCK_ENTRIES // dimension)):
                part = batch.slice(at, max(dimension, BLOCK_ENTRIES // dimension))
                y = project(next(_blocks([part], dimension)))
                offsets = pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["vec_id", "deviation", "whitened"])

    return run


def deviation(x: Column, n: int, sums: list[int]) -> Column:
    """Sum over the dimensions of (n * x - sum) squared, exact, as decimal(38,0)."""
    zero = F.lit(0).cast("long")
    squares = F.aggregate(x, zero, lambda a, c: a + c * c)
    products = F.aggregate(F.zip_with(x, F.lit(sums), lambda c, s: c * s), zero, lambda a, c: a + c)
    exact = lambda number: F.lit(Decimal(number)).cast("decimal(38,0)")
    wide = squares.cast("decimal(38,0)") * exact(n) * exact(n) - products.cast("decimal(38,0)") * exact(2 * n) + exact(sum(s * s for s in sums))
    return wide.cast("decimal(38,0)")


def whiten(embeddings: DataFrame, *, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Components are numbered from 1 by falling variance; there are fewer if the fit list has a lower rank, and
    with one distinct vector, or an empty table, none and so no rows. Repeated rows and ids get rows each.
    Null ids are kept. Only the named columns are read. Integers must stay below 2**31 in size; sums that no
    long holds raise an error.
    """
    spark = embeddings.sparkSession
    rows = integer_vectors(embeddings, id_col=id_col, vector_col=vector_col, scale=scale)
    fit_list = staged(rows.select("x").distinct(), "whitening-fit")
    w = fit(fit_list, components)
    id_type = dict(rows.dtypes)["vec_id"]
    if w is None or not len(w.variances):
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    error = identity_error(fit_list, w)
    placed = rows.select("vec_id", deviation(F.col("x"), w.n, w.sums).alias("deviation"), "x")
    found = placed.mapInArrow(_whitened(w), f"vec_id {id_type}, deviation decimal(38,0), whitened array<double>")
    explained = F.array(*[F.lit(float(v / w.trace)) for v in w.variances])
    return found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
