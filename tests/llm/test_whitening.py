"""Whitening against a plain eigendecomposition, and its solver against a library's singular values."""

import math

import numpy as np
import pytest

from stockloom.llm import whitening
from stockloom.llm.bidiagonal import dqds, principal

SCHEMA = "vec_id long, embedding array<float>, x string, at int, n string"


def brute(rows, components=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max(len(x) for _, x in kept)
    kept = [(i, tuple(x + [0] * (longest - len(x)))) for i, x in kept]
    fit = np.array(sorted({x for _, x in kept}))
    n, sums = len(fit), fit.sum(axis=0)
    centred = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    order = [k for k in order if values[k] > 1e-9 * values.max()]
    out = {}
    for i, x in kept:
        dev = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        for c, k in enumerate(order, 1):
            out.setdefault((i, c), []).append((dev, ((np.array(x) * n - sums) / n) @ vectors[:, k] / math.sqrt(values[k]), values[k] / values.sum(), n))
    return out


def check(df, rows, components=4):
    want, got = brute(rows, components), {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.component), []).append((int(r.deviation), r.whitened, r.explained, r.n))
        assert abs(r.identity_error) < 1e-9
    assert got.keys() == want.keys()
    for c in range(1, components + 1):
        keys = [k for k in want if k[1] == c]
        if not keys:
            continue
        lead = max(keys, key=lambda k: abs(want[k][0][1]))
        sign = 1 if got[lead][0][1] * want[lead][0][1] > 0 else -1
        for k in keys:
            for a, b in zip(sorted(got[k]), sorted(want[k])):
                assert a[0] == b[0] and a[3] == b[3]
                assert sign * a[1] == pytest.approx(b[1], abs=1e-7) and a[2] == pytest.approx(b[2], rel=1e-9)


def test_whitening_equals_eigendecomposition(spark):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((12, 12))
    rows = [(i, [float(c) for c in rng.standard_normal(12) @ mix + 3]) for i in range(700)]
    rows += [(9000 + i, rows[0][1]) for i in range(300)]  # a vector that a third of the rows share
    df = spark.createDataFrame([(*r, None, 1, "n") for r in rows], SCHEMA).repartition(20)
    check(whitening.whiten(df), rows)
    check(whitening.whiten(df, components=12), rows, components=12)


def test_whitening_awkward_rows(spark):
    rows = [
        (1, None), (2, [1.0, None, 2.0]), (3, [1.0, float("nan"), 2.0]), (4, [float("inf"), 1.0, 2.0]), (5, [0.5, -0.25, 3.0]), (5, [0.5, -0.25, 3.0]),
        (6, [0.1, 0.2]), (7, []), (None, [4.0, 4.0, 4.0]), (8, [-0.0, 0.0, -1e-9]),
    ]
    check(whitening.whiten(spark.createDataFrame([(*r, None, 1, "n") for r in rows], SCHEMA)), rows)
    flat = [(i, [2.0, float(i % 5), float(i % 5)]) for i in range(40)]  # rank one
    got = whitening.whiten(spark.createDataFrame([(*r, None, 1, "n") for r in flat], SCHEMA))
    assert {r.component for r in got.collect()} == {1}
    same = spark.createDataFrame([(i, [1.0, 2.0], None, 1, "n") for i in range(5)], SCHEMA)
    assert whitening.whiten(same).collect() == []
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("kind", ["random", "equal", "near", "graded", "rank", "diagonal", "one", "paired"])
def test_principal_values_and_vectors(kind):
    rng = np.random.default_rng(1)
    q, p = (np.linalg.qr(rng.standard_normal((30, 30)))[0] for _ in range(2))
    tail = np.linspace(1, 0.1, 20)
    m = {
        "random": rng.standard_normal((70, 70)), "equal": q * np.r_[np.full(10, 5.0), tail] @ p, "near": q * np.r_[5 + 1e-9 * np.arange(10), tail] @ p,
        "graded": q * np.logspace(0, -14, 30) @ p, "rank": q * np.r_[np.ones(3), np.zeros(27)] @ p, "diagonal": np.diag([3.0, 3, 2, 2, 0]), "one": np.array([[-4.0]]),
        "paired": np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),
    }[kind]
    values, vectors = principal(m, len(m))
    known = np.linalg.svd(m, compute_uv=False) ** 2
    assert np.abs(values - known[: len(values)]).max() < 1e-13 * known[0]
    assert known[len(values) :].sum() < 1e-20 * known[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(m.T @ (m @ vectors) - vectors * values).max() < 1e-13 * known[0]


def test_dqds_keeps_small_values_accurate():
    a, b = np.logspace(0, -12, 25), np.logspace(-1, -13, 24)
    found = dqds(list(a**2), list(b**2))
    inverse = np.linalg.svd(np.linalg.inv(np.diag(a) + np.diag(b, 1)), compute_uv=False)
    assert found[-1] == pytest.approx(inverse[0] ** -2, rel=1e-12)
