"""Singular values and right singular vectors of a small square matrix by way of a bidiagonal one.

Householder reflections make the matrix bidiagonal. The differential quotient-difference algorithm with
shifts (dqds) finds the squares of its singular values from the smallest up, each shift being Laguerre's
lower bound of what is left, and a twisted factorisation at a found value gives its vector. Vectors of
values close together are made orthogonal to each other, by inverse iteration where they coincide.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps
_NEGLIGIBLE = (10 * EPS) ** 2
_TINY = 1e-290


def bidiagonalised(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor P: m = U B P' with B upper bidiagonal."""
    m = np.array(m, dtype=float)
    n = len(m)
    right = np.eye(n)

    def reflector(x):
        norm = np.linalg.norm(x)
        v = x.copy()
        if norm == 0:
            return v, 0.0
        v[0] += math.copysign(norm, x[0])
        return v, 2.0 / (v @ v)

    for k in range(n):
        v, beta = reflector(m[k:, k])
        m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k < n - 2:
            v, beta = reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= beta * np.outer(m[k:, k + 1 :] @ v, v)
            right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _lower_bound(q: list[float], e: list[float]) -> float:
    """Laguerre's bound of the least eigenvalue of the qd array, from the traces of the inverse and its square."""
    d, d1, d2, s1, s2 = q[0], -1.0, 0.0, 0.0, 0.0
    for i in range(len(e)):
        h = d + e[i]
        if h <= _TINY:
            return 0.0
        s1 -= d1 / h
        s2 += (d1 / h) ** 2 - d2 / h
        step = q[i + 1] / h
        d1, d2 = step * (e[i] / h) * d1 - 1.0, step * (e[i] / h) * (d2 - 2.0 * d1 * d1 / h)
        d *= step
    if d <= _TINY:
        return 0.0
    s1 -= d1 / d
    s2 += (d1 / d) ** 2 - d2 / d
    n = len(q)
    bound = n / (s1 + math.sqrt(max(0.0, (n - 1) * (n * s2 - s1 * s1))))
    return bound * (1.0 - 1e-14 * n) if math.isfinite(bound) else 0.0


def _transformed(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One dqds step; None if the shift was too large."""
    d, new_q, new_e = q[0] - shift, [], []
    for i in range(len(e)):
        h = d + e[i]
        if d < 0 or h <= 0:
            return None
        step = q[i + 1] / h
        new_q.append(h)
        new_e.append(e[i] * step)
        d = d * step - shift
    return None if d < 0 else ([*new_q, d], new_e)


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B in falling order, for q the squared diagonal and e the squared superdiagonal of B."""
    found, todo = [], [(list(q), list(e), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        for _ in range(60 * len(q) + 60):
            if len(q) == 1 or not q:
                break
            small = [i for i in range(len(e)) if e[i] <= _NEGLIGIBLE * (sigma + min(q[i], q[i + 1])) or e[i] <= _TINY]
            if small:
                at = small[-1]
                todo.append((q[at + 1 :], e[at + 1 :], sigma))
                q, e = q[: at + 1], e[:at]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift, after = _lower_bound(q, e), None
            for part in (1.0, 0.9, 0.0):  # rounding can lift the bound over the value
                if after is None:
                    taken, after = part * shift, _transformed(q, e, part * shift)
            if after is None:
                raise ArithmeticError("not a qd array")
            (q, e), sigma = after, sigma + taken
        else:
            raise ArithmeticError("dqds did not converge")
        found += [sigma + x for x in q]
    return sorted(found, reverse=True)


class _Twisted:
    """Stationary and progressive factorisations of L D L' - value, joined where the pivot is least."""

    def __init__(self, d: np.ndarray, l: np.ndarray, value: float):
        n = len(d)
        self.down, self.up = np.zeros(n - 1), np.zeros(n - 1)
        self.pivots_down, self.pivots_up = np.zeros(n), np.zeros(n)
        s, p = np.zeros(n), np.zeros(n)
        s[0], p[-1] = -value, d[-1] - value
        for i in range(n - 1):
            pivot = d[i] + s[i] or EPS * value or _TINY
            self.pivots_down[i], self.down[i] = pivot, d[i] * l[i] / pivot
            s[i + 1] = self.down[i] * l[i] * s[i] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * l[i] ** 2 + p[i + 1] or EPS * value or _TINY
            self.pivots_up[i + 1], self.up[i] = pivot, d[i] * l[i] / pivot
            p[i] = p[i + 1] * (d[i] / pivot) - value
        gamma = s + p + value
        self.twist = int(np.argmin(np.abs(gamma)))
        self.gamma = gamma[self.twist] or EPS * value or _TINY
        self.n = n

    def vector(self) -> np.ndarray:
        z = np.zeros(self.n)
        z[self.twist] = 1.0
        for i in range(self.twist - 1, -1, -1):
            z[i] = -self.down[i] * z[i + 1]
        for i in range(self.twist, self.n - 1):
            z[i + 1] = -self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def solved(self, b: np.ndarray) -> np.ndarray:
        y, r = b.copy(), self.twist
        for i in range(r):
            y[i + 1] -= self.down[i] * y[i]
        for i in range(self.n - 1, r, -1):
            y[i - 1] -= self.up[i - 1] * y[i]
        y[:r] /= self.pivots_down[:r]
        y[r + 1 :] /= self.pivots_up[r + 1 :]
        y[r] /= self.gamma
        for i in range(r - 1, -1, -1):
            y[i] -= self.down[i] * y[i + 1]
        for i in range(r, self.n - 1):
            y[i + 1] -= self.up[i] * y[i]
        return y / np.linalg.norm(y)


def _vectors(a: np.ndarray, b: np.ndarray, values: list[float]) -> np.ndarray:
    """Unit eigenvectors of B'B (columns) for ``values`` in falling order, B having no zero."""
    out: list[np.ndarray] = []
    noise = np.random.default_rng(3)

    def apart(x, near):
        for _ in range(2):
            for v in near:
                x = x - (v @ x) * v
        return x

    for k, value in enumerate(values):
        if len(a) == 1:
            out.append(np.ones(1))
            continue
        near = [out[j] for j in range(k) if values[j] - value <= 1e-3 * values[j]]
        twisted = _Twisted(a * a, b / a[:-1], value)
        z = apart(twisted.vector(), near)
        if np.linalg.norm(z) < 0.9:
            z = apart(noise.standard_normal(len(a)), near)
            for _ in range(4):
                z = apart(twisted.solved(z / np.linalg.norm(z)), near)
                z /= np.linalg.norm(z)
        out.append(z / np.linalg.norm(z))
    return np.array(out).T


def principal(m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of up to ``most`` singular values of a square matrix, falling, and their right vectors (columns).

    Only singular values that stand out from rounding are given. A vector's entry of greatest size is positive.
    """
    n = len(m)
    scale = float(np.abs(m).max()) if n else 0.0
    if scale == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    a, b, right = bidiagonalised(m / scale)
    norm = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < EPS * norm, EPS * norm, a)  # a change below the rounding of the reflections
    cuts = [0, *[i + 1 for i in range(n - 1) if abs(b[i]) <= EPS * norm], n]
    blocks = list(zip(cuts, cuts[1:]))
    ranked = sorted(((value, k) for k, (i, j) in enumerate(blocks) for value in dqds(list(a[i:j] ** 2), list(b[i : j - 1] ** 2))), reverse=True)
    kept = [(v, k) for v, k in ranked[:most] if math.sqrt(v) > 8 * n * EPS * math.sqrt(ranked[0][0])]
    vectors = np.zeros((n, len(kept)))
    for k, (i, j) in enumerate(blocks):
        own = [c for c, (_, of) in enumerate(kept) if of == k]
        if own:
            vectors[i:j, own] = _vectors(a[i:j], b[i : j - 1], [kept[c][0] for c in own])
    vectors = right @ vectors
    vectors /= np.linalg.norm(vectors, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))])
    return np.array([v for v, _ in kept]) * scale**2, vectors * signs
