"""Word shingles as sorted 64-bit hashes, their MinHash signatures, and exact Jaccard links inside a block."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_CACHE: dict[str, int] = {}
_CACHE_WORDS = 50_000
COLUMNS = 1024
STRETCH = 150_000


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    cache = _CACHE
    if len(cache) > _CACHE_WORDS:
        cache.clear()
    for word in set(words):
        if word not in cache:
            cache[word] = xxhash.xxh64_intdigest(word)
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def forget_words() -> None:
    """Empty the word cache, so that a worker process does not carry it into other work."""
    _CACHE.clear()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole text if it is shorter; none without words."""
    words = [w for w in SPLIT.split(text or "") if w]
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = _word_hashes(words)
    width = min(width, len(words))
    n = len(h) - width + 1
    total = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        total = mix64((total + h[k : k + n]) * _ODD[k % len(_ODD)])
    return np.unique(total)


def signature(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MinHash of a set under ``seeds`` (odd multipliers), 32 bits each; long sets go in pieces."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        piece = hashes[at : at + 2048, None] * seeds[None, :]
        least = np.minimum(least, (piece ^ (piece >> np.uint64(29))).min(axis=0))
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


def seeds(t: int) -> np.ndarray:
    return mix64(np.arange(1, t + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)


def _columns(common: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``common`` and row of each of the values that are in it."""
    at = np.searchsorted(common, values).astype(np.int32)
    at[at == len(common)] = 0
    found = common[at] == values
    return at[found], rows[found]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets.

    Only elements on both sides count; they become columns of two 0/1 matrices, multiplied in slices.
    """
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = np.repeat(np.arange(len(left), dtype=np.int32), [len(x) for x in left]), np.repeat(np.arange(len(right), dtype=np.int32), [len(x) for x in right])
    common = np.intersect1d(a, b)
    if not len(common):
        return out
    col_a, row_a = _columns(common, a, row_a)
    col_b, row_b = _columns(common, b, row_b)
    for at in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - at)
        sides = []
        for rows, cols, n in ((row_a, col_a, len(left)), (row_b, col_b, len(right))):
            here = (cols >= at) & (cols < at + width)
            m = np.zeros((n, width), dtype=np.float32)
            m[rows[here], cols[here] - at] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _stretches(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Consecutive sets with ``STRETCH`` elements together at most, unless one alone has more."""
    out, begin, held = [], 0, 0
    for k, s in enumerate(sets):
        if k > begin and held + len(s) > STRETCH:
            out.append((begin, k))
            begin, held = k, 0
        held += len(s)
    return [*out, (begin, len(sets))] if sets else out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """True where the Jaccard similarity is at least ``threshold``; both sides go in stretches of bounded size."""
    na, nb = np.array([len(x) for x in left], dtype=np.float64), np.array([len(x) for x in right], dtype=np.float64)
    out = np.zeros((len(left), len(right)), dtype=bool)
    for a, b in _stretches(left):
        for c, d in _stretches(right):
            common = overlaps(left[a:b], right[c:d])
            for k, row in enumerate(common):
                row = row.astype(np.float64)
                # A tiny slack keeps pairs at exactly the threshold, as 4 / 5 is not exact in binary.
                out[a + k, c:d] = (row + 1e-9 >= threshold * (na[a + k] + nb[c:d] - row)) & (row > 0)
    return out


def roots(adjacent: np.ndarray) -> np.ndarray:
    """Least index of each row's component in a symmetric matrix of links."""
    n = len(adjacent)
    root = np.full(n, -1, dtype=np.int64)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first] = first
        edge = [first]
        while edge:
            new = np.flatnonzero(adjacent[edge].any(axis=0) & (root < 0))
            root[new] = first
            edge = new.tolist()
    return root
