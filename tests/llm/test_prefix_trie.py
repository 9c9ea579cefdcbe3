"""The prefix trie against plain nested loops over whole sequences."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from stockloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, conv string, key string, len long"


def brute(rows, group=20):
    talks = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            signed = [int(digest[k : k + 16], 16) for k in (0, 16)]
            signed = [x - (1 << 64) if x >> 63 else x for x in signed]
            talks[conv].append((turn is not None, turn or 0, signed, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in talks.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % group) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(donor, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    own_saved = {n: (len(m) - 1) * words(n[-1][1]) if n else 0 for n, m in members.items()}
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in members:
        if n:
            children[n[:-1]] += 1
    for n in members:
        for d in range(len(n) + 1):
            saved[n[:d]] += own_saved[n]
            leaves[n[:d]] += n not in children
    out = set()
    for n, m in members.items():
        ends = ",".join(str(c) for c in m if len(paths[c]) == len(n))
        out.add((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def talk(rng, convs, longest, texts):
    rows = []
    for c in convs:
        for turn in range(rng.choice([1, 2, 3, 5, longest])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if turn else "user", rng.choice(texts), None, "x", 1))
    return rows


@pytest.mark.parametrize("width, longest, slice_rows", [(8, 7, 1000), (3, 40, 1000), (2, 25, 10)])
def test_trie_equals_loops(spark, width, longest, slice_rows):
    rng = random.Random(width)
    rows = talk(rng, [*range(-45, 60), 1000, 2001], longest, ["a b", "c", "d  e f", ""])
    rng.shuffle(rows)
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), width=width, per_piece=7, slice_rows=slice_rows)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert got.count() == len(brute(rows))


def test_trie_awkward_rows(spark):
    rows = [
        (None, 1, "user", "of nobody", None, None, None),
        (3, None, None, None, None, None, None), (3, None, None, None, None, None, None),  # the same turn twice, before all numbered ones
        (3, 0, "user", "hello there", None, None, None), (3, 0, "user", "hello here", None, None, None),
        (21, 0, None, "", None, None, None),  # its donor is absent: turnless if it lends more turns than it has
        (22, 0, "user", "w " * 20000, None, None, None),
        (40, 0, "user", "w " * 20000, None, None, None), (41, 5, "user", "x", None, None, None), (42, -5, "user", "x", None, None, None),
    ]
    got = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in got.collect()} == brute(rows)
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_repeated(spark):
    rows = [(c, t, "user", f"turn {t}", None, None, None) for c in range(0, 400, 20) for t in range(30)]
    got = {tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA), per_piece=64).collect()}
    assert got == brute(rows)
    assert {r[3] for r in got} == {20}
