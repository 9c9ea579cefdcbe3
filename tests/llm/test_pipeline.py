"""The corpus pipeline end to end on small tables: awkward rows, clashing names, an empty table, and every stage against a plain version."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from stockloom.llm import mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ", _sha string, class_id long, copies long, keep_id string, sig string, node long, rows long, language string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def rows():
    rng = random.Random(8)
    stock = {"en": "the and of with that river house green walk under many small stone", "de": "der und die mit nicht ein haus weg klein viele unter stein grün"}
    out, n = [], 0
    for lang, text in stock.items():
        vocabulary = text.split()
        for k in range(60):
            base = [rng.choice(vocabulary) + rng.choice(vocabulary)[:3] for _ in range(80)]
            out.append((n, " ".join(base), lang, f"s{k % 4}" if k % 9 else None))
            n += 1
            if k % 10 == 0:
                out.append((n, "  ".join(base), lang, "s1"))  # equal but for white space
                out.append((n + 1, " ".join([*base[:-1], "changed"]), lang, "s2"))  # nearly equal
                n += 2
    out += [(n, None, "en", "s0"), (n + 1, "", "de", "s0"), (n + 2, "12 34 !", "en", "s1"), (n + 3, "a " * 30_000, None, "s1"), (0, out[0][1], "en", "s0")]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in out]


def run_stages(spark, docs):
    """The documents after each stage but the last, all with the columns they came with, and the rows of the last."""
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == seen[0].columns, name
        seen.append(docs)
    return seen, corpus_pipeline.STAGES[-1][1](spark, docs, "")


def test_stages_equal_plain_versions(spark):
    listed = rows()
    docs = spark.createDataFrame([(*r, "x", 1, 2, "k", "s", 3, 4, "l") for r in listed], COLUMNS + CLASHES)
    tables, encoded = run_stages(spark, docs)
    given, known, once, apart, mixed = [[(r.doc_id, r.text, r.source) for r in t.collect()] for t in tables]
    assert Counter(known) == Counter(r for r in given if re.search(r"[^\W\d_]", r[1] or ""))

    first = {}
    for r in known:
        norm = SPACE.sub(" ", r[1])
        first[norm] = min(first.get(norm, r[0]), r[0])
    assert sorted(r[0] for r in once) == sorted(first.values())

    sets = {r[0]: shingles(r[1]) for r in once}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert sorted(r[0] for r in apart) == sorted({top(i) for i in sets})

    taken = defaultdict(int)
    for r in mixing.mix(tables[3]).collect():
        taken[r.doc_id] += r.copies
    assert Counter(r[0] for r in mixed) == Counter({i: n for i, n in taken.items() if n})
    last = encoded.collect()
    assert Counter(r.doc_id for r in last) == Counter(r[0] for r in mixed) and all(r.round_trip for r in last)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("text", [None, "", "same words in every row of it"])
def test_pipeline_of_one_text(spark, tmp_path, text):
    spark.createDataFrame([(i, text, "en", None, 0) for i in range(5)], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == ({0} if text else set())
