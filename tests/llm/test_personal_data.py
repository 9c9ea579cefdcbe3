"""Personal data: base spans against the plain patterns, votes and reliabilities against known truth, added spans."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from stockloom.llm import personal_data
from stockloom.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, spans string, found int, lang string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            right = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if right:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_equal_plain_patterns(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "@", ".", "x_y%z", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111111111111112", "+1 (202) 555-0100", "+", "-", " ", "  ",
             "9", "12", "é", "\n", "()", "a.b-c@d-e.f.g_h@i.j", "@k.l@m.n", "5500-0000-0000-0004", "+44.20.7946.0958", "q"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        found = [s[:3] for s in personal_data.matches(text) if s[3]]
        assert sorted(found) == sorted(plain(text)), text


def test_long_runs_take_little_time():
    for run in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "+1-" * 100_000, "1 " * 150_000, "@a." * 100_000, "A1 " * 100_000, "[at]" * 80_000):
        began = time.perf_counter()
        personal_data.matches(run)
        assert time.perf_counter() - began < 3, run[:6]


def test_estimate_recovers_reliabilities():
    rng = np.random.default_rng(0)
    right = np.array([0.95, 0.9, 0.8, 0.85, 0.9, 0.9, 0.8, 0.85])
    truth = rng.random(30_000) < 0.4
    votes = np.where(rng.random((len(truth), 8)) < right, truth[:, None], ~truth[:, None])
    counts = {}
    for row in votes:
        key = "".join("+" if v else "-" for v in row)
        counts[key] = counts.get(key, 0) + 1
    got = personal_data.estimate([("email", k, n) for k, n in counts.items()])
    assert np.abs(got.given[:, 1, 1] - right).max() < 0.05 and np.abs(got.given[:, 0, 0] - right).max() < 0.05
    assert abs(got.prior["email"] - 0.4) < 0.03
    decided = np.array([got.probability("email", "".join("+" if v else "-" for v in row)) > 0.5 for row in votes[:2000]])
    assert (decided == truth[:2000]).mean() > 0.98


def test_classifier_follows_probable_labels():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((2000, 1)), rng.standard_normal((2000, 3))])
    p = 1 / (1 + np.exp(-(x @ np.array([-0.5, 2.0, -1.0, 0.0]))))
    assert np.abs(personal_data.fit_classifier(x, p, ridge=1e-6) - [-0.5, 2.0, -1.0, 0.0]).max() < 1e-4


ROWS = [
    *[(i, f"word {i} mail me at user{i}@mail.example.com or call +1 (202) 555-{1000 + i} from 10.20.30.{i % 250}", None, 1, "en") for i in range(200)],
    (300, "tel +1 (314) 555-6532 4663622617512349 end", None, 1, "en"),  # the base patterns take the two numbers together and lose both
    (301, "order 4663622617512348 and version 300.1.2.3", None, 1, "en"),
    (302, "call (212) 555-2368 or write to jane [at] mail [dot] org, IBAN DE89 3704 0044 0532 0130 00, dear Maria Lopez", None, 1, "en"),
    (303, "social security 219-09-9999 yes, part 000-12-3456 no", None, 1, "en"),
    (304, "clean text about nothing at all. And The End.", None, 1, "en"),
    (305, None, None, None, None), (306, "", None, None, None), (None, "a@b.co", None, None, None), (307, "a@b.co", None, None, None), (307, "a@b.co", None, None, None),
    (308, "é" * 50_000 + " z@y.com", None, None, None),
]


def test_spans_of_documents(spark):
    got = personal_data.personal_spans(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert len(got) == len(ROWS)
    text_of = {r[0]: r[1] or "" for r in ROWS}
    added = {r.doc_id: [(s.kind, text_of[r.doc_id][s.start : s.end]) for s in r.spans if not s.base] for r in got}
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.spans if s.base] == plain(text_of[r.doc_id])
    assert added[300] == [("card", "4663622617512349"), ("phone", "+1 (314) 555-6532")]
    assert added[301] == [] and added[304] == [] and added[305] == [] and all(added[i] == [] for i in range(200))
    assert {k for k, _ in added[302]} >= {"national_phone", "masked_email", "iban"}
    assert [t for k, t in added[303] if k == "ssn"] == ["219-09-9999"]
    again = personal_data.personal_spans(spark.createDataFrame(ROWS[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert personal_data.personal_spans(spark.createDataFrame([], SCHEMA)).collect() == []
    assert personal_data.personal_spans(spark.createDataFrame(ROWS[204:205], SCHEMA)).collect()[0].spans == []


def test_masked_texts(spark):
    got = {r.doc_id: r.text for r in personal_data.masked(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[7] == "word 7 mail me at [EMAIL] or call [PHONE] from [IP]"
    assert got[300] == "tel [PHONE] [CARD] end" and got[304] == ROWS[204][1] and got[305] == ""


def test_query_digests(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op12_personal_data"](spark, str(tmp_path)).collect():
        base = plain({x[0]: x[1] for x in ROWS}[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PLAIN]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
