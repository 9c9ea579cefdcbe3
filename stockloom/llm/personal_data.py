"""Personal data by weak supervision: labelers vote on candidate spans, and a classifier is trained on what they agree on.

One pass over each whole text finds candidates: the base kinds by their patterns (failing matches too, as
counter-examples) and further kinds. Every candidate gets the votes of the labelers (pattern, check sum,
gazetteer, context), a 1 for personal data, -1 against, 0 for no opinion. Counts of equal votes over the whole
corpus go to expectation-maximisation, which estimates how often personal data is behind each kind and how
reliable each labeler is. The probabilities it gives are the labels on which a logistic span classifier is
fitted; it sees votes, kind and hashed context words, and decides on all spans but the base ones, which
always stay. What fails its own check sum or range is a counter-example and never becomes a span.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.words import text_or_empty
from stockloom.session import staged

BASE = ("email", "ip", "card", "phone")
ADDED = ("masked_email", "national_phone", "ssn", "iban", "name")
KINDS = BASE + ADDED
PER_KIND = 2000
LEAST = 0.8
BUCKETS = 256

# What the gazetteers hold.
TOP_DOMAINS = frozenset("com org net edu gov info biz io co uk de fr es it nl pl ru br in cn jp au ca us eu ch at be se no dk fi".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 353 358 380 420 852 971 972".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "35", "30", "36", "38", "6011", "65")
IBAN_COUNTRIES = frozenset("AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SK TR".split())
GIVEN_NAMES = tuple(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Lisa Anthony Sandra Paul Anna Peter Maria Hans Ursula Karl Heinrich Jean Pierre Marie Claire Luc Sophie Juan Carmen Luis "
    "Ana Pablo Sofia Carlos Elena Miguel Laura Ahmed Fatima Wei Yuki Priya Raj Olga Ivan".split()
)
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write", "reach", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "login", "client", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "name": ("name", "mr", "mrs", "ms", "dr", "dear", "herr", "frau", "madame", "monsieur", "signed"),
}
CUES |= {"masked_email": CUES["email"], "national_phone": CUES["phone"]}
COUNTER_CUES = frozenset("version release section figure fig page isbn order invoice sku serial build chapter example sample part model item".split())
UNITS = ("%", "px", "kg", "km", "mm", "cm", "ms", "mb", "gb", "usd", "eur")
LABELERS = ("shape", "sum", "gazetteer", "cue", "counter_cue", "edges", "after", "variety")
_SUM = LABELERS.index("sum")

# A pattern that begins with a run of its own characters starts at the run's first one, so no text takes quadratic time.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_MASKED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}+)\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SHORT_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9-])")
_LONG_RUN = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NAME = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(GIVEN_NAMES)})(?:\x20[A-Z]\.)?\x20[A-Z][a-z]{{1,30}}+(?![A-Za-z])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = str.maketrans("", "", "+() .-")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def _luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _in_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """Candidates (kind, start, end, is a base span). Those that are no base span lie where none is, failing matches aside.

    A number that the base pattern of its kind takes together with its neighbour, and so loses, is a candidate by itself.
    """
    out: list[tuple[str, int, int, bool]] = []
    more: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end(), True))
                done = m.end()
    out += [("ip", *m.span(), all(map(_in_byte, m.group().split(".")))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().translate(_DIGITS)
            right = 13 <= len(digits) <= 19 and _luhn(digits)
            if 13 <= len(digits) <= 19:
                out.append(("card", *m.span(), right))
            if not right and len(digits) < m.end() - m.start():
                more += [("card", *own.span(), False) for own in _LONG_RUN.finditer(text, *m.span())]
    if "+" in text:
        for m in _PHONE.finditer(text):
            right = 9 <= len(m.group().translate(_DIGITS)) <= 15
            out.append(("phone", *m.span(), right))
            if not right and (own := _SHORT_PHONE.match(text, m.start())) and own.end() < m.end():
                more.append(("phone", *own.span(), False))
    taken = sorted((a, b) for _, a, b, base in out if base)
    more = _apart(more, taken)
    taken = sorted(taken + [(a, b) for _, a, b, _ in more])
    added = [("masked_email", *m.span(), False) for m in _MASKED.finditer(text)] if any(at in text for at in ("at]", "at)", "AT]", "AT)")) else []
    for kind, pattern in (("national_phone", _NATIONAL), ("ssn", _SSN), ("iban", _IBAN), ("name", _NAME)):
        added += [(kind, *m.span(), False) for m in pattern.finditer(text)]
    return out + more + _apart(added, taken)


def _apart(spans: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """The spans that do not overlap one of ``taken``."""
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else []
    starts = [a for a, _ in taken]
    kept = []
    for s in spans:
        before = int(np.searchsorted(starts, s[2]))  # taken spans that begin before this one ends
        if not before or ends[before - 1] <= s[1]:
            kept.append(s)
    return kept


def _shape(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return 1 if span.rsplit(".", 1)[1].isalpha() and span[0].isalnum() and ".." not in span else -1
    if kind == "ip":
        return 1 if all(p == str(int(p)) for p in span.split(".") if len(p) < 5) and len(span) <= 15 else -1
    if kind == "card":
        return 1 if span == digits or [len(g) for g in re.split("[ -]", span)] in ([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3]) else -1
    if kind == "phone":
        return 1 if 10 <= len(digits) <= 15 and span.count("(") == span.count(")") else -1
    return 0 if kind == "name" else 1


def _sum(kind: str, span: str, digits: str) -> int:
    if kind == "card":
        return 1 if _luhn(digits) else -1
    if kind == "ip":
        return 1 if all(map(_in_byte, span.split("."))) else -1
    if kind == "phone":
        return 1 if 9 <= len(digits) <= 15 else -1
    if kind == "iban":
        plain = span.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "national_phone":
        return 1 if digits[0] not in "01" and digits[3] not in "01" else -1
    return 0


def _gazetteer(kind: str, span: str, digits: str) -> int:
    if kind == "email":
        return 1 if span.rsplit(".", 1)[1].lower() in TOP_DOMAINS else 0
    if kind == "ip":
        first = span.split(".")[0]
        return -1 if first in ("0", "10", "127", "255") or span.startswith("192.168.") else 1
    if kind == "card":
        return 1 if digits.startswith(CARD_PREFIXES) else -1
    if kind == "phone":
        return 1 if digits.startswith(CALLING_CODES) else -1
    if kind == "iban":
        return 1 if span[:2] in IBAN_COUNTRIES else -1
    return 1 if kind == "name" else 0


def labelled(text: str, kind: str, start: int, end: int) -> tuple[str, list[int]]:
    """The votes of all labelers, a character each, and the buckets of the context words."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    left = _WORD.findall(text[max(0, start - 60) : start].lower())[-4:]
    right = _WORD.findall(text[end : end + 30].lower())[:2]
    edge = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    votes = (
        _shape(kind, span, digits),
        _sum(kind, span, digits),
        _gazetteer(kind, span, digits),
        1 if any(w in CUES[kind] for w in left) else 0,
        -1 if any(w in COUNTER_CUES for w in left) else 0,
        -1 if any(c.isalnum() or c in "_/=\\" for c in edge) else 1,
        -1 if text[end : end + 4].lower().strip().startswith(UNITS) else 1 if any(w in CUES[kind] for w in right) else 0,
        -1 if len(digits) >= 9 and len(set(digits)) <= 2 else 0,
    )
    buckets = [zlib.crc32(f"{side}:{w}".encode()) % BUCKETS for side, ws in (("l", left[-2:]), ("r", right[:1])) for w in ws]
    return "".join("-0+"[v + 1] for v in votes), buckets


_FOUND = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,context:array<int>>>"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text in batch["text"]:
            found = []
            for kind, start, end, base in matches(text):
                votes, context = labelled(text, kind, start, end)
                found.append({"kind": kind, "start": start, "end": end, "base": base, "votes": votes, "context": context})
            out.append(found)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "found": out})


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its candidates ``found`` with votes and context."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(_scan, f"doc_id {dict(rows.dtypes)['doc_id']}, found {_FOUND}")


@dataclass
class Reliabilities:
    """``prior``: share of personal data by kind. ``given``: [labeler, truth, vote], how likely a vote is - or + if one is given."""

    prior: dict[str, float]
    given: np.ndarray

    def probability(self, kind: str, votes: str) -> float:
        odds = np.log(self.prior[kind]) - np.log1p(-self.prior[kind])
        for labeler, vote in enumerate(votes):
            if vote != "0":
                odds += np.log(self.given[labeler, 1, int(vote == "+")]) - np.log(self.given[labeler, 0, int(vote == "+")])
        return float(1 / (1 + np.exp(-odds)))


def estimate(counts: list[tuple[str, str, int]], rounds: int = 100) -> Reliabilities:
    """Expectation-maximisation over (kind, votes, number), ended after ``rounds``. No opinion is no evidence.

    Where nearly all candidates show the same votes, the data alone does not tell the classes apart. So
    labelers are taken to be right nine times in ten with the weight of a quarter of all candidates.
    """
    counts = sorted(counts)
    kinds = sorted({k for k, _, _ in counts})
    n = np.array([c for _, _, c in counts], dtype=float)
    of_kind = np.array([[k == kind for kind in kinds] for k, _, _ in counts], dtype=float)
    shown = np.array([[(v == "-", v == "+") for v in votes] for _, votes, _ in counts], dtype=float)  # pattern, labeler, vote
    believed = 1 / (1 + np.exp(-(shown[:, :, 1] - shown[:, :, 0]).sum(axis=1)))
    hold = max(10.0, 0.25 * n.sum()) * np.array([[0.9, 0.1], [0.1, 0.9]])  # truth, vote
    for _ in range(rounds):
        weight = np.stack([n * (1 - believed), n * believed])
        given = np.einsum("tp,plv->ltv", weight, shown) + hold
        given /= given.sum(axis=2, keepdims=True)
        prior = ((n * believed) @ of_kind + 1) / (n @ of_kind + 2)
        odds = np.log(of_kind @ prior) - np.log1p(-(of_kind @ prior))
        odds = odds + np.einsum("plv,lv->p", shown, np.log(given[:, 1]) - np.log(given[:, 0]))
        believed = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    return Reliabilities(dict(zip(kinds, prior.tolist())), given)


_WIDTH = 1 + len(KINDS) + 2 * len(LABELERS) + BUCKETS


def features(kind: str, votes: str, context: list[int]) -> np.ndarray:
    x = np.zeros(_WIDTH)
    x[0] = x[1 + KINDS.index(kind)] = 1
    at = 1 + len(KINDS)
    for k, v in enumerate(votes):
        if v != "0":
            x[at + 2 * k + (v == "+")] = 1
    for b in context:
        x[at + 2 * len(LABELERS) + b] = 0.5
    return x


def fit_classifier(x: np.ndarray, believed: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on probable labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - believed) + ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(found: DataFrame, *, per_kind: int = PER_KIND) -> np.ndarray | None:
    """Weights of the classifier; None without any candidate.

    Reliabilities come from the votes of all candidates. The classifier is fitted to at most ``per_kind`` of
    each kind, those with the least digest of document, kind and place.
    """
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counts = [(r["kind"], r["votes"], r["count"]) for r in each.groupBy("kind", "votes").count().collect()]  # 3 ** labelers a kind at most
    if not counts:
        return None
    reliable = estimate(counts)
    of_kind = {kind: sum(n for k, _, n in counts if k == kind) for kind, _, _ in counts}
    draw = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "kind", F.col("start").cast("string")))
    share = F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long") / float(1 << 48)
    wanted = F.create_map(*[x for k, n in of_kind.items() for x in (F.lit(k), F.lit(min(1.0, (2.0 * per_kind + 100) / n)))])
    drawn = each.withColumn("_draw", draw).filter(share <= wanted[F.col("kind")])
    rank = F.row_number().over(Window.partitionBy("kind").orderBy("_draw", "votes", "context"))
    rows = drawn.withColumn("_rank", rank).filter(F.col("_rank") <= per_kind).select("kind", "votes", "context").collect()
    rows.sort()
    x = np.array([features(r["kind"], r["votes"], r["context"]) for r in rows])
    return fit_classifier(x, np.array([reliable.probability(r["kind"], r["votes"]) for r in rows]))


def _decide(weights: np.ndarray | None, least: float):
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for found in batch["found"]:
                kept = []
                for c in found:
                    if not c["base"]:
                        if c["votes"][_SUM] == "-":
                            continue
                        score = float(features(c["kind"], c["votes"], c["context"]) @ weights)
                        if 1 / (1 + np.exp(-score)) < least:
                            continue
                    kept.append({"kind": c["kind"], "start": c["start"], "end": c["end"], "base": c["base"]})
                kept.sort(key=lambda s: (order[s["kind"]], s["start"]))
                out.append(kept)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": out})

    return run


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, per_kind: int = PER_KIND) -> DataFrame:
    """One row per document: doc_id and spans (kind, start, end, base), by kind and start; code points, end exclusive.

    Base spans are there always, others if the classifier gives them ``least``. Null text is empty and has
    none; repeated rows get a row each and each of their spans counts; a table without candidates has no
    spans. Only the named columns are read.
    """
    found = staged(candidates(docs, id_col=id_col, text_col=text_col), "personal-candidates")
    weights = learn(found, per_kind=per_kind)
    return found.mapInPandas(_decide(weights, least), f"doc_id {dict(found.dtypes)['doc_id']}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def _mask(weights: np.ndarray | None, least: float):
    decide = _decide(weights, least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = next(_scan(iter([batch])))
            out = []
            for text, spans in zip(batch["text"], next(decide(iter([found])))["spans"]):
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = s["end"]
                out.append("".join([*parts, text[at:]]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": out})

    return run


def masked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, per_kind: int = PER_KIND) -> DataFrame:
    """One row per document: doc_id and its text with every span replaced by its kind in brackets; null texts become empty.

    Of overlapping spans the one that begins first is put in place, of those that begin together the longest.
    """
    weights = learn(staged(candidates(docs, id_col=id_col, text_col=text_col), "personal-candidates"), per_kind=per_kind)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(_mask(weights, least), f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
