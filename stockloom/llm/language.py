"""Language identification in two steps: the family first, then the language within it.

A text is the histogram of its hashed character 1- to 3-grams over the whole text. Linear support vector
machines, one for each pair, vote on the family, and those for each pair of languages of the chosen family
vote on the language. They are fitted on the driver to a bounded sample of labelled rows: the documented
parameter ``per_language`` rows of each label, those with the least digest of their id. Prediction reads
every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from stockloom.llm.words import unused
from stockloom.session import staged

DIMENSIONS = 4096
PER_LANGUAGE = 250
UNKNOWN = "und"

# Families of some languages; any other language is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_LETTER = np.zeros(0x110000, dtype=bool)
_PIECE = 200_000


def _letters() -> np.ndarray:
    if not _LETTER[97]:
        _LETTER[:] = [chr(c).isalpha() for c in range(0x110000)]
    return _LETTER


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of the gram shares, a unit vector; None without a letter. Everything but letters counts as a space."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, 32)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint32)
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, len(codes), _PIECE):
        c = codes[at : at + _PIECE + 2]
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for grams in (one[:_PIECE], two[:_PIECE], three[:_PIECE]):
            counts += np.bincount(grams >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def fit_pair(x: np.ndarray, y: np.ndarray, *, cost: float = 20.0, rounds: int = 30) -> np.ndarray:
    """Weights (last: bias) of a linear SVM with squared hinge loss, by dual coordinate descent; y is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    diagonal = (x * x).sum(axis=1) + 1 / (2 * cost)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            gradient = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * cost)
            new = max(alpha[i] - gradient / diagonal[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Votes:
    """One-versus-one machines over some classes."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @classmethod
    def fitted(cls, x: np.ndarray, labels: np.ndarray, classes: list[str]) -> Votes:
        votes, rows = cls(classes), []
        for a, b in combinations(range(len(classes)), 2):
            of_a, of_b = labels == classes[a], labels == classes[b]
            rows.append(fit_pair(np.vstack([x[of_a], x[of_b]]), np.concatenate([np.ones(of_a.sum()), -np.ones(of_b.sum())])))
            votes.pairs.append((a, b))
        votes.weights = np.array(rows) if rows else None
        return votes

    def best(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most votes (ties: larger margins) and how sure its closest pair is, 0 to 1."""
        if self.weights is None:
            return self.classes[0], 1.0
        margins = self.weights[:, :-1] @ x + self.weights[:, -1]
        won, total, least = np.zeros(len(self.classes)), np.zeros(len(self.classes)), np.full(len(self.classes), np.inf)
        for (a, b), m in zip(self.pairs, margins):
            won[a if m > 0 else b] += 1
            for k, own in ((a, m), (b, -m)):
                total[k] += own
                least[k] = min(least[k], own)
        k = max(range(len(self.classes)), key=lambda c: (won[c], total[c]))
        return self.classes[k], float(1 / (1 + np.exp(-3 * least[k])))


@dataclass
class LanguageModel:
    families: Votes
    languages: dict[str, Votes]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text)
        if x is None or not self.families.classes:
            return UNKNOWN, 0.0
        family, sure = self.families.best(x)
        lang, surer = self.languages[family].best(x)
        return lang, sure * surer


def fit(x: np.ndarray, labels: np.ndarray, families: dict[str, str] | None = None) -> LanguageModel:
    """A model of labelled vectors; ``families`` maps languages to families."""
    families = _FAMILY_OF if families is None else families
    of = np.array([families.get(label, label) for label in labels], dtype=object)
    names = sorted(set(of))
    inner = {f: Votes.fitted(x[of == f], labels[of == f], sorted(set(labels[of == f]))) for f in names}
    return LanguageModel(Votes.fitted(x, of, names) if names else Votes([]), inner)


def held_out(id_col: str) -> Column:
    """True for the documents no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@F.pandas_udf(BinaryType())
def _vectors(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if (x := vector(text)) is None else x.tobytes())


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit to at most ``per_language`` rows of each label among those not held out; the sample does not depend on the layout.

    Only rows whose digest, as a share of its range, lies below about four times the share wanted are ranked.
    """
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).filter(F.col("_lang").isNotNull() & ~held_out("_id"))
    labelled = labelled.distinct().withColumn("_draw", F.md5(F.col("_id").cast("string")))
    counts = labelled.groupBy(F.col("_lang").alias("_label")).agg(F.count(F.lit(1)).alias("_of_label"))
    share = F.conv(F.substring("_draw", 1, 12), 16, 10).cast("long") / float(1 << 48)
    labelled = labelled.join(counts, F.col("_lang") == F.col("_label")).filter(share * F.col("_of_label") < 4 * per_language + 100)
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_id"))
    # Written first: its size is known then, and the texts are filtered where they are read instead of shuffled.
    sample = staged(labelled.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select("_id", "_lang"), "language-sample")
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(lang_col).alias("_doc_lang"), F.col(text_col).alias("_text"))
    chosen = texts.join(sample, (F.col("_doc") == F.col("_id")) & (F.col("_doc_lang") == F.col("_lang")))
    # Rows that repeat an id and label are one of the sample.
    rows = chosen.groupBy("_id", "_lang").agg(F.max("_text").alias("_text")).select("_id", "_lang", _vectors("_text").alias("x")).filter("x is not null").collect()
    rows.sort(key=lambda r: (r["_lang"], str(r["_id"])))
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows]).reshape(len(rows), DIMENSIONS)
    return fit(x, np.array([r["_lang"] for r in rows], dtype=object))


def predictor(model: LanguageModel):
    """A column function: text to struct<lang, score>."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(text) for text in texts], columns=["lang", "score"])

    return predict


def identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if no labelled row is
    left to learn from. With one label only, that label is predicted. Repeated rows are predicted each.
    """
    predict = predictor(learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, per_language=per_language))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def with_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.0) -> DataFrame:
    """The documents with a recognised language, all their columns unchanged: ``und`` and scores below ``min_score`` go."""
    predict = predictor(learn(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    found = unused(docs, "found_language")[0]
    marked = docs.withColumn(found, predict(F.col(text_col)))
    return marked.filter((F.col(found)["lang"] != UNKNOWN) & (F.col(found)["score"] >= min_score)).select(*docs.columns)
