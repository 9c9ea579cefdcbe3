"""Quality by distribution divergence.

A document's characters fall into eight classes and its words into a list of common words and the rest.
The same histograms, summed over all documents of a language that pass the base rules, are that language's
reference. A document whose histogram lies too far from its reference, by the Jensen-Shannon distance
(base 2, 0 to 1), is not kept. Short documents scatter widely around any reference, so each of the two
comparisons needs a minimum length, and only the base rules judge a document below it.

All of it works inside a row, on arrays, but for the sums per language, which combine before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.words import SPACES, length_of_class, text_or_empty, word_list
from stockloom.session import staged

# Common words of four languages, in alphabetical order.
COMMON_WORDS = (
    "and as auf dans das de del den der des die du ein el en est et for from is ist it la las le les los mit nicht of on para por pour "
    "que se sich the to un und une von was with y zu"
).split()

# Symbols counted as noise, and the character classes of the histogram besides white space and the rest.
SYMBOLS = r"#*$%&|<>"
CLASSES = ("aeiou", "b-df-hj-np-tv-z", "A-Z", "0-9", r"\x{80}-\x{10FFFF}", r".,;:!?'\"()\-")
# The classes do not overlap. Letters go first, as they leave little of the text to later passes.
_LETTERS = "a-z"
_AFTER_LETTERS = (SPACES, *CLASSES[2:])

WINDOW = 8
PROBES = (0, 2, 3, 5, 7)
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CHARS_TO_COMPARE = 200
MIN_WORDS_TO_COMPARE = 60
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.45

_MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _covered(starts: Column) -> Column:
    """Words covered by windows at the sorted positions ``starts``."""
    pairs = F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(pairs, F.lit(WINDOW).cast("long"), lambda total, x: total + x)


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``_words``: words in windows of eight that occur twice or more.

    Equal windows agree in the words at PROBES, so hashes of these show whether a document may have a repeat
    at all. Only such a document compares the windows themselves, by sorting them.
    """
    at = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    none = F.array().cast("array<bigint>")
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.col("_words")[i + k] for k in PROBES]))
    rows = rows.withColumn("_hashes", F.when(F.size("_words") >= WINDOW, hashes).otherwise(none))
    windows = F.transform(at, lambda i: F.struct(F.array_join(F.slice(F.col("_words"), i + 1, F.lit(WINDOW)), " ").alias("w"), i.alias("at")))
    rows = rows.withColumn("_windows", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(windows)))
    last = F.size("_windows") - 1
    w = F.col("_windows")
    twice = F.filter(
        F.sequence(F.lit(0), last),
        lambda k: ((k > 0) & (w[F.greatest(k - 1, F.lit(0))]["w"] == w[k]["w"])) | ((k < last) & (w[F.least(k + 1, last)]["w"] == w[k]["w"])),
    )
    rows = rows.withColumn("_starts", F.when(w.isNotNull(), F.sort_array(F.transform(twice, lambda k: w[k]["at"]))))
    covered = F.when(F.size("_starts") > 0, _covered(F.col("_starts"))).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("n_repeat_words", covered).drop("_hashes", "_windows", "_starts")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base counts and both histograms of every row, from whole texts."""
    text = F.col("_text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("_text"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(f"[^{SPACES}]")))
    rows = rows.withColumn("_words", word_list("_text")).withColumn("_lines", lines)
    chars = F.length(text).cast("long")
    rows = _repeat_words(rows)
    # Only common words get a mark; the others are counted as the difference.
    mark = lambda word: F.substring(F.lit(_MARKS), F.array_position(F.array(*[F.lit(w) for w in COMMON_WORDS]), word).cast("int"), F.lit(1))
    longest = max(map(len, COMMON_WORDS))
    short = F.transform(F.filter("_words", lambda word: F.length(word) <= longest), F.lower)
    common = F.filter(short, lambda word: word.isin(*COMMON_WORDS))
    rows = rows.withColumn("_marks", F.array_join(F.transform(common, mark), ""))
    rows = rows.select(
        "doc_id",
        "lang",
        "_text",
        F.size("_words").cast("long").alias("n_words"),
        chars.alias("_chars"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "_marks",
    )
    without_vowels = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), CLASSES[0], text)
    rows = rows.select("*", F.length(without_vowels).cast("long").alias("_no_vowels"), F.regexp_replace(text, f"[{_LETTERS}]+", "").alias("_rest")).drop("_text")
    # Each pass works on what the one before it has left.
    left = ["_no_letters"]
    rows = rows.withColumn(left[0], F.length("_rest").cast("long"))
    for k, members in enumerate(_AFTER_LETTERS):
        left.append(f"_left{k}")
        rows = rows.withColumn("_rest", F.regexp_replace("_rest", f"[{members}]+", ""))
        rows = rows.withColumn(left[-1], F.length("_rest").cast("long"))
    rows = rows.withColumn("n_symbols", length_of_class(F.col("_rest"), SYMBOLS)).drop("_rest")
    removed = [F.col(a) - F.col(b) for a, b in zip(left, left[1:])]
    white, others = removed[0], removed[1:]
    vowels = F.col("_chars") - F.col("_no_vowels")
    consonants = F.col("_chars") - F.col("_no_letters") - vowels
    of_mark = [(F.length("_marks") - F.length(F.replace(F.col("_marks"), F.lit(m)))).cast("long") for m in _MARKS[: len(COMMON_WORDS)]]
    return rows.select(
        "doc_id",
        "lang",
        "n_words",
        (F.col("_chars") - white).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)).alias("base_failed"),
        F.array(vowels, consonants, *others, white, F.col(left[-1])).alias("char_hist"),
        F.array(F.col("n_words") - F.length("_marks"), *of_mark).alias("word_hist"),
    )


def references(measured: DataFrame) -> DataFrame:
    """Summed histograms of each language over all documents that pass the base rules; no language is one, too."""
    n_chars, n_words = len(CLASSES) + 2, len(COMMON_WORDS) + 1
    sums = [F.sum(F.col("char_hist")[i]).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.col("word_hist")[i]).alias(f"w{i}") for i in range(n_words)]
    by_lang = measured.filter("not base_failed").groupBy("lang").agg(*sums)
    return by_lang.select(
        F.col("lang").alias("ref_lang"),
        F.array(*[F.col(f"c{i}") for i in range(n_chars)]).alias("ref_chars"),
        F.array(*[F.col(f"w{i}") for i in range(n_words)]).alias("ref_words"),
    )


def jensen_shannon(a: Column, b: Column) -> Column:
    """Distance (0 to 1) between two histograms of counts; null if either is empty."""
    total = lambda h: F.aggregate(h, F.lit(0).cast("long"), lambda t, x: t + x)
    shares = lambda h: F.transform(h, lambda x: x / total(h))

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    terms = F.zip_with(shares(a), shares(b), lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    divergence = F.aggregate(terms, F.lit(0.0), lambda t, x: t + x) / 2
    return F.when((total(a) > 0) & (total(b) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judged(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_chars: int = MIN_CHARS_TO_COMPARE,
    min_words: int = MIN_WORDS_TO_COMPARE,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """One row per document: base counts, base_failed, both distances (null: not compared) and kept.

    Null text has no words and fails the base rules. Documents without a language form a language of their
    own; a language none of whose documents passes the base rules has no reference, and then the base rules
    alone decide. Repeated rows are judged each. Only the named columns are read.
    """
    measured = staged(features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "quality")
    refs = staged(references(measured), "quality-references")
    rows = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    rows = rows.withColumn("char_distance", F.when(F.col("word_chars") >= min_chars, jensen_shannon(F.col("char_hist"), F.col("ref_chars"))))
    rows = rows.withColumn("word_distance", F.when(F.col("n_words") >= min_words, jensen_shannon(F.col("word_hist"), F.col("ref_words"))))
    close = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) <= most, F.lit(True)) for c, most in (("char_distance", max_char_distance), ("word_distance", max_word_distance))])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & close).alias("kept"), "char_distance", "word_distance",
    )
