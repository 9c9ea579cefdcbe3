"""Corpus pipeline: language, exact copies, near copies, mix, tokens. Counted as part of ``stockloom.llm``.

Each stage works on all that its predecessor kept, and its decisions take effect in what it returns. All
but the last return the columns of ``documents``. ORACLE_SQL is None, as language models, chosen paths and
tokenizing are not SQL; tests/llm compares the stages with brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm import exact_dedup, jaccard_join, language, mixing, pieces
from stockloom.llm.queries import tokenizer_path
from stockloom.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a language is recognised; null texts and texts without letters go."""
    return language.with_language(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate class (five words, similarity 0.8)."""
    return jaccard_join.one_of_each(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return pieces.encoded(docs, pieces.load_vocabulary(tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", with_language),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", to_weights),
    ("sentencepiece", to_pieces),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
