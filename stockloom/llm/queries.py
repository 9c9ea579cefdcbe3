"""The operators as registered queries over their whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import chat, exact_dedup, html_extract, jaccard_join, language, mixing, personal_data, pieces, prefix_trie, quality, secrets, sharding, whitening

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Path of the tokenizer's model file; another one can be named in LLM_TOKENIZER_MODEL."""
    return os.environ.get("LLM_TOKENIZER_MODEL", TOKENIZER)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op3_transcript_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse_conversations(_table(spark, sf_dir, "conversations"))


def op4_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).drop("bucket")


def op5_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), shards=16)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"), pieces.load_vocabulary(tokenizer_path()))


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_table(spark, sf_dir, "documents"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    history = secrets.scan_history([docs.filter("lang = 'en'"), docs])  # the English texts were there first
    found = history.filter("version = 1")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[number(k) for k in secrets.BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.personal_spans(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[number(k) for k in personal_data.BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pareto_mix, op2_distribution_divergence, op3_transcript_parsing, op4_extendible_hash_dedup, op5_jump_hash_shards,
        op6_sentencepiece, op7_chosen_path_join, op8_language_id, op9_secret_ledger, op10_wrapper_induction, op11_embedding_whitening, op12_personal_data,
        op13_prefix_trie,
    )
}
