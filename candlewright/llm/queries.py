"""The queries of this subpackage, each an operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm import centroids, chat, line_dedup, near_dedup, search, substring_dedup
from candlewright.llm.centroids import cluster_vectors
from candlewright.llm.decontamination import decontaminate
from candlewright.llm.mixing import mix_sources
from candlewright.llm.near_dedup import near_duplicates
from candlewright.llm.periodic import collapse_runs, digests
from candlewright.llm.quality import quality
from candlewright.llm.search import top_products
from candlewright.llm.substring_dedup import remove_repeats
from candlewright.llm.token_counts import token_counts
from candlewright.llm.token_ids import read_token_ids, write_token_ids
from candlewright.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents"), gram=2, window=2)
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    return rows.withColumn("text_sha256", F.sha2("text", 256)).drop("text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"), size=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return read_token_ids(*write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end=1))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, scale=1024, seed="3")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(collapse_runs(_table(spark, sf_dir, "documents"), least=12, wrap=True))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_token_ids": op8_token_ids,
    "op9_toxicity": op9_toxicity,
    "op10_mixing": op10_mixing,
    "op11_centroids": op11_centroids,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_top_products": op13_top_products,
}
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_chat_format": chat.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op6_near_dedup": near_dedup.SQL,
    "op11_centroids": centroids.SQL,
    "op13_top_products": search.SQL,
}
