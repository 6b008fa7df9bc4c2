"""The registered queries of this subpackage over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm import (best_position, bpe, debruijn, decontaminate, hard_negatives, html_density, language_mixture, licenses,
                          line_dedup, linkgraph, ngram_lm, oracle, quality, simhash)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and adaptive verdict per document."""
    return quality.quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in each document."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of each document."""
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of each page's url."""
    return linkgraph.url_verdicts(_table(spark, sf_dir, "pages"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, unigram base score and trie model score of each document."""
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated passages of lines."""
    return line_dedup.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in each document."""
    return licenses.license_scan(_table(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_density.main_text(_table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of their decoded text."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), vocabulary)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed as repeated spans of earlier documents, and a digest of the kept ones."""
    return substring_digests(debruijn.substring_dedup(_table(spark, sf_dir, "documents")))


def substring_digests(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of highest score for each benchmark item."""
    return best_position.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each anchor and positive of the embeddings."""
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest language of each document and its share of the document."""
    return language_mixture.identify_languages(_table(spark, sf_dir, "documents")).withColumn("mixture", F.to_json("mixture"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality_rules, op2_decontamination, op3_simhash, op4_url_filters, op5_lm_scoring, op6_line_dedup,
        op7_license_scan, op8_html_extraction, op9_bpe, op10_substring_dedup,
        op11_ranked_search, op12_hard_negatives, op13_language_id)}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
