"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.llm import decontaminate, divergence, fertility, html_extract, langid, line_dedup, packing, rendezvous, secret_scan, simhash_trie, substring_dedup, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op10_compression_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(_table(spark, sf_dir, "documents"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).drop("text")


def op9_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_dedup(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan_digest(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extraction(_table(spark, sf_dir, "pages"))


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_chunk_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.rendezvous_sharding(_table(spark, sf_dir, "documents"))


def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.embedding_whitening(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op8_counterfactual_toxicity": op8_counterfactual_toxicity,
        "op5_html_extraction": op5_html_extraction,
        "op7_benchmark_decontamination": op7_benchmark_decontamination,
        "op6_secret_scan": op6_secret_scan,
        "op9_simhash_trie_join": op9_simhash_trie_join,
        "op1_substring_dedup": op1_substring_dedup,
        "op2_tokeniser_fertility": op2_tokeniser_fertility,
        "op10_compression_language_id": op10_compression_language_id,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op3_line_dedup": op3_line_dedup,
        "op11_chunk_divergence": op11_chunk_divergence,
        "op12_rendezvous_sharding": op12_rendezvous_sharding,
        "op13_jacobi_davidson_whitening": op13_jacobi_davidson_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op11_chunk_divergence": divergence.SQL,
        "op12_rendezvous_sharding": rendezvous.SQL,
    }
