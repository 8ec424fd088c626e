"""Queries of the subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, linededup, mixing, ngramjoin, secrets, substrings, topk, toxicity, urlgraph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.digest(_table(spark, sf_dir, "pages"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.digest(_table(spark, sf_dir, "embeddings"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.digest(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(_table(spark, sf_dir, "documents"))


def op10_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_secret_scan, op3_url_filter, op4_exact_topk, op5_benchmark_decontamination, op6_language_id, op7_ngram_jaccard_join, op8_substring_dedup, op9_line_dedup, op10_mixing_sources)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": urlgraph.DIGEST_SQL, "op4_exact_topk": topk.DIGEST_SQL, "op5_benchmark_decontamination": decontam.DIGEST_SQL, "op7_ngram_jaccard_join": ngramjoin.DIGEST_SQL, "op8_substring_dedup": substrings.DIGEST_SQL, "op9_line_dedup": linededup.DIGEST_SQL, "op10_mixing_sources": mixing.DIGEST_SQL}
