"""A corpus pipeline: toxic documents go, repeated lines go, one of each group of near copies stays,
benchmark passages are cut out, and sources are mixed to their target weights.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents, with n_chars following the text. A stage's
rows are written and read again before the next one runs, so a lost executor costs one stage.

Defined cases are those of the operators. A document that line dedup or decontamination
leaves without any text goes; one that came without text stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discera.llm import decontam, linededup, mixing, ngramjoin, toxicity
from discera.llm.common import forget, saved, written


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(linededup.clean(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", cut_benchmark),
    ("mixing_sources", mix_sources),
]

ORACLE_SQL = None
"""SQL cannot express the classifier of the first stage; tests hold the pipeline against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables that stages have written to the shared folder go as soon as the next stage's rows are written; those that the result rests on go when the caller, having written it, calls common.forget(spark)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = written()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
            forget(spark, start, keep=docs)
    return docs
