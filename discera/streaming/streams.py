"""Incremental tables as Structured Streaming: deduplicated appends, windows with late data, runs with state, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from discera.operators.state import upsert


def read(spark: SparkSession, folder: str, schema, *, files: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def dedup(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once, remembered for as long as rows may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, at: str, width: str, by: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("desde"), by, "n")


def sliding(stream: DataFrame, at: str, width: str, step: str, by: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width, step), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("desde"), by, "n")


def sessions(stream: DataFrame, at: str, gap: str, by: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "n")


def run_lengths(stream: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The current run of each key: value and length, kept as state over batches."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values(order)
        for v in rows[value]:
            n = n + 1 if v == last else 1
            last = v
        state.update((last, n))
        yield pd.DataFrame({by: [key[0]], "valor": [last], "n": [n]})

    kind = dict(stream.dtypes)[by]
    return stream.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, valor string, n long", "valor string, n long", "update", GroupStateTimeout.NoTimeout)


def write(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is now, into parquet."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def write_upserts(stream: DataFrame, folder: str, checkpoint: str, key: list[str]) -> None:
    """Every batch upserted into a table of versions: folder/v=<batch>; the newest is the table. A batch that runs again writes the same version."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        if number:
            new = upsert(spark.read.parquet(f"{folder}/v={number - 1}"), new, key)
        new.write.mode("overwrite").parquet(f"{folder}/v={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
