"""Tables in the shared folder that cut the lineage of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A new folder's path under what spark.checkpoint.dir names (a folder of our own where it is unset and the master is local, as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="discera-"))
        folder = _own[0]
    return f"{folder.rstrip('/')}/d-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its lineage is cut, and lost executors cost no more than the running stage."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
