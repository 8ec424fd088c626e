"""The catalogue: named queries over the driver's tables, and DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers fn(t) as a query, where t.name is a table of the driver and t.view(...) one of the views; sql: its oracle."""

    def add(fn):
        from discera.plans.views import Tables

        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[key] = sql
        return fn

    return add
