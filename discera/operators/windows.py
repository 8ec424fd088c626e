"""Ordered operators: context of earlier units, runs, first rows, packing, reply trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EMPTY = "(sin contexto)"


def previous(df: DataFrame, doc: str, order: str, value: str, *, last: int | None = None, out: str = "contexto", empty: str = EMPTY) -> DataFrame:
    """The non-empty values of earlier units of the same document, one per line; with last only so many, the nearest. A frame of rows would count empty units too, so nulls are skipped first."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    if last is None:
        df = df.withColumn("__s", F.collect_list(value).over(w))
    else:
        # the number of non-empty units before: a range over it holds the nearest ones only, not a long document
        df = df.withColumn("__n", F.count(value).over(w))
        df = df.withColumn("__s", F.collect_list(value).over(W.partitionBy(doc).orderBy("__n").rangeBetween(-last, -1))).drop("__n")
    return df.withColumn(out, F.when(F.size("__s") == 0, empty).otherwise(F.array_join("__s", "\n"))).drop("__s")


def runs(df: DataFrame, by: list[str], order: str, value: str, joins: Column | None = None) -> DataFrame:
    """Numbers runs of the same value; joins: whether a row continues the row before it (default: equal values)."""
    w = W.partitionBy(*by).orderBy(order)
    follows = (F.lag(value).over(w) == F.col(value)) & (joins if joins is not None else F.lit(True))
    return df.withColumn("__new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("racha", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def run_attributes(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each row's place in its run, the run's length, whether it leads it, and how strong it is."""
    w = W.partitionBy(*by, "racha")
    df = df.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("orden", F.row_number().over(w.orderBy(order)))
    return df.withColumn("primario", F.col("orden") == 1).withColumn("intensidad", F.when(F.col("n") >= 3, "saturado").when(F.col("n") == 2, "intensificado").otherwise("simple"))


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def pack(paragraphs: Column, limit: int) -> Column:
    """Consecutive paragraphs, joined by newlines while they fit the limit."""
    fits = lambda acc, p: (F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(p) <= limit)
    step = lambda acc, p: F.when(fits(acc, p), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws("\n", F.element_at(acc, -1), p)))).otherwise(F.concat(acc, F.array(p)))
    # an accumulator may be empty: element_at would fail there, so it starts with a marker
    marked = F.aggregate(paragraphs, F.array(F.lit("\0" * (limit + 1))), step)
    return F.slice(marked, 2, F.size(marked))


def tree_order(posts: DataFrame, order: str) -> DataFrame:
    """Posts with their depth and their place in a depth-first walk of their conversation, siblings in order; posts on cycles are left out."""
    from discera.operators.graph import resolve_threads

    t = resolve_threads(posts.withColumn("seg", F.lpad(F.col(order).cast("string"), 6, "0")), path="seg").where("profundidad is not null")
    w = W.partitionBy("conversacion").orderBy("path")
    return t.select("post_id", F.col("profundidad").cast("long").alias("nivel"), F.row_number().over(w).cast("long").alias("orden"))
