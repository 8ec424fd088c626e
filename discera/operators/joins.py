"""Joins with the engine's semantics: lookups, group maxima, containment, blocking, nearest neighbours, as-of, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_join(rows: DataFrame, grouped: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows with an aggregate by `on`. One more key column makes Spark shuffle the aggregate once more, so both sides are plain exchanges and adaptive execution can split a key with many rows."""
    key = F.hash(*on)
    return rows.withColumn("__sk", key).join(grouped.withColumn("__sk", key), [*on, "__sk"]).drop("__sk")


def group_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """All rows with the greatest value of their group, ties included; the maxima are combined before the shuffle."""
    top = df.groupBy(*by).agg(F.max(value).alias("__top"))
    return split_join(df, top, by).where(F.col(value) == F.col("__top")).drop("__top")


def containment(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """Pairs with the same keys where one text holds the other."""
    return left.join(right, on).where(F.contains(F.col(a), F.col(b)) | F.contains(F.col(b), F.col(a)))


def block_pairs(df: DataFrame, key: str, block: str, max_block: int | None = None) -> DataFrame:
    """Candidate pairs a < b that share a value of the array column block, each once: at its first common value.

    With max_block, values of more keys are too common to say anything and propose nothing: a rule of blocking, stated
    as a number of keys. Without it, all values propose and the pairs are all that share one.
    """
    rows = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(F.filter(block, lambda v: v.isNotNull()))).alias("ts"))
    met = rows.select("k", F.explode("ts").alias("t"))
    counts = met.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if max_block is not None:
        counts = counts.where(F.col("n") <= max_block)
    fit = split_join(met, counts.select("t"), ["t"])
    sides = fit.groupBy("k").agg(F.array_sort(F.collect_list("t")).alias("ts")).select("k", "ts", F.explode("ts").alias("t"))
    x, y = sides.select("t", F.col("k").alias("a"), F.col("ts").alias("xs")), sides.select("t", F.col("k").alias("b"), F.col("ts").alias("ys"))
    return x.join(y, "t").where((F.col("a") < F.col("b")) & (F.get(F.array_intersect("xs", "ys"), F.lit(0)) == F.col("t"))).select("a", "b")


BLOCK_BYTES, TILE = 8 << 20, 512


def _matrix(batch) -> tuple:
    """Ids, ascending, and unit vectors of a batch; vectors of length 0 stay 0, shorter ones end in zeros."""
    import numpy as np

    size = np.asarray(batch.column(1).value_lengths()).astype(np.int64)
    flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.nan_to_num(flat)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    order = np.argsort(np.asarray(batch.column(0)), kind="stable")
    return np.asarray(batch.column(0))[order], np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)[order]


def nearest(df: DataFrame, key: str, vector: str, k: int, least: float) -> DataFrame:
    """Pairs i < j of the union of all lists of the k most similar vectors (cosine >= least, ties to the smaller key), with the greatest similarity.

    Exact: queries go to the tasks in blocks of BLOCK_BYTES, and every task passes over its vectors in tiles, keeping
    k rows a query. Each block's lists are written before the next one is taken up, so neither the plan nor the driver
    grows with the vectors; the work is by its nature vectors times vectors.
    """
    import numpy as np
    import pyarrow as pa

    from discera.plans.storage import saved

    unit = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    blocks = max(1, -(-(unit.agg(F.sum(F.size("v") + 1)).first()[0] or 0) * 8 // BLOCK_BYTES))
    parts = None
    rank = F.row_number().over(W.partitionBy("i").orderBy(F.desc("s"), "j"))
    for b in range(blocks):
        asked = unit.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).toArrow().combine_chunks().to_batches()
        ids, q = _matrix(asked[0]) if asked else (np.zeros(0, np.int64), np.zeros((0, 0)))

        def search(batches, ids=ids, q=q):
            score, name = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                names, c = _matrix(batch)
                d = min(q.shape[1], c.shape[1])
                for lo in range(0, len(names), TILE):
                    tile = names[lo : lo + TILE]
                    s = q[:, :d] @ c[lo : lo + TILE, :d].T
                    s[(s < least - 1e-12) | (tile[None, :] == ids[:, None])] = -np.inf
                    s = np.concatenate([score, s], 1)
                    n = np.concatenate([name, np.broadcast_to(tile, (len(ids), len(tile)))], 1)
                    best = np.lexsort((n, -s), axis=1)[:, :k]
                    score, name = np.take_along_axis(s, best, 1), np.take_along_axis(n, best, 1)
            real = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], score.shape)[real]), pa.array(name[real]), pa.array(score[real])], ["i", "j", "s"])

        found = unit.mapInArrow(search, "i long, j long, s double").withColumn("r", rank).where((F.col("r") <= k) & (F.col("s") >= least)).drop("r")
        found = saved(found) if blocks > 1 else found
        parts = found if parts is None else parts.union(found)
    return parts.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("s").alias("similarity"))


def as_of(left: DataFrame, right: DataFrame, on: str, at: str, value: str) -> DataFrame:
    """left with the latest right value at or before its time, by key: one shuffle, no pair of rows."""
    both = left.select(*left.columns, F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__side")).unionByName(
        right.select(F.col(on), F.col(at), F.col(value).alias("__v"), F.lit(0).alias("__side")), allowMissingColumns=True
    )
    w = W.partitionBy(on).orderBy(at, "__side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__v", "__side")


def intervals(points: DataFrame, spans: DataFrame, on: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Points inside spans of the same key."""
    return points.join(spans, on).where(F.col(at).between(F.col(begin), F.col(end)))


def reply_target(posts: DataFrame) -> DataFrame:
    """Each post with the handle of the author it answers, @ before it."""
    parent = posts.select(F.col("post_id").alias("en_respuesta_a"), F.concat(F.lit("@"), F.col("autor_handle")).alias("destinatario"))
    return posts.join(parent, "en_respuesta_a", "left")
