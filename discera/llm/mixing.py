"""Mixing sources to target weights: repetition rates per source, whole copies and one hash-seeded Bernoulli copy.

A document's size is its number of words (runs of anything but white space). Sources, in
code point order with null last, weigh `weights` in turn and share `share` times all sizes;
a target stops at `most` times its source's size and what is over goes to the others by
weight, until none is above. With rate = target / size of the source, each document is
taken floor(rate) times, and once more where a hash of its id, its text and the seed falls below
the fraction; so reruns agree and no document is taken more than `most` times.

Sizes are summed per source before the shuffle; what is joined back has one row for each
source. The targets come from one pass over the sources ordered by limit / weight: the
first ones reach their limits, and the rest share what remains by weight.

Defined cases: a null text has size 0 and is taken 0 words; a null source is a source of
its own; a null doc_id is hashed as an empty id, a null text as an empty hash, so rows without
an id draw by their texts; rows that repeat id and text are documents of their own with the same
draw; a table without words has targets 0 and takes nothing; further columns
are carried along unchanged, and added columns whose names the table has already get underscores
at the end. The targets of all sources (one short row each) are computed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import own, restored, saved

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix-1"
MAX_BROADCAST = 100_000
"""Up to so many sources (one short row each) their targets are broadcast and documents stay where they are; beyond, both sides are shuffled by source, and adaptive execution splits a large one."""


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size. Returns them with target."""
    by = W.orderBy(F.col("source").asc_nulls_last())  # one row per source
    df = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by) - 1) % len(weights)) + 1).cast("double"))
    df = df.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("at", F.col("cap") / F.col("w"))
    order = W.orderBy("at", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    df = df.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    # what a unit of weight gets if all before are at their limits and none from here on
    df = df.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    level = F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(everything)
    df = df.withColumn("level", level)
    return df.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("at") <= F.col("level")), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))


def copies_of(rate: Column, doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """How often a document is taken at a rate."""
    mark = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit("")))
    draw = F.conv(F.substring(F.md5(mark), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return F.floor(rate).cast("long") + F.when(draw < rate - F.floor(rate), 1).otherwise(0).cast("long")


def _annotated(docs: DataFrame, text: str, source: str, doc_id: str, seed: str, options: dict) -> DataFrame:
    """docs, named by `own`, with mx_size, mx_source_size, mx_target and mx_copies."""
    sized = docs.withColumn("mx_size", size_of(F.col(text)))
    per = targets(sized.groupBy(F.col(source).alias("source")).agg(F.sum("mx_size").alias("source_size")), **options)
    per = per.select(F.col("source").alias("mx_source"), F.col("source_size").alias("mx_source_size"), F.col("target").alias("mx_target"))
    per = saved(per)
    few = per.count() <= MAX_BROADCAST
    joined = sized.join(F.broadcast(per) if few else per, F.col(source).eqNullSafe(F.col("mx_source"))).drop("mx_source")
    rate = F.coalesce(F.try_divide(F.col("mx_target"), F.col("mx_source_size").cast("double")), F.lit(0.0))
    return joined.withColumn("mx_copies", copies_of(rate, F.col(doc_id), F.col(text), seed))


def annotate(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, seed: str = SEED, **options) -> DataFrame:
    """docs with mx_size, mx_source_size, mx_target and mx_copies."""
    df, names = own(docs, text, source, doc_id)
    return restored(_annotated(df, *names, seed, options), docs.columns, "mx_size", "mx_source_size", "mx_target", "mx_copies")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", *, seed: str = SEED, **options) -> DataFrame:
    """Each document as often as the mix takes it, with mix_copy counting its copies from 0."""
    df, names = own(docs, text, source, doc_id)
    taken = _annotated(df, *names, seed, options).where("mx_copies > 0")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("mx_copies") - 1)).alias("mix_copy")
    return restored(taken.select(*df.columns, copy), docs.columns, "mix_copy")


def digest(docs: DataFrame) -> DataFrame:
    df = annotate(docs.select("doc_id", "text", "source"))
    return df.select("doc_id", F.col("mx_size").alias("size"), F.col("mx_source_size").alias("source_size"), F.col("mx_target").alias("target"), (F.col("mx_size") * F.col("mx_copies")).alias("taken"))


DIGEST_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sizes),
level AS (
  SELECT *, cap / w AS lim, 1.5::DOUBLE * sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
target AS (
  SELECT source, source_size, CASE WHEN m.l IS NULL OR lim <= m.l THEN cap ELSE w * m.l END AS target
  FROM level, (SELECT max((total - full_before) / rest) FILTER ((total - full_before) / rest <= lim) AS l FROM level) m),
rated AS (
  SELECT sized.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size::DOUBLE END AS rate,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(h, '')), 1, 13))::BIGINT::DOUBLE / (1::BIGINT << 52) AS draw
  FROM sized JOIN target ON sized.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
