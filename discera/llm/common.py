"""Row keys, tables that cut lineage, and connected components; shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_written: list[str] = []


BATCH_BYTES = 4 << 20


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """df.mapInArrow with batches of about BATCH_BYTES. The default of 64 MB takes, with its copies on both sides, a good part of a small executor; the setting of the session is lowered to this, never raised."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(name).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def own(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs with columns named by their places, so that no name of the caller's can meet one of the operators', and what the given columns are called there. `restored` gives the names back."""
    exact = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    loose = {c.lower(): i for i, c in reversed(list(enumerate(docs.columns)))}
    return docs.toDF(*(f"o{i}_" for i in range(len(docs.columns)))), [f"o{exact.get(n, loose.get(n.lower()))}_" for n in names]


def added_names(columns: list[str], names: list[str]) -> list[str]:
    """The names that added columns get: their own, with underscores at the end where the table already has one so called."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def restored(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The caller's columns of a frame that `own` has named, under their names, then the added ones."""
    return df.select(*(F.col(f"o{i}_").alias(c) for i, c in enumerate(columns)), *(F.col(a).alias(n) for a, n in zip(added, added_names(columns, list(added)), strict=True)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset and the master is local (as in tests), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="discera-"))
        folder = _own[0]
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: lost executors cost no more than the running stage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables of the shared folder operators have written that are not forgotten; a mark for `forget`."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes the tables that operators of this session have written to the shared folder (from the mark on, but for the one that keep reads), and returns their number. For when all results that rest on them have been written."""
    context, n = spark.sparkContext, 0
    kept = keep.inputFiles() if keep is not None else []
    left = []
    for place in _written[since:]:
        if any(place.rsplit("/", 1)[1] in f for f in kept):
            left.append(place)
            continue
        path = context._jvm.org.apache.hadoop.fs.Path(place)
        n += bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))
    _written[since:] = left
    return n


def split_join(rows: DataFrame, grouped: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of rows with an aggregate by `on`. One more key column makes Spark shuffle the aggregate once more, so both sides are plain exchanges and adaptive execution can split a key that holds many rows."""
    key = F.hash(*on)
    return rows.withColumn("sj_key", key).join(grouped.withColumn("sj_key", key), [*on, "sj_key"]).drop("sj_key")


def row_key(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, bool]:
    """A key of rows: doc_id where it is a whole number, never null and never repeated, else a hash of id and text (rows alike in both share it, and every result). The second value tells whether doc_id itself is the key."""
    if dict(docs.dtypes)[doc_id] in ("bigint", "int", "smallint", "tinyint"):
        odd = docs.groupBy(F.col(doc_id).alias("d")).count().where("count > 1 or d is null")
        if odd.isEmpty():
            return F.col(doc_id).cast("long"), True
    return F.xxhash64(F.lit("row"), F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null")), F.coalesce(F.col(text), F.lit(""))), False


FILTER_BITS = 1 << 24


def likely_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows whose key may be among keys: a superset of the semi join, before anything is shuffled. What is broadcast is a bit set of 2 MB, whatever the number of keys; with very many keys it lets more rows through. Follow it by a join."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    words = keys.select((at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, int(pmod(xxhash64({key}), 64)))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy()

    def run(batches):
        for b in batches:
            i = np.asarray(b.column(b.num_columns - 1))
            b = b.filter(pa.array((bits[i >> 6] >> (i & 63) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])

    return map_arrow(rows.withColumn("likely_at", at), run, rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long), in any order. Returns node, root: the smallest node reachable, for each node with an edge.

    Alternating large and small stars: each round hangs neighbours on the smallest node
    they know of; minima are combined before the shuffle, and the joins are plain
    equi-joins on the node, which adaptive execution splits where a node has many edges.
    The number of rounds grows with the logarithm of the longest path.
    """
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = split_join(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = saved(small.where("u <> v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
