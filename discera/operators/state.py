"""Tables that change: upserts, replaced partitions, deduplicated appends. Each returns the new table's rows; writing them is the caller's step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _one(new: DataFrame, key: list[str]) -> DataFrame:
    return new.dropDuplicates(key)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows, and the old ones whose key is not among them."""
    return _one(new, key).unionByName(old.join(new.select(*key), key, "left_anti"), allowMissingColumns=True)


def upsert_coalesce(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """An upsert that never overwrites a value by null."""
    rest = [c for c in old.columns if c not in key]
    n = _one(new, key).select(*key, *(F.col(c).alias(f"__{c}") for c in rest if c in new.columns))
    both = old.join(n, key, "full")
    return both.select(*key, *(F.coalesce(f"__{c}", c).alias(c) if c in new.columns else F.col(c) for c in rest))


def upsert_status(old: DataFrame, new: DataFrame, key: list[str], status: str = "status") -> DataFrame:
    """An upsert in which a link that was proposed may become accepted, and nothing else changes."""
    n = _one(new, key).select(*key, F.col(status).alias("__s"), *(F.col(c).alias(f"__{c}") for c in new.columns if c not in (*key, status)))
    both = old.withColumn("__old", F.lit(True)).join(n, key, "full")
    state = F.when(F.col("__old").isNull(), F.col("__s")).when((F.col(status) == "proposed") & (F.col("__s") == "accepted"), F.lit("accepted")).otherwise(F.col(status))
    rest = [c for c in old.columns if c not in (*key, status)]
    return both.select(*key, state.alias(status), *(F.when(F.col("__old").isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in rest))


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and the new ones whose key is not among them."""
    return old.unionByName(_one(new, key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def replace_partition(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The new rows replace all old ones of the same partition values."""
    return old.join(new.select(*by).distinct(), by, "left_anti").unionByName(new)


def append_dedup(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Appends rows whose key is new, each once: the first in order."""
    first = new.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__r = 1").drop("__r")
    return old.unionByName(first.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def sync(kb: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """What a full sync of accepted rows to a knowledge base does: key and accion (alta, baja, cambio, igual)."""
    rest = [c for c in kb.columns if c != key]
    a = accepted.select(key, F.struct(*rest).alias("__a"), F.lit(True).alias("__in_a"))
    b = kb.select(key, F.struct(*rest).alias("__b"), F.lit(True).alias("__in_b"))
    both = a.join(b, key, "full")
    act = F.when(F.col("__in_b").isNull(), "alta").when(F.col("__in_a").isNull(), "baja").when(F.col("__a").eqNullSafe(F.col("__b")), "igual").otherwise("cambio")
    return both.select(key, act.alias("accion"))


def flatten(df: DataFrame, payload: str, prefix: str, keys: list[str]) -> DataFrame:
    """A JSON payload's keys as columns prefix__key; nested values stay JSON."""
    return df.select(*(c for c in df.columns if c != payload), *(F.get_json_object(payload, f"$.{k}").alias(f"{prefix}__{k}") for k in keys))


MOST_COLUMNS = 2000


def flatten_keys(df: DataFrame, payload: str, prefix: str, levels: int = 1) -> DataFrame:
    """A JSON payload's keys, as they are found in all rows, as columns prefix__key (levels 2: prefix__key__field for objects); deeper values stay JSON.

    A key that is missing gives null, one that is null an empty text; a payload that is no object stands in a column named by
    the prefix. Columns come in the order of their names. More than MOST_COLUMNS different keys are an error: the payload is no record then.
    """
    outer = df.select(F.col(payload).alias("p")).where(F.col("p").isNotNull())
    named = lambda keys: [r[0] for r in keys.limit(MOST_COLUMNS + 1).collect()]
    first = outer.select(F.explode(F.json_object_keys("p")).alias("k")).distinct()
    if levels == 2:
        pairs = outer.select(F.explode(F.from_json("p", "map<string,string>")).alias("k", "v"))
        inner = pairs.select("k", F.explode_outer(F.json_object_keys(F.when(F.ltrim("v").startswith("{"), F.col("v")))).alias("f")).distinct()
        paths = [(r.k, r.f) for r in inner.limit(MOST_COLUMNS + 1).collect()]
    else:
        paths = [(k, None) for k in named(first)]
    if len(paths) > MOST_COLUMNS:
        raise ValueError(f"{payload} has more than {MOST_COLUMNS} different keys")
    objects = {k for k, f in paths if f is not None}
    record = lambda c: F.from_json(c, "map<string,string>")  # noqa: E731  nested values stay JSON
    columns = []
    for k, f in sorted(paths, key=lambda x: (x[0], x[1] or "")):
        top, value = record(F.col(payload)), record(F.col(payload))[k]
        if f is None:
            if k in objects:  # only the values of rows that have no object here
                value = F.when(~F.ltrim(value).startswith("{"), value)
            else:
                value = F.when(F.map_contains_key(top, F.lit(k)), F.coalesce(value, F.lit("")))
            columns.append(value.alias(f"{prefix}__{k}"))
        else:
            held = record(F.when(F.ltrim(value).startswith("{"), value))
            columns.append(F.when(F.map_contains_key(held, F.lit(f)), F.coalesce(held[f], F.lit(""))).alias(f"{prefix}__{k}__{f}"))
    other = F.when(~F.ltrim(payload).startswith("{"), F.col(payload)).alias(prefix)
    rest = [c for c in df.columns if c != payload]
    return df.select(*rest, *([other] if not outer.where(~F.ltrim("p").startswith("{")).isEmpty() else []), *columns)


def metadata_long(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """One row for each declared field that has a value: key, campo, etiqueta, valor."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("campo"), F.lit(label).alias("etiqueta"), F.col(c).cast("string").alias("valor")) for c, label in fields.items()))).alias("x")
    return df.select(key, each).select(key, "x.*").where("trim(coalesce(valor, '')) <> ''")
