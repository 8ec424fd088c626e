"""Evaluation: Krippendorff's alpha, greedy alignment with golden events, comparison of runs, samples, snapshots."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from discera.functions.text import STOPWORDS, fold_value

MISSING = ("", "na", "n/a", "nan", "none", "null")


def alpha(rows: DataFrame, metric: str = "nominal") -> DataFrame:
    """Krippendorff's alpha of unit, coder, value (long form) as one row; null without two pairable units or two values. Units are few coders wide: pairs are formed of a unit's value counts, never of its rows."""
    v = F.lower(F.trim(F.col("value").cast("string")))
    kept = rows.where(~F.coalesce(v, F.lit("")).isin(*MISSING))
    kept = kept.select("unit", (v if metric == "nominal" else F.col("value").cast("double")).alias("v"))
    n = kept.groupBy("unit", "v").agg(F.count(F.lit(1)).alias("c"))
    unit = n.groupBy("unit").agg(F.sum("c").alias("m"), F.collect_list(F.struct("v", "c")).alias("s")).where("m >= 2")
    pairs = unit.select("unit", "m", F.explode("s").alias("x"), "s").select("unit", "m", "x", F.explode("s").alias("y"))
    weight = F.when(F.col("x.v") == F.col("y.v"), F.col("x.c") * (F.col("x.c") - 1)).otherwise(F.col("x.c") * F.col("y.c")) / (F.col("m") - 1)
    o = pairs.groupBy(F.col("x.v").alias("c"), F.col("y.v").alias("k")).agg(F.sum(weight).alias("o"))
    marginal = o.groupBy("c").agg(F.sum("o").alias("n"))
    # one row per value of the scale from here on
    totals = marginal.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"), F.array_sort(F.collect_list(F.struct("c", "n"))).alias("scale"))
    units = unit.agg(F.count(F.lit(1)).alias("units"))
    a, b = marginal.select("c", F.col("n").alias("nc")), marginal.select(F.col("c").alias("k"), F.col("n").alias("nk"))
    grid = a.crossJoin(b).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(units)).join(o, ["c", "k"], "left")  # values of the scale only
    if metric == "nominal":
        delta = F.when(F.col("c") == F.col("k"), 0.0).otherwise(1.0)
    elif metric == "interval":
        delta = (F.col("c") - F.col("k")) ** 2
    else:
        between = F.aggregate(F.filter("scale", lambda s: s["c"].between(F.least("c", "k"), F.greatest("c", "k"))), F.lit(0.0), lambda t, s: t + s["n"])
        delta = (between - (F.col("nc") + F.col("nk")) / 2) ** 2
        delta = F.when(F.col("c") == F.col("k"), 0.0).otherwise(delta)
    do = F.sum(F.coalesce("o", F.lit(0.0)) * delta) / F.max("total")
    de = F.sum(F.col("nc") * F.col("nk") * delta) / (F.max("total") * (F.max("total") - 1))
    ok = (F.max("units") >= 2) & (F.max("values") >= 2) & (de > 0)
    return grid.agg(F.when(ok, 1 - do / de).alias("alpha"))


@lru_cache(maxsize=65536)
def _tokens(text: str | None) -> frozenset[str]:
    return frozenset(t for t in re.split(r"[^a-z0-9]+", fold_value(text)) if t and t not in STOPWORDS)


def _overlap(a: str | None, b: str | None) -> bool:
    x, y = _tokens(a), _tokens(b)
    return bool(x and y) and len(x & y) / min(len(x), len(y)) >= 0.5


def _align(golden: list[dict], predicted: list[dict]) -> tuple[int, ...]:
    """tp, fp, fn, tipo_ok, exp_ok, fuente_n, fuente_ok of one unit."""
    same = lambda x, y: bool(x) and str(x).strip().lower() == str(y or "").strip().lower()
    options = []
    for i, x in enumerate(golden):
        for j, y in enumerate(predicted):
            t, e = same(x["tipo"], y["tipo"]), _overlap(x["experienciador"], y["experienciador"])
            if t or e:
                s = _overlap(x["fuente"], y["fuente"])
                options.append((-(2 * t + e + s), i, j, t, e, s))
    left, right, pairs = set(), set(), []
    for o in sorted(options):
        if o[1] not in left and o[2] not in right:
            left.add(o[1])
            right.add(o[2])
            pairs.append(o)
    sourced = [o for o in pairs if str(golden[o[1]]["fuente"] or "").strip()]
    return len(pairs), len(predicted) - len(right), len(golden) - len(left), sum(o[3] for o in pairs), sum(o[4] for o in pairs), len(sourced), sum(o[5] for o in sourced)


def match(golden: DataFrame, predicted: DataFrame) -> DataFrame:
    """Greedy alignment unit by unit: 2 for the type, 1 for the experiencer, 1 for the source; a candidate needs type or experiencer; ties by golden, then predicted order. Columns of both: unidad, idx, tipo, experienciador, fuente. Returns unidad, tp, fp, fn, tipo_ok, exp_ok, fuente_n, fuente_ok for the units of golden. A unit's events are few, so each side is one list a unit, and many units go to Python at once."""
    event = F.struct("idx", "tipo", "experienciador", "fuente")
    listed = lambda df, name: df.groupBy("unidad").agg(F.array_sort(F.collect_list(event)).alias(name))
    both = listed(golden, "g").join(listed(predicted, "p"), "unidad", "left")
    fields = ("tp", "fp", "fn", "tipo_ok", "exp_ok", "fuente_n", "fuente_ok")

    def run(batches):
        for b in batches:
            units, g, p = (b.column(i).to_pylist() for i in range(3))
            rows = [_align(x, y or []) for x, y in zip(g, p, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(fields)))], ["unidad", *fields])

    return both.select("unidad", "g", "p").mapInArrow(run, "unidad string, " + ", ".join(f"{f} long" for f in fields))


def report(matched: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracies of all units."""
    s = matched.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tipo_ok", "exp_ok", "fuente_n", "fuente_ok")))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), F.try_divide("tipo_ok", "tp").alias("acc_tipo"), F.try_divide("exp_ok", "tp").alias("acc_exp"), F.try_divide("fuente_ok", "fuente_n").alias("acc_fuente"))


def compare_runs(a: DataFrame, b: DataFrame, key: list[str], dims: list[str]) -> DataFrame:
    """Agreement of two runs on the presence of a slot and on each dimension of slots present in both."""
    x = a.select(*key, *(F.col(d).alias(f"a_{d}") for d in dims), F.lit(1).alias("in_a"))
    y = b.select(*key, *(F.col(d).alias(f"b_{d}") for d in dims), F.lit(1).alias("in_b"))
    both = x.join(y, key, "full")
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    one = lambda name, n, ok: F.struct(F.lit(name).alias("dimension"), n.alias("n"), ok.alias("acuerdos"))
    parts = [one("presencia", F.count(F.lit(1)), F.count_if(shared))] + [one(d, F.count_if(shared), F.count_if(shared & F.col(f"a_{d}").eqNullSafe(F.col(f"b_{d}")))) for d in dims]
    return both.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def sample(df: DataFrame, key: str, doc: str, positive: Column, n: int, seed: int, per_doc: int) -> DataFrame:
    """n rows, half with and half without an event, round robin over documents (at most per_doc of each), in an order that seed and key fix; a stratum that is short is topped up from the other."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = df.withColumn("__pos", positive).withColumn("__h", h)
    rows = rows.withColumn("__round", F.row_number().over(W.partitionBy(doc, "__pos").orderBy("__h"))).where(F.col("__round") <= per_doc)
    order = ["__round", "__h", key]
    halves = [rows.where("__pos" if p else "not __pos").orderBy(*order).limit(n) for p in (True, False)]
    ranked = None
    for p, part in zip((1, 0), halves, strict=True):
        r = part.withColumn("__rank", F.row_number().over(W.orderBy(*order)))  # n rows at most
        r = r.withColumn("__want", (F.col("__rank") > (n - n // 2 if p else n // 2)).cast("int"))
        ranked = r if ranked is None else ranked.union(r)
    return ranked.orderBy("__want", "__rank", key).limit(n).select(df.columns)


def resample(df: DataFrame, key: str, done: Column, n: int, seed: int) -> DataFrame:
    """A second pass over n finished rows, in hash order."""
    return df.where(done).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def freeze(df: DataFrame, *columns: str) -> DataFrame:
    """Rows as JSON lines."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def context(units: DataFrame, sampled: DataFrame, doc: str, idx: str, text: str, back: int) -> DataFrame:
    """Sampled units with the texts of up to `back` units before them, in order."""
    near = units.select(F.col(doc), F.explode(F.sequence(F.col(idx) + 1, F.col(idx) + back)).alias("__for"), F.struct(F.col(idx).alias("i"), F.col(text).alias("t")).alias("u"))
    s = sampled.select(doc, idx)
    got = s.join(near, (s[doc] == near[doc]) & (s[idx] == near["__for"])).select(s[doc], s[idx], "u").groupBy(doc, idx).agg(F.array_join(F.transform(F.array_sort(F.collect_list("u")), lambda x: x["t"]), "\n").alias("contexto"))
    return s.join(got, [doc, idx], "left")
