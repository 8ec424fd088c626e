"""Validation rules over events, as predicates and grouped checks. Issues: regla, codigo, frase_idx, emocion_idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ("codigo", "frase_idx", "emocion_idx")


def _low(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def row_rules() -> dict[str, Column]:
    """Rule by rule, whether a row breaks it. Columns: modo_existencia, experienciador, enunciador, fuente_inferencia, intensidad, foria."""
    known = ~_low("enunciador").isin("", "no identificado")
    return {
        "V-01": _low("modo_existencia").isin("virtual", "potencial") & known & (_low("experienciador") != "") & _either(_low("enunciador"), _low("experienciador")),
        "V-02": (_low("fuente_inferencia") == "no identificado") & (_low("intensidad") == "alta"),
        "V-04": (_low("foria") == "aforico") & (_low("intensidad") == "alta"),
        "V-05": (_low("foria") == "ambiforico") & (_low("intensidad") == "baja"),
        "V-06": (_low("modo_existencia") == "virtual") & (_low("foria") == "aforico"),
    }


def check_rows(events: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """Issues of all row rules in one scan."""
    broken = F.filter(F.array(*(F.when(c, name) for name, c in (rules or row_rules()).items())), lambda x: x.isNotNull())
    return events.select(F.explode(broken).alias("regla"), *ISSUE)


def check_groups(events: DataFrame, addressees: DataFrame | None = None) -> DataFrame:
    """V-08: the speaker as experiencer; V-09: the same type and experiencer twice in a unit; V-10: a potential emotion of nobody addressed (addressees: codigo, actor)."""
    known = ~_low("enunciador").isin("", "no identificado")
    v08 = events.where(known & (_low("experienciador") != "") & _either(_low("enunciador"), _low("experienciador"))).select(F.lit("V-08").alias("regla"), *ISSUE)
    twice = events.groupBy("codigo", "frase_idx", _low("tipo_emocion").alias("t"), _low("experienciador").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.min("emocion_idx").alias("emocion_idx")).where("n > 1")
    out = v08.union(twice.select(F.lit("V-09").alias("regla"), *ISSUE))
    if addressees is not None:
        names = addressees.where(F.trim("actor") != "").groupBy("codigo").agg(F.collect_set(F.lower(F.trim("actor"))).alias("__a"))
        rows = events.where((_low("modo_existencia") == "potencial") & (_low("experienciador") != "")).join(names, "codigo")
        v10 = rows.where(~F.exists("__a", lambda a: _either(a, _low("experienciador")))).select(F.lit("V-10").alias("regla"), *ISSUE)
        out = out.union(v10)
    return out


def check_ontology(events: DataFrame, allowed: DataFrame, dims: tuple[str, ...] = ("foria", "intensidad", "dominancia", "modo_existencia")) -> DataFrame:
    """V-11: values that the catalogue neither expects nor tolerates. allowed: tipo, dimension, valor. Types that are not in it raise nothing."""
    long = events.select(*ISSUE, _low("tipo_emocion_canonico").alias("tipo"), F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), _low(d).alias("valor")) for d in dims))).alias("x")).select(*ISSUE, "tipo", "x.dimension", "x.valor").where("valor <> ''")
    listed = allowed.select("tipo", "dimension").distinct()
    return long.join(listed, ["tipo", "dimension"], "left_semi").join(allowed, ["tipo", "dimension", "valor"], "left_anti").select(F.lit("V-11").alias("regla"), *ISSUE, "dimension", "valor")


def contract(name: str) -> dict[str, Column]:
    """The row contract of a stage's input: what must hold where."""
    f = F.col
    text = lambda *cs: {c: f(c).isNotNull() for c in cs}
    known = {
        "documento": text("codigo", "contenido"),
        "post": text("post_id", "plataforma", "autor_handle", "texto") | {"tipo": f("tipo").isin("original", "reply", "quote", "repost"), "es_repost_puro": f("es_repost_puro").isin(0, 1)},
        "hilo": text("conversacion_id", "post_raiz") | {"n_posts": f("n_posts") >= 1, "profundidad_max": f("profundidad_max") >= 0},
        "unidad": text("codigo", "frase") | {"unit_idx": f("unit_idx") >= 0},
        "evento": text("codigo", "experienciador", "tipo_emocion", "fuente_marca", "fuente_inferencia", "modo_existencia") | {"frase_idx": f("frase_idx") >= 0, "emocion_idx": f("emocion_idx") >= 0},
    }
    return known[name]


def violations(df: DataFrame, name: str) -> DataFrame:
    """Broken checks of a contract with the number of rows; a missing column is an error."""
    checks = contract(name)
    if missing := [c for c in checks if c not in df.columns]:
        raise KeyError(f"{name}: no column {', '.join(missing)}")
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(c) for c, ok in checks.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), F.col(c).alias("n")) for c in checks))).alias("x")).select("x.*").where("n > 0")


def validate(df: DataFrame, name: str) -> DataFrame:
    """df, or an error that names the broken checks."""
    if broken := violations(df, name).collect():
        raise ValueError(f"{name}: " + ", ".join(f"{r.columna} ({r.n})" for r in broken))
    return df
