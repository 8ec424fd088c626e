"""Aggregations with the engine's tie rules, and analyses of emotion events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORIAS = ("euforico", "disforico", "aforico", "ambiforico", "indeterminado")


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in a fixed order; unknown values come last."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def dominant(df: DataFrame, by: list[str], value: str, out: str, *tie: Column, count: str | None = None) -> DataFrame:
    """The most frequent value of each group; ties go to the smallest of the tie columns, then to the smallest value. Two combinable aggregations, no window."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"), *(F.min(t).alias(f"__t{i}") for i, t in enumerate(tie)))
    key = F.struct((-F.col("__n")).alias("n"), *(F.col(f"__t{i}") for i in range(len(tie))), F.col(value).alias("v"))
    top = n.groupBy(*by).agg(F.min(key).alias("__m"))
    more = [(-F.col("__m.n")).alias(count)] if count else []
    return top.select(*by, F.col("__m.v").alias(out), *more)


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50 and p99: below 100 values the upper median and the maximum, else interpolated."""
    v = F.col(value).cast("double")
    agg = df.groupBy(*by).agg(F.count(v).alias("n"), F.percentile(v, F.lit(0.5)).alias("__p50"), F.percentile(v, F.lit(0.99)).alias("__p99"), F.max(v).alias("__max"))
    few = df.join(agg.where("n < 100").select(*by), by, "left_semi").where(v.isNotNull())  # groups of at most 99 values
    upper = few.groupBy(*by).agg(F.sort_array(F.collect_list(v)).alias("__s")).select(*by, F.expr("element_at(__s, int(size(__s) div 2 + 1))").alias("__upper"))
    out = agg.join(upper, by, "left")
    return out.select(*by, "n", F.when(F.col("n") < 100, F.col("__upper")).otherwise(F.col("__p50")).alias("p50"), F.when(F.col("n") < 100, F.col("__max")).otherwise(F.col("__p99")).alias("p99"))


def status(df: DataFrame, payload: str, error: str, applies: Column | None = None, in_scope: Column | None = None) -> DataFrame:
    """Counts of a stage's rows by state, in one pass."""
    a = applies if applies is not None else F.lit(True)
    s = in_scope if in_scope is not None else F.lit(True)
    live = a & s
    return df.agg(
        F.count_if(live & F.col(payload).isNull() & F.col(error).isNull()).alias("pending"),
        F.count_if(live & F.col(error).isNotNull()).alias("failed"),
        F.count_if(live & F.col(payload).isNotNull() & F.col(error).isNull()).alias("completed"),
        F.count_if(~a).alias("not_applicable"),
        F.count_if(a & ~s).alias("out_of_scope"),
    )


def cooccurrence(df: DataFrame, group: list[str], label: str) -> DataFrame:
    """Pairs of labels a < b with the groups that hold both, each alone, and the association n_ab / min(n_a, n_b). A group's distinct labels are few; groups are never paired."""
    sets = df.where(F.col(label).isNotNull()).groupBy(*group).agg(F.array_sort(F.collect_set(label)).alias("s"))
    from discera.functions.text import sorted_pairs

    n = sets.select(F.explode("s").alias("l")).groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select(F.explode(sorted_pairs(F.col("s"))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_ab"))
    out = pairs.join(n.select(F.col("l").alias("a"), F.col("n").alias("n_a")), "a").join(n.select(F.col("l").alias("b"), F.col("n").alias("n_b")), "b")
    return out.select("a", "b", "n_ab", "n_a", "n_b", (F.col("n_ab") / F.least("n_a", "n_b")).alias("asociacion"))


def replies(posts: DataFrame) -> DataFrame:
    """Pairs of a captured post and its answer: padre, hijo and their authors."""
    p = posts.select(F.col("post_id").alias("padre"), F.lower("autor_handle").alias("autor_padre"))
    return posts.where("en_respuesta_a is not null").select(F.col("en_respuesta_a").alias("padre"), F.col("post_id").alias("hijo"), F.lower("autor_handle").alias("autor_hijo")).join(p, "padre")


def foria_by_post(events: DataFrame) -> DataFrame:
    """The dominant foria of each post; what is none of the five counts as indeterminado; ties follow their order."""
    f = F.when(F.col("foria").isin(*FORIAS), F.col("foria")).otherwise("indeterminado")
    return dominant(events.withColumn("foria", f), ["post_id"], "foria", "foria", rank_of(F.col("foria"), FORIAS))


def transitions(posts: DataFrame, foria: DataFrame, scope: DataFrame | None = None, *, without: bool = False) -> DataFrame:
    """Counts of (foria of the post, foria of the answer), all pairs of the five present; with scope (autor, comunidad) by intra and inter."""
    pairs = replies(posts)
    f = foria.select("post_id", "foria")
    pairs = pairs.join(f.select(F.col("post_id").alias("padre"), F.col("foria").alias("f_padre")), "padre", "left").join(f.select(F.col("post_id").alias("hijo"), F.col("foria").alias("f_hijo")), "hijo", "left")
    pairs = pairs.fillna("sin_emocion", ["f_padre", "f_hijo"]) if without else pairs.where("f_padre is not null and f_hijo is not null")
    by = []
    if scope is not None:
        pairs = pairs.join(scope.select(F.lower("autor").alias("autor_padre"), F.col("comunidad").alias("c_padre")), "autor_padre").join(scope.select(F.lower("autor").alias("autor_hijo"), F.col("comunidad").alias("c_hijo")), "autor_hijo")
        pairs = pairs.withColumn("alcance", F.when(F.col("c_padre") == F.col("c_hijo"), "intra").otherwise("inter"))
        by = ["alcance"]
    n = pairs.groupBy(*by, "f_padre", "f_hijo").agg(F.count(F.lit(1)).alias("n"))
    labels = [*FORIAS, "sin_emocion"] if without else list(FORIAS)
    each = F.explode(F.array(*map(F.lit, labels)))
    grid = posts.sparkSession.range(1)
    if by:
        grid = grid.select(F.explode(F.array(F.lit("intra"), F.lit("inter"))).alias("alcance"))
    grid = grid.select(*by, each.alias("f_padre")).select(*by, "f_padre", each.alias("f_hijo"))
    return grid.join(n, [*by, "f_padre", "f_hijo"], "left").fillna(0, ["n"])


def lift(pairs: DataFrame, types: DataFrame, support: int = 5) -> DataFrame:
    """How much likelier a type is in an answer if the post has it. pairs: padre, hijo; types: post_id, tipo (distinct)."""
    total = pairs.agg(F.count(F.lit(1)).alias("pares"))
    t = types.distinct()
    child = pairs.join(t.select(F.col("post_id").alias("hijo"), "tipo"), "hijo")
    base = child.groupBy("tipo").agg(F.count(F.lit(1)).alias("base"))
    parent = pairs.join(t.select(F.col("post_id").alias("padre"), "tipo"), "padre")
    given = parent.groupBy("tipo").agg(F.count(F.lit(1)).alias("pares_con_padre")).where(F.col("pares_con_padre") >= support)
    both = parent.join(t.select(F.col("post_id").alias("hijo"), "tipo"), ["hijo", "tipo"]).groupBy("tipo").agg(F.count(F.lit(1)).alias("replicas"))
    df = given.join(both, "tipo", "left").join(base, "tipo", "left").fillna(0, ["replicas", "base"]).crossJoin(F.broadcast(total))  # total is one row
    cond, p = F.col("replicas") / F.col("pares_con_padre"), F.col("base") / F.col("pares")
    return df.select(F.col("tipo").alias("tipo_emocion"), "pares", "pares_con_padre", "replicas", F.round(cond, 4).alias("p_condicional"), F.round(p, 4).alias("p_base"), F.round(F.try_divide(cond, p), 3).alias("lift"))


def flow(posts: DataFrame, foria: DataFrame, communities: DataFrame) -> DataFrame:
    """Answers from community to community, with the forias of the answers."""
    c = communities.select(F.lower("autor").alias("autor"), "comunidad")
    pairs = replies(posts).join(foria.select(F.col("post_id").alias("hijo"), "foria"), "hijo")
    pairs = pairs.join(c.select(F.col("autor").alias("autor_padre"), F.col("comunidad").alias("comunidad_origen")), "autor_padre").join(c.select(F.col("autor").alias("autor_hijo"), F.col("comunidad").alias("comunidad_destino")), "autor_hijo")
    return pairs.groupBy("comunidad_origen", "comunidad_destino").agg(
        F.max(F.when(F.col("comunidad_origen") == F.col("comunidad_destino"), "intra").otherwise("inter")).alias("alcance"),
        F.count(F.lit(1)).alias("respuestas"),
        *(F.count_if(F.col("foria") == f).alias(f) for f in FORIAS),
    )


def community_profile(events: DataFrame, posts: DataFrame, communities: DataFrame) -> DataFrame:
    """Events by community of the author and type, with one column for each foria."""
    a = posts.select("post_id", F.lower("autor_handle").alias("autor")).join(communities.select(F.lower("autor").alias("autor"), "comunidad"), "autor")
    return events.join(a, "post_id").groupBy("comunidad", "tipo").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("foria") == f).alias(f) for f in FORIAS))


def terms(docs: DataFrame, text: str, group: str, *, top: int = 8, least: int = 4) -> DataFrame:
    """Terms that distinguish a group: its document frequency share over the corpus share; at least two documents."""
    word = F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower({text}), '[\\\\p{{L}}\\\\p{{N}}_]+', 0)"))).alias("termino")
    t = docs.select(F.col(group).alias("grupo"), word).where((F.length("termino") >= least) & ~F.col("termino").rlike("^[0-9]+$"))
    c = t.groupBy("grupo", "termino").agg(F.count(F.lit(1)).alias("c"))
    n = c.groupBy("grupo").agg(F.sum("c").alias("n"))
    g = c.groupBy("termino").agg(F.sum("c").alias("g"))
    total = n.agg(F.sum("n").alias("total"))
    df = c.where("c >= 2").join(n, "grupo").join(g, "termino").crossJoin(F.broadcast(total))  # total is one row
    score = (F.col("c") / F.col("n")) / (F.col("g") / F.col("total"))
    rank = F.row_number().over(W.partitionBy("grupo").orderBy(F.desc("score"), F.desc("c"), "termino"))
    return df.withColumn("score", score).withColumn("puesto", rank).where(F.col("puesto") <= top).select("grupo", "termino", "c", "score", "puesto")


def threads(posts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per conversation: posts, greatest depth, sorted authors."""
    return posts.join(resolved, "post_id").groupBy("conversacion").agg(F.count(F.lit(1)).alias("n_posts"), F.max("profundidad").alias("profundidad_max"), F.array_join(F.array_sort(F.collect_set("autor_handle")), ",").alias("participantes"))


def group_top(df: DataFrame, group: str, value: str, top: int = 3) -> DataFrame:
    """The most frequent values of each group as 'value (n), ...'."""
    n = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), value))
    best = n.withColumn("r", rank).where(F.col("r") <= top)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.col(value).cast("string"), F.lit(" ("), F.col("n"), F.lit(")")).alias("t")))), lambda x: x["t"])
    return best.groupBy(group).agg(F.array_join(parts, ", ").alias("perfil"))


def hashtag_rollup(uses: DataFrame) -> DataFrame:
    """Per tag: uses, its dominant function if it has half of the uses or is the only one, else mixto. uses: tag, orden, funcion."""
    total = uses.groupBy("tag").agg(F.count(F.lit(1)).alias("usos"), F.countDistinct("funcion").alias("funciones"))
    top = dominant(uses, ["tag"], "funcion", "f", F.col("orden"), count="n")
    return total.join(top, "tag").select("tag", "usos", F.when((2 * F.col("n") >= F.col("usos")) | (F.col("funciones") == 1), F.col("f")).otherwise("mixto").alias("funcion"))


def bins(df: DataFrame, doc: str, position: str, value: str, n: int, empty: str = "neutro") -> DataFrame:
    """The dominant value in each of n half-open bins of a document's positions; the last position falls in none, and a document with one position is empty throughout."""
    ends = df.groupBy(doc).agg(F.min(position).alias("lo"), F.max(position).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(position) - F.col("lo")) * n / (F.col("hi") - F.col("lo"))))
    rows = df.join(ends, doc).withColumn("bin", at.cast("long")).where(F.col("bin") < n)
    full = dominant(rows, [doc, "bin"], value, "valor")
    grid = ends.select(doc, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bin"))
    return grid.join(full, [doc, "bin"], "left").fillna(empty, ["valor"])
