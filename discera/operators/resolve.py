"""Entity resolution: catalogues, mention bases, coreference, precedence of links, merges, splits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discera.functions.text import STOPWORDS, canonical_slug, fold, invalid_canonical, is_first_person, is_unknown, sanitize_referent, split_coordination
from discera.operators.graph import components

# fixed values: ranks of a link's provenance; a smaller one wins, and rejected links never resolve
INFERRED, DEICTIC, REJECTED = 0, 1, 2
# fixed values: order of links within a group, by status and then by origin
STATUS_ORDER = ("accepted", "proposed")
ORIGIN_ORDER = ("human", "technoparse", "llm", "coref", "auto", "deixis_llm", "deixis")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching characters of two texts, as Python's difflib has it."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def catalog(spark: SparkSession, names: dict[str, list[str]], aliases: dict[str, str] | None = None) -> DataFrame:
    """alias, canonico: each name is its own alias, and wins over aliases of others."""
    found = {n.strip().lower(): n for n in names}
    for name, others in names.items():
        for a in others:
            found.setdefault(a.strip().lower(), name)
    for a, name in (aliases or {}).items():
        if a.strip().lower() not in {n.lower() for n in names}:
            found[a.strip().lower()] = name
    return spark.createDataFrame(sorted(found.items()), "alias string, canonico string")


def mentions(rows: DataFrame) -> DataFrame:
    """The mention base. rows: codigo, unit_idx, orden, marca, funcion, inferencia.

    Mentions of a unit with the same mark, without case, are one: functions are united in order,
    the first written form stays, and the inference is the last that is not blank. A coordinated mark is
    split only if the inference splits into as many parts.
    """
    marks, parts = split_coordination(F.col("marca")), split_coordination(F.col("inferencia"))
    even = (F.size(marks) > 1) & (F.size(marks) == F.size(parts))
    pairs = F.when(even, F.arrays_zip(marks.alias("m"), parts.alias("i"))).otherwise(F.array(F.struct(F.trim("marca").alias("m"), F.trim(F.coalesce("inferencia", F.lit(""))).alias("i"))))
    each = rows.select("codigo", "unit_idx", "orden", "funcion", F.posexplode(pairs).alias("parte", "p")).select("codigo", "unit_idx", "orden", "parte", "funcion", F.col("p.m").alias("marca"), F.col("p.i").alias("inferencia")).where("marca <> ''")
    at = F.struct("orden", "parte")
    known = F.when(~is_unknown(F.col("inferencia")), F.col("inferencia"))
    return each.groupBy("codigo", "unit_idx", F.lower("marca").alias("clave")).agg(
        F.min_by("marca", at).alias("marca"),
        F.max_by(known, F.when(known.isNotNull(), at)).alias("inferencia"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "funcion"))), lambda x: x["funcion"])), ",").alias("funciones"),
    )


def coreference(rows: DataFrame, doc: str, key: str, label: str, subset: int = 2, shared: int = 3) -> DataFrame:
    """Clusters of a document's mentions: equal folded labels, a subset of at least `subset` words, or `shared` words in common. key: long, unique. Returns key and grupo (the smallest key)."""
    words = F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(fold(F.col(label)), r"\s+", " ")), " "), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))
    m = rows.select(F.col(doc).alias("d"), F.col(key).alias("k"), F.trim(fold(F.col(label))).alias("n"), words.alias("w")).where("n <> ''")
    # equal labels need no pairs: each hangs on the first of them; only distinct labels of a document are compared
    first = m.groupBy("d", "n").agg(F.min("k").alias("f"), F.first("w").alias("w"))
    same = m.join(first.select("d", "n", "f"), ["d", "n"]).select(F.col("k").alias("a"), F.col("f").alias("b"))
    token = first.select("d", "f", "w", F.explode("w").alias("t"))
    x, y = token.alias("x"), token.alias("y")
    pairs = x.join(y, (F.col("x.d") == F.col("y.d")) & (F.col("x.t") == F.col("y.t")) & (F.col("x.f") < F.col("y.f"))).select(F.col("x.f").alias("a"), F.col("y.f").alias("b"), F.col("x.w").alias("p"), F.col("y.w").alias("q")).distinct()
    common, least = F.size(F.array_intersect("p", "q")), F.least(F.size("p"), F.size("q"))
    links = pairs.where(((common == least) & (least >= subset)) | (common >= shared)).select("a", "b")
    groups = components(same.union(links))
    return m.select(F.col("k").alias(key)).join(groups, F.col(key) == F.col("nodo"), "left").select(key, F.coalesce("componente", key).alias("grupo"))


def kb_links(mention: DataFrame, kb: DataFrame, accepted: DataFrame) -> DataFrame:
    """Proposed links of mentions whose inference or mark has its slug in the knowledge base, unless one is accepted. mention: id, marca, inferencia; kb: canonical_id; accepted: id."""
    slugs = F.explode(F.array_distinct(F.array(canonical_slug(F.col("inferencia")), canonical_slug(F.col("marca")))))
    return mention.join(accepted, "id", "left_anti").select("id", slugs.alias("canonical_id")).where("canonical_id <> ''").join(kb, "canonical_id", "left_semi").withColumn("status", F.lit("proposed"))


def deixis_links(mention: DataFrame, speakers: DataFrame) -> DataFrame:
    """First person marks point to their document's speaker. mention: codigo, id, marca; speakers: codigo, enunciador."""
    return mention.where(is_first_person(F.col("marca"))).join(speakers.where("trim(coalesce(enunciador, '')) <> ''"), "codigo").select("id", canonical_slug(F.col("enunciador")).alias("canonical_id"), F.lit("proposed").alias("status"), F.lit("deixis").alias("origen"))


def link_rank(links: DataFrame) -> DataFrame:
    """Links (status, origin) with their grupo and orden."""
    at = lambda c, order: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0)) - 1, F.lit(9))
    group = F.when(F.col("status") == "rejected", REJECTED).when(F.col("origin").isin("deixis_llm", "deixis"), DEICTIC).otherwise(INFERRED)
    return links.withColumn("grupo", F.coalesce(group, F.lit(INFERRED))).withColumn("orden", (at("status", STATUS_ORDER) * 10 + at("origin", ORIGIN_ORDER)).cast("int"))


def inference_slugs(c: Column) -> Column:
    """The canonical slugs of an inference, one for each entity it names, without invalid ones."""
    text = sanitize_referent(c)
    slugs = F.array_distinct(F.filter(F.transform(split_coordination(text), canonical_slug), lambda s: (s != "") & ~invalid_canonical(s)))
    return F.when(is_unknown(text), F.array().cast("array<string>")).otherwise(slugs)


def resolve(events: DataFrame, links: DataFrame, *, one: bool = False) -> DataFrame:
    """The canonical entities of each event's mark.

    events: id, codigo, unit_idx, marca, override, inferencia; links: codigo, unit_idx, marca,
    canonical_id, grupo (0 inferred, 1 deictic, 2 rejected), orden (see link_rank). What the event was given
    itself (override, parted by ;) comes first; then the links of its mark, exact or else by containment either
    way, of the best group only; deictic links count only if there is a single one; then the slugs of the
    inference without rejected ones. Within a group: by orden, place in the mark, and the longer mark.
    """
    mark = F.lower(F.trim(F.coalesce("marca", F.lit(""))))
    e = events.withColumn("__m", mark)
    lk = links.select("codigo", "unit_idx", F.lower(F.trim("marca")).alias("__t"), "canonical_id", "grupo", "orden")
    met = e.select("id", "codigo", "unit_idx", "__m").where("__m <> ''").join(lk, ["codigo", "unit_idx"]).where(F.contains("__m", "__t") | F.contains("__t", "__m"))
    met = met.withColumn("__exact", F.col("__m") == F.col("__t"))
    met = met.withColumn("__any", F.max("__exact").over(W.partitionBy("id"))).where(F.col("__exact") | ~F.col("__any"))
    place = F.greatest(F.instr(F.col("__m"), F.col("__t")) - 1, F.lit(0))
    best = met.groupBy("id", "canonical_id").agg(F.min(F.struct("grupo", "orden", place.alias("place"), (-F.length("__t")).alias("len"))).alias("k"))
    per = best.groupBy("id").agg(F.collect_list(F.struct("k", "canonical_id")).alias("c"))
    live = F.array_sort(F.filter("c", lambda x: x["k"]["grupo"] < REJECTED))
    top = F.get(live, F.lit(0))["k"]["grupo"]
    chosen = F.transform(F.filter(live, lambda x: x["k"]["grupo"] == top), lambda x: x["canonical_id"])
    chosen = F.when((top == DEICTIC) & (F.size(chosen) > 1), F.array().cast("array<string>")).otherwise(chosen)
    out_of = F.transform(F.filter("c", lambda x: x["k"]["grupo"] == REJECTED), lambda x: x["canonical_id"])
    per = per.select("id", chosen.alias("__linked"), out_of.alias("__rejected"))
    given = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("override", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != ""))
    none = F.array().cast("array<string>")
    inferred = F.array_except(F.when(F.col("inferencia").isNull(), none).otherwise(inference_slugs(F.col("inferencia"))), F.coalesce("__rejected", none))
    all_ = F.when(F.size(given) > 0, given).when(F.size(F.coalesce("__linked", none)) > 0, F.col("__linked")).otherwise(inferred)
    out = e.join(per, "id", "left").withColumn("canonicos", all_)
    return out.select(*events.columns, F.coalesce(F.get("canonicos", F.lit(0)), F.lit("")).alias("canonico") if one else F.col("canonicos"))


def merge_entities(links: DataFrame, column: str, source, target, key: list[str], order: list[Column]) -> DataFrame:
    """Repoints source to target; where both are linked to the same key, the target's own link stays."""
    own = ~F.col(column).eqNullSafe(F.lit(source))  # links to nothing are their own
    rows = links.withColumn("__own", F.when(own, 0).otherwise(1)).withColumn(column, F.when(own, F.col(column)).otherwise(F.lit(target)))
    w = W.partitionBy(*key, column).orderBy("__own", *order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__own", "__r")


def merge_suggestions(entities: DataFrame, threshold: float = 0.62, max_block: int = 60) -> DataFrame:
    """Groups of entities that may be one. entities: canonical_id, n. Scored pairs share a word; the score is the greatest of the words' Jaccard, 0.9 if one name holds the other, and the ratio of matching characters. Suggested: the most frequent, then the shortest, then the first."""
    from discera.operators.joins import block_pairs

    words = F.filter(F.split("canonical_id", "_"), lambda w: F.length(w) > 2)
    tagged = entities.withColumn("__w", words)
    pairs = block_pairs(tagged, "canonical_id", "__w", max_block)
    side = lambda s: tagged.select(F.col("canonical_id").alias(s), F.col("__w").alias(f"w{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    jac = F.size(F.array_intersect("wa", "wb")) / F.size(F.array_union("wa", "wb"))
    held = F.when(F.contains("a", "b") | F.contains("b", "a"), 0.9).otherwise(0.0)
    scored = both.withColumn("score", F.greatest(jac, held, sequence_ratio("a", "b"))).where(F.col("score") >= threshold)
    numbered = entities.select("canonical_id", F.xxhash64("canonical_id").alias("k"))
    edges = scored.join(numbered.withColumnsRenamed({"canonical_id": "a", "k": "ka"}), "a").join(numbered.withColumnsRenamed({"canonical_id": "b", "k": "kb"}), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    groups = components(edges).join(numbered, F.col("nodo") == F.col("k")).select("canonical_id", "componente").join(entities, "canonical_id")
    best = F.min_by("canonical_id", F.struct((-F.col("n")).alias("n"), F.length("canonical_id").alias("l"), "canonical_id"))
    return groups.groupBy("componente").agg(best.alias("sugerido"), F.array_join(F.array_sort(F.collect_set("canonical_id")), ",").alias("miembros")).drop("componente")


def split_events(events: DataFrame, unit: list[str], idx: str, values: Column, out: str, clear: list[str]) -> DataFrame:
    """One event for each value: the first keeps its index, copies get the next free ones of the unit and lose the payloads to be made anew."""
    rows = events.withColumn("__top", F.max(idx).over(W.partitionBy(*unit))).withColumn("__v", F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast("string"))))
    rows = rows.select("*", F.posexplode("__v").alias("__i", out))
    copy = F.col("__i") > 0
    free = F.col("__top") + F.sum(copy.cast("int")).over(W.partitionBy(*unit).orderBy(idx, "__i").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__new", F.when(copy, free).otherwise(F.col(idx)))
    return rows.withColumns({c: F.when(~copy, F.col(c)) for c in clear}).withColumn(idx, F.col("__new")).drop("__top", "__v", "__i", "__new")


def entity_class(links: DataFrame) -> DataFrame:
    """Accepted entities with their class by their functions, and their longest mark. links: canonical_id, funcion, marca."""
    fs = F.collect_set("funcion")
    kind = F.when(F.arrays_overlap(fs, F.array(F.lit("actor"), F.lit("experienciador"))), "actor").when(fs == F.array(F.lit("fuente")), "circunstante").otherwise("referente")
    return links.groupBy("canonical_id").agg(kind.alias("clase"), F.max_by("marca", F.struct(F.length("marca").alias("l"), "marca")).alias("nombre"))


def propagate_edits(events: DataFrame, edits: DataFrame, key: list[str], column: str, clear: list[str]) -> DataFrame:
    """Applies curated values; where one changes an event, the payloads derived from it are cleared."""
    e = edits.select(*key, F.col(column).alias("__new"))
    rows = events.join(e, key, "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(column))
    return rows.withColumns({c: F.when(~changed, F.col(c)) for c in clear}).withColumn(column, F.coalesce("__new", column)).drop("__new")
