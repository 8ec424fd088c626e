"""Stages around a model: agents as declared prompts and fields, a second pass with context, context blocks, answers matched to spans, closed vocabularies, genres."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from discera.functions.text import fold, truncate_tail, truncate_to_budget
from discera.operators.infer import Backend, Policy, infer
from discera.operators.windows import previous

LEVELS = ("documento", "unidad", "evento", "entidad")


@dataclass(frozen=True)
class Agent:
    """What a model is asked for: a level of rows, the columns that its prompt shows, and the fields of its answer."""

    name: str
    level: str
    shows: tuple[str, ...]
    fields: tuple[str, ...]

    def __post_init__(self) -> None:
        if self.level not in LEVELS or not self.shows or not self.fields:
            raise ValueError(f"agent {self.name}: a level of {', '.join(LEVELS)}, columns and fields are needed")

    def prompt(self) -> Column:
        """The prompt: the agent's name and each column shown that is not null, one per line."""
        return F.concat_ws("\n", F.lit(self.name), *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in self.shows))


# fixed values: the agents' names, levels and fields
AGENTS = {
    a.name: a
    for a in (
        Agent("summarizer", "documento", ("texto",), ("resumen",)),
        Agent("metadata", "documento", ("texto",), ("tipo_discurso", "lugar")),
        Agent("enunciation", "documento", ("texto", "resumen"), ("enunciador", "enunciatarios", "auditorio")),
        Agent("actors", "unidad", ("frase", "resumen"), ("actores",)),
        Agent("emotions", "unidad", ("frase", "actores"), ("emociones",)),
        Agent("emotions_pass2", "unidad", ("frase", "actores", "contexto"), ("emociones",)),
        Agent("characterizer", "evento", ("frase", "tipo_emocion"), ("foria", "intensidad", "dominancia")),
        Agent("actants", "evento", ("frase", "tipo_emocion"), ("configuracion",)),
        Agent("judge", "evento", ("frase", "tipo_emocion", "foria"), ("veredicto", "motivo")),
        Agent("semas", "entidad", ("canonical_id", "marcas"), ("semas",)),
        Agent("deixis", "unidad", ("frase", "marca"), ("referente",)),
        Agent("modalidad", "unidad", ("frase", "marca"), ("modalidad", "naturaleza")),
        Agent("emoji_affect", "unidad", ("frase", "emoji"), ("afecto",)),
        Agent("hashtag_semiotics", "unidad", ("frase", "hashtag"), ("funcion",)),
        Agent("tecno_usage", "unidad", ("frase", "entidades"), ("usos",)),
        Agent("reframing", "documento", ("texto", "citado"), ("clase",)),
    )
}


def run_agent(df: DataFrame, agent: Agent, make: Callable[[], Backend], policy: Policy | None = None) -> DataFrame:
    """df with one column for each field of the agent's answer (null where it is missing), and error."""
    got = infer(df, agent.prompt(), make, out="__payload", policy=policy)
    return got.select(*df.columns, *(F.get_json_object("__payload", f"$.{f}").alias(f) for f in agent.fields), "error")


def second_pass(df: DataFrame, doc: str, order: str, text: str, first: str, make: Callable[[], Backend], *, last: int | None = 3, out: str = "payload", policy: Policy | None = None) -> DataFrame:
    """A second answer for each unit, with what the first pass said of the units before it: contexto, payload and error. last: how many (None: all)."""
    rows = previous(df, doc, order, first, last=last)
    return infer(rows, F.concat_ws("\n", "contexto", text), make, out=out, policy=policy)


@dataclass(frozen=True)
class Block:
    """A named block of context for some stages: its text by document or by unit, cut to a budget of tokens from its end or, with keep_tail, from its beginning."""

    name: str
    stages: tuple[str, ...]
    budget: int
    scope: str = "documento"
    keep_tail: bool = False

    def __post_init__(self) -> None:
        if not self.name.replace("_", "").isalnum() or not self.stages or self.budget < 1 or self.scope not in ("documento", "unidad"):
            raise ValueError(f"block {self.name!r}: a plain name, stages, a budget and a scope are needed")


def with_blocks(df: DataFrame, stage: str, blocks: list[tuple[Block, DataFrame]], doc: str = "codigo", unit: str = "unit_idx") -> DataFrame:
    """df with a column for each block of the stage: its trimmed text within the budget, null where there is none. A block's frame has the keys of its scope and texto, one row each."""
    for block, texts in blocks:
        if stage not in block.stages:
            continue
        keys = [doc] if block.scope == "documento" else [doc, unit]
        t = F.regexp_replace("texto", r"^\s+|\s+$", "")
        cut = (truncate_tail if block.keep_tail else truncate_to_budget)(t, block.budget)
        df = df.join(texts.select(*keys, F.when(t != "", cut).alias(block.name)), keys, "left")
    return df


def match_spans(answers: DataFrame, spans: DataFrame, by: list[str], order: str = "orden", value: str = "valor") -> DataFrame:
    """The span that each answer names: by, orden, id. answers: by, orden, valor; spans: by, id, inicio, valor.

    In their order, answers take the first span of their unit that says the same, letter for letter or else but
    for case; no span is taken twice, and an answer that finds none is left out. Answers and spans that differ
    by more than case never meet, so a unit falls into small groups by its lowered values.
    """
    low = lambda c: F.lower(F.replace(c, F.lit("ß"), F.lit("ss")))
    said = F.trim(F.col(value))
    a = answers.where(said != "").groupBy(*by, low(said).alias("__v")).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("v")))).alias("__a"))
    s = spans.groupBy(*by, low(F.col(value)).alias("__v")).agg(F.sort_array(F.collect_list(F.struct(F.col("inicio").alias("i"), F.col("id").alias("id"), F.col(value).alias("v")))).alias("__s"))
    kind = dict(spans.dtypes)["id"]
    nothing = F.array().cast(f"array<struct<o:{dict(answers.dtypes)[order]},id:{kind}>>")

    def take(state, x):
        same = F.get(F.filter(state["free"], lambda f: f["v"] == x["v"]), F.lit(0))
        pick = F.coalesce(same["id"], F.get(state["free"], F.lit(0))["id"])
        found = F.when(pick.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(x["o"].alias("o"), pick.alias("id")))))
        return F.struct(F.filter(state["free"], lambda f: ~f["id"].eqNullSafe(pick)).alias("free"), found.alias("out"))

    met = a.join(s, [*by, "__v"]).select(*by, F.explode(F.aggregate("__a", F.struct(F.col("__s").alias("free"), nothing.alias("out")), take, lambda x: x["out"])).alias("x"))
    return met.select(*by, F.col("x.o").alias(order), F.col("x.id").alias("id"))


def closed_vocabulary(df: DataFrame, values: str, allowed: list[str], out: str) -> DataFrame:
    """The entries of an array column that the vocabulary has, compared without case and accents, as the vocabulary writes them, each once and in the order of the answer."""
    key = lambda c: F.trim(fold(c))
    words = F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")
    match = lambda v: F.get(F.filter(words, lambda w: key(w) == key(v)), F.lit(0))
    return df.withColumn(out, F.array_distinct(F.filter(F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), match), lambda x: x.isNotNull())))


@dataclass
class Genre:
    """A genre of texts: its unit (frase, parrafo, documento), its context (documento or hilo), and the metadata it shows."""

    id: str
    unit: str = "frase"
    context: str = "documento"
    metadata: dict[str, str] = field(default_factory=dict)


class Genres:
    """Genres by id, as plug-ins register them."""

    def __init__(self) -> None:
        self._known: dict[str, Genre] = {}

    def register(self, genre: Genre) -> Genre:
        if genre.id in self._known:
            raise ValueError(f"genre {genre.id} is registered already")
        if genre.unit not in ("frase", "parrafo", "documento") or genre.context not in ("documento", "hilo"):
            raise ValueError(f"genre {genre.id}: unknown unit or context")
        self._known[genre.id] = genre
        return genre

    def get(self, id: str) -> Genre:
        if id not in self._known:
            raise KeyError(f"unknown genre {id}; known: {', '.join(sorted(self._known)) or 'none'}")
        return self._known[id]

    def ids(self) -> list[str]:
        return sorted(self._known)

    def load(self, group: str = "discera.genres") -> None:
        """Registers what installed packages offer under an entry point group; each is a function that returns a genre."""
        from importlib.metadata import entry_points

        for point in entry_points(group=group):
            self.register(point.load()())
