"""Inference as a pluggable map, and the deterministic rules around it."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from discera.functions.text import cache_key, fold, literal_mark


class Backend(Protocol):
    """A model: one answer (JSON text) for each prompt of a batch."""

    def generate(self, prompts: list[str]) -> list[str]: ...


class StubBackend:
    """Answers that depend on the prompt alone, with one label in each field; for tests and dry runs."""

    def __init__(self, labels: tuple[str, ...] = ("alegria", "ira", "miedo", "calma"), fields: tuple[str, ...] = ("tipo_emocion",)):
        self.labels, self.fields = labels, fields

    def generate(self, prompts: list[str]) -> list[str]:
        pick = lambda p: self.labels[int(hashlib.sha256(p.encode()).hexdigest(), 16) % len(self.labels)]
        return [json.dumps(dict.fromkeys(self.fields, pick(p))) for p in prompts]


class StubBatches:
    """Answers to batch prompts: a label for each unit by its text, the last unit first, each with its first word as anchor."""

    def __init__(self, labels: tuple[str, ...] = ("alegria", "ira", "miedo", "calma"), base: int = 0):
        self.one, self.base = StubBackend(labels), base

    def generate(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            units = json.loads(p)
            items = [{"unit_idx": u["unit_idx"] + self.base, "ancla": (u["texto"] or "").split(" ")[0], **json.loads(self.one.generate([u["texto"] or ""])[0])} for u in units]
            out.append(json.dumps(items[::-1], ensure_ascii=False))
        return out


class ModelError(Exception):
    """An error that asking again does not mend."""


class TransientError(ModelError):
    """An error that may be gone a little later: a timeout, a refused connection, a rate limit."""


class ContextTooLong(ModelError):
    """The batch does not fit the model; halves of it may."""


@dataclass(frozen=True)
class Policy:
    """How often a batch is asked again after a transient error and how long before each (the last delay repeats), and after how many failed batches in a row a task stops asking (0: never)."""

    retries: int = 3
    delays: tuple[float, ...] = (2.0, 8.0, 15.0)
    breaker: int = 5
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self) -> None:
        if self.retries < 0 or self.breaker < 0 or not self.delays:
            raise ValueError("retries and breaker are 0 or more, and there is a delay at least")

    def call(self, ask: Callable[[], list[str]]) -> list[str]:
        waits = [self.delays[min(i, len(self.delays) - 1)] for i in range(self.retries)]
        for wait in [*waits, None]:
            try:
                return ask()
            except TransientError:
                if wait is None:
                    raise
                self.sleep(wait)
        raise AssertionError


def aligned(answer: str, size: int, anchors: list[str | None] | None = None, index: str = "unit_idx", anchor: str = "ancla") -> list[str]:
    """One JSON item for each unit of a batch, from an answer that is a list of items in any order.

    An item belongs to the unit whose number it states, from 0 or, if all do, from 1; where the numbers are not those
    of the batch, or an item does not repeat the anchor of its unit (compared without case and outer white space),
    nothing of the answer can be trusted and all of it is refused.
    """
    try:
        items = json.loads(answer)
        stated = {int(x[index]): x for x in items}
    except (ValueError, TypeError, KeyError) as e:
        raise ModelError("the answer is no list of numbered items") from e
    base = 1 if 0 not in stated else 0
    if len(items) != size or set(stated) != set(range(base, base + size)):
        raise ModelError("the answer's numbers are not those of the batch")
    plain = lambda x: " ".join(str(x or "").casefold().split())
    if anchors is not None and any(a is not None and plain(stated[i + base].get(anchor)) != plain(a) for i, a in enumerate(anchors)):
        raise ModelError("an item does not repeat its unit's anchor")
    return [json.dumps({k: v for k, v in stated[i + base].items() if k not in (index, anchor)}, ensure_ascii=False) for i in range(size)]


def infer(df: DataFrame, prompt: Column, make: Callable[[], Backend], batch: int = 16, out: str = "payload", error: str = "error", policy: Policy | None = None) -> DataFrame:
    """df with the model's answer, or the error that its batch met.

    A batch that does not fit, or fails in another way that is not transient, is asked again in halves; transient
    errors are tried again by the policy. After so many failed batches in a row the rest of the task's rows get
    an error without being asked (they are pending again in the next run).
    """
    rows = df.withColumn("__prompt", prompt)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])
    policy = policy or Policy()

    def run(parts: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        model = make()
        failed = 0

        def ask(prompts: list[str]) -> list[tuple[str | None, str | None]]:
            try:
                answers = policy.call(lambda: model.generate(prompts))
                if len(answers) != len(prompts):
                    raise ModelError("answers do not match the batch")
                return [(a, None) for a in answers]
            except Exception as e:  # noqa: BLE001  an error of the model is a result of its rows
                if len(prompts) == 1 or isinstance(e, TransientError):
                    return [(None, str(e)[:200])] * len(prompts)
                half = len(prompts) // 2
                return ask(prompts[:half]) + ask(prompts[half:])

        for pdf in parts:
            prompts = pdf.pop("__prompt").tolist()
            got: list[tuple[str | None, str | None]] = []
            for i in range(0, len(prompts), batch):
                if policy.breaker and failed >= policy.breaker:
                    got += [(None, "the model failed too often in this task")] * len(prompts[i : i + batch])
                    continue
                answers = ask(prompts[i : i + batch])
                failed = failed + 1 if all(a is None for a, _ in answers) else 0
                got += answers
            pdf[out], pdf[error] = [g[0] for g in got], [g[1] for g in got]
            yield pdf

    return rows.mapInPandas(run, schema)


def infer_batches(df: DataFrame, unit: Column, anchor: Column, make: Callable[[], Backend], batch: int = 16, out: str = "payload", error: str = "error", policy: Policy | None = None) -> DataFrame:
    """Like infer, where the model sees a batch of units in one prompt (a JSON list of numbers and texts) and answers with a list of numbered items, which `aligned` gives back to their units."""
    rows = df.withColumn("__text", unit).withColumn("__anchor", anchor)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(error, T.StringType())])
    policy = policy or Policy()

    def run(parts: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        model = make()

        def ask(texts: list[str], anchors: list[str | None], again: bool = True) -> list[tuple[str | None, str | None]]:
            prompt = json.dumps([{"unit_idx": i, "texto": x} for i, x in enumerate(texts)], ensure_ascii=False)
            try:
                return [(x, None) for x in aligned(policy.call(lambda: model.generate([prompt]))[0], len(texts), anchors)]
            except ContextTooLong as e:
                if not again or len(texts) == 1:
                    return [(None, str(e)[:200])] * len(texts)
                half = len(texts) // 2
                return ask(texts[:half], anchors[:half], False) + ask(texts[half:], anchors[half:], False)
            except Exception as e:  # noqa: BLE001
                return [(None, str(e)[:200])] * len(texts)

        for pdf in parts:
            texts, anchors = pdf.pop("__text").tolist(), pdf.pop("__anchor").tolist()
            got = [x for i in range(0, len(texts), batch) for x in ask(texts[i : i + batch], anchors[i : i + batch])]
            pdf[out], pdf[error] = [g[0] for g in got], [g[1] for g in got]
            yield pdf

    return rows.mapInPandas(run, schema)


def cached_infer(df: DataFrame, cache: DataFrame, prompt: Column, version: str, make: Callable[[], Backend], batch: int = 16) -> tuple[DataFrame, DataFrame]:
    """(df with payload, new cache rows): answers by key of prompt and version come from the cache; each missing prompt is asked once."""
    keyed = df.withColumn("__key", cache_key(F.lit(version), prompt)).withColumn("__p", prompt)
    missing = keyed.select("__key", "__p").dropDuplicates(["__key"]).join(cache.select(F.col("key").alias("__key")), "__key", "left_anti")
    fresh = infer(missing, F.col("__p"), make, batch).where("error is null").select(F.col("__key").alias("key"), "payload")
    known = cache.select("key", "payload").unionByName(fresh)
    return keyed.join(known, keyed["__key"] == known["key"], "left").drop("__key", "__p", "key"), fresh


def order_by_evidence(marks: Column, text: Column) -> Column:
    """Marks by their first place in the text; those that are not in it come last, in the order given."""
    at = lambda m: F.when(F.instr(text, m) > 0, F.instr(text, m)).otherwise(F.lit(1_000_000))
    keyed = F.transform(marks, lambda m, i: F.struct(at(m).alias("at"), i.alias("i"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x["m"])


def normalize_emotion(type_: Column, experiencer: Column, mark: Column, text: Column, speaker: Column) -> Column:
    """The rules on an event that a model found: a role label is the speaker; a mark that is not in the unit word for word is not identified; an event whose mark is cognitive and has no lexical evidence is dropped (null)."""
    role = F.regexp_replace(F.trim(fold(experiencer)), "^(el|la|los|las) ", "").isin("enunciador", "enunciadora", "enunciante")
    who = F.when(role, F.trim(F.coalesce(speaker, F.lit("")))).otherwise(F.trim(experiencer))
    clause = F.size(F.split(F.trim(F.coalesce(mark, F.lit(""))), r"\s+")) > 6
    literal = literal_mark(mark, text) & ~clause
    # fixed values: verbs of thinking and knowing, whose presence alone shows no emotion
    thinks = fold(mark).rlike(r"\b(creo|pienso|considero|opino|entiendo|se que|sabemos|creemos)\b")
    return F.when(~(thinks & ~F.contains(fold(text), fold(type_))), F.struct(F.trim(type_).alias("tipo_emocion"), who.alias("experienciador"), F.when(literal, F.trim(mark)).otherwise("no identificado").alias("marca")))


def attribution(experiencer: Column, speaker: Column, mark: Column, explicit: Column) -> Column:
    """auto, hetero or sin atribucion, by who feels and whether it is said."""
    same = F.trim(fold(experiencer)) == F.trim(fold(speaker))
    first = fold(mark).rlike(r"\b(yo|me|mi|nosotros|nos|ojala|quiero|queremos)\b|(emos|amos|imos)\b")
    none = F.trim(F.coalesce(experiencer, F.lit(""))) == ""
    return F.when(none, "sin atribucion").when(same & (explicit | first), "auto").when(same, "sin atribucion").otherwise("hetero")
