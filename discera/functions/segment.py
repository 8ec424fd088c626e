"""Segmentation of texts into units: sentences, paragraphs, documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: abbreviations after which a point ends no sentence
ABBREVIATIONS = set("sr sra srta dr dra ing lic prof av avda calle ej etc vs p pp no".split())
_END = re.compile(r"(?P<close>[.!?]+[\")\]]?)\s+(?=[A-ZÁÉÍÓÚÑÜ¡¿])")

_WORD_BEFORE = re.compile(r"\S+\Z")


def paragraphs(c: Column, least: int = 30) -> Column:
    """Texts between blank lines of at least so many characters; the first one if none is that long."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    long = F.filter(parts, lambda p: F.length(p) >= least)
    return F.when(F.size(long) > 0, long).otherwise(F.slice(parts, 1, 1))


def document(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))


def _ends(text: str) -> list[str]:
    out, at = [], 0
    for m in _END.finditer(text):
        last = _WORD_BEFORE.search(text, max(0, m.start() - 40), m.start())
        if not last or last[0].lower() not in ABBREVIATIONS:
            out.append(text[at : m.end("close")].strip())
            at = m.end()
    return [s for s in [*out, text[at:].strip()] if s]


def _shorten(sentence: str, most: int) -> list[str]:
    """Parts at semicolons if all fit, else runs of comma parts that fit, else the sentence."""
    if len(sentence) <= most:
        return [sentence]
    cut = lambda sign: [p for p in map(str.strip, sentence.split(sign)) if p]
    if len(parts := cut(";")) > 1 and max(map(len, parts)) <= most:
        return parts
    runs: list[str] = []
    for p in cut(","):
        if runs and len(runs[-1]) + 2 + len(p) <= most:
            runs[-1] += ", " + p
        else:
            runs.append(p)
    return runs if len(cut(",")) > 1 and max(map(len, runs)) <= most else [sentence]


def split_sentences(text: str | None, most: int = 400, least: int = 15) -> list[str]:
    """Sentences of a text; long ones are parted, short ones go with the next (the last with the one before)."""
    parts = [p for s in _ends(text or "") for p in _shorten(s, most)]
    out: list[str] = []
    held = ""
    for p in parts:
        held = f"{held} {p}" if held else p
        if len(held) >= least:
            out.append(held)
            held = ""
    if held:
        out[-1:] = [f"{out[-1]} {held}"] if out else [held]
    return [s for s in map(str.strip, out) if s]


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(texts: pd.Series) -> pd.Series:
    return texts.map(split_sentences)


def units(c: Column, unit: str) -> Column:
    """Units of a text: frase, parrafo or documento."""
    return {"frase": sentences, "parrafo": paragraphs, "documento": document}[unit](c)
