"""Spans with offsets in a text: URLs, hashtags, mentions, emojis, laughter, capitals, lengthening, punctuation."""

from __future__ import annotations

import re
import unicodedata
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: domains of links without a scheme, and the patterns of each kind of span
TLD = "com|net|org|edu|gov|gob|int|mil|info|io|ly|me|tv|app|dev|news|ai|xyz|link|site|online|blog|press|social|fm|cc|sh|be|gl|gd|ar|bo|br|ca|cl|co|de|es|fr|it|mx|pe|pt|py|uk|us|uy|ve"
URL = re.compile(rf"(?:https?://|www\.)\S+|(?<![@\w.\-/])(?:[\w\-]+\.)+(?:{TLD})(?:\.[a-z]{{2}})?(?:/\S*)?(?![\w\-])", re.I)
URL_TAIL = ".,;:!?)»\"'”’…"
HASHTAG = re.compile(r"#(\w+)")
HANDLE = r"[A-Za-z0-9_](?:[A-Za-z0-9_.\-]*[A-Za-z0-9_])?"
MENTION = re.compile(f"@({HANDLE})")
REPOST = re.compile(rf"RT\s+@({HANDLE}):?\s*")
EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿\U0001f1e6-\U0001f1ff❤⭐⬆⬇]")
LAUGHTER = re.compile(r"\b(?:[jk][aeiou]){2,}[jk]?\b|\b(?:js){2,}j?\b", re.I)
LENGTHENED = re.compile(r"\b\w*?(\w)\1{2,}\w*\b")
PUNCTUATION = re.compile(r"[!?]*[!?]{2,}[!?]*|\.{3,}|…+")
CAPITALS = re.compile(r"\b[A-ZÁÉÍÓÚÜÑ]{2,}\b")
WORD = re.compile(r"\b[^\W\d_]{2,}\b")
GAP = 24
LINK_HINT = re.compile(r"https?://|www\.|\w\.\w", re.I)
THRICE = re.compile(r"(\w)\1\1")
OPENING = re.compile(rf"(?:@{HANDLE}[\s,]*)+")
TAIL = re.compile(rf"(?:#\w+|(?:{URL.pattern})|[\s.,;:!?…]+|{EMOJI.pattern})\Z", re.I)
LONE_CAPITALS = re.compile(r"(?=\w*[AEIOUÁÉÍÓÚÜ])(?!\w*(\w)\1{2})\w{5,}")
LINK_LIKE = re.compile(r"[\w\-/?=&%]+\.[A-Za-z]{2,}[\w\-/?=&%.]*\Z")

KIND = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType() if n in ("inicio", "fin") else T.StringType()) for n in ("tipo", "valor", "norm", "inicio", "fin", "extra")]))


# fixed values: classes of punctuation, the first that a run of signs shows
SIGN_CLASSES = (
    ("suspensivos", re.compile(r"…|\A\.{3}")),
    ("interrogacion_exclamacion", re.compile(r"!.*\?|\?.*!")),
    ("exclamacion_multiple", re.compile("!")),
    ("interrogacion_multiple", re.compile(r"\?")),
)
LOOK_BACK = 2048
"""How far back from a text's end, or a run of points, a tag, link or word is looked for at once."""


class _Places:
    """Which characters of a text are taken: one byte for each, so a look and a mark cost their own length."""

    def __init__(self, size: int):
        self.bytes = bytearray(size)

    def free(self, a: int, b: int) -> bool:
        return self.bytes.find(1, a, b) < 0

    def take(self, a: int, b: int) -> None:
        self.bytes[a:b] = b"\1" * (b - a)


def domain_of(url: str) -> str:
    host = re.split(r"[/?]", re.sub(r"^https?://", "", url), maxsplit=1)[0].lower()
    return host.removeprefix("www.")


def _tail(text: str) -> int:
    """Where the closing block of hashtags, links, emojis and signs begins."""
    end = len(text)
    while end and (m := TAIL.search(text, max(0, end - LOOK_BACK), end)) and m.start() < end:
        end = m.start()
    return end


def _shouted(text: str, places: _Places, outer: bytes) -> list[tuple[int, int, str, str]]:
    """Capitals: the whole text where four of five words are (of four at least), else chains of words with short gaps, else long words with a vowel."""
    words = [m.span() for m in CAPITALS.finditer(text) if places.free(*m.span())]
    if not words:
        return []
    spoken = sum(outer.find(1, *m.span()) < 0 for m in WORD.finditer(text))
    if spoken >= 4 and len(words) >= 0.8 * spoken:
        return [(words[0][0], words[-1][1], "mayusculas_sostenidas", "mayusculas:frase")]

    def apart(left: tuple[int, int], right: tuple[int, int]) -> bool:
        gap = text[left[1] : right[0]]
        return not 0 < len(gap) <= GAP or gap.count("\n") > 1 or any(map(str.isalpha, gap)) or not places.free(left[1], right[0])

    cuts = [0, *(i for i, (x, y) in enumerate(pairwise(words), 1) if apart(x, y)), len(words)]
    out = []
    for i, j in pairwise(cuts):
        a, b = words[i][0], words[j - 1][1]
        if j - i > 1:
            out.append((a, b, re.sub(r"[\s,]+", " ", text[a:b]).strip().lower(), "mayusculas:expresion"))
        elif LONE_CAPITALS.match(text, a, b):
            out.append((a, b, text[a:b].lower(), "mayusculas:palabra"))
    return out


def find_spans(text: str | None) -> list[tuple]:
    """All spans by place. What an earlier kind has taken, a later one leaves: links, tags, mentions, emojis, laughter, capitals, lengthening, punctuation. The time is linear in the text."""
    text = text or ""
    places, found = _Places(len(text)), []

    def mark(kind: str, a: int, b: int, norm: str, extra: str = "") -> None:
        found.append((kind, text[a:b], norm, a, b, extra))
        places.take(a, b)

    link_ends = set()
    for m in URL.finditer(text) if LINK_HINT.search(text) else ():
        url = m[0].rstrip(URL_TAIL)
        found.append(("url", url, domain_of(url), m.start(), m.start() + len(url), ""))
        places.take(*m.span())
        link_ends.add(m.end())
    start = OPENING.match(text)
    opening = start.end() if start else 0
    tags = [m for m in HASHTAG.finditer(text) if places.free(*m.span())]
    names = [m for m in MENTION.finditer(text) if places.free(*m.span())]
    end = _tail(text) if tags else len(text)
    for m in tags:
        mark("hashtag", *m.span(), m[1].lower(), "pospuesta" if m.start() >= end else "integrada")
    for m in names:
        mark("mencion", *m.span(), m[1].lower(), "vocativo_inicial" if m.end() <= opening else "integrada")
    for m in () if text.isascii() else EMOJI.finditer(text):
        mark("emoji", *m.span(), unicodedata.name(m[0], "emoji").lower().replace(" ", "_"))
    outer = bytes(places.bytes)
    for m in LAUGHTER.finditer(text):
        if len(m[0]) >= 4 and places.free(*m.span()):
            mark("tecnografismo", *m.span(), "risa", "risa")
    for a, b, norm, extra in _shouted(text, places, outer):
        mark("tecnografismo", a, b, norm, extra)
    for m in LENGTHENED.finditer(text) if THRICE.search(text) else ():
        if places.free(*m.span()) and not any(map(str.isdigit, m[0])):
            mark("tecnografismo", *m.span(), re.sub(r"(\w)\1{2,}", r"\1", m[0]).lower(), "alargamiento")
    for m in PUNCTUATION.finditer(text):
        if not places.free(*m.span()):
            continue
        name = next(n for n, p in SIGN_CLASSES if p.search(m[0]))
        if name == "suspensivos":  # where a link was cut off
            at = m.start()
            low = max(0, at - LOOK_BACK)
            word = text[max(text.rfind(" ", low, at), text.rfind("\n", low, at), low - 1) + 1 : at]
            if at in link_ends or at - 1 in link_ends or LINK_LIKE.search(word):
                continue
        mark("tecnografismo", *m.span(), name, "puntuacion")
    return sorted(found, key=lambda s: (s[3], s[4]))


@F.pandas_udf(KIND)
def spans(texts: pd.Series) -> pd.Series:
    names = ("tipo", "valor", "norm", "inicio", "fin", "extra")
    return texts.map(lambda t: [dict(zip(names, s, strict=True)) for s in find_spans(t)])


def hashtags(c: Column) -> Column:
    """The lowered tags of a text, without offsets, on the JVM."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)), F.lower)


def mentions(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"@({HANDLE})"), F.lit(1)), F.lower)


def urls(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"((?:https?://|www\.)\S+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,;:!?)»\"'”’…]+$", ""))


def repost_handle(c: Column) -> Column:
    h = F.regexp_extract(c, rf"^RT\s+@({HANDLE}):?\s*", 1)
    return F.when(h != "", h)


def mark_run(text: Column, start: Column, end: Column, left: str = "«", right: str = "»") -> Column:
    return F.concat(F.substr(text, F.lit(1), start), F.lit(left), F.substr(text, start + 1, end - start), F.lit(right), F.substr(text, end + 1))


def emoji_affect(spans_df, lexicon):
    """Affect of emojis by the lexicon (emoji, afecto): the exact sequence, else its base without variation and skin tone; ambiguous entries (several affects) say nothing."""
    one = lexicon.groupBy("emoji").agg(F.countDistinct("afecto").alias("n"), F.min("afecto").alias("afecto")).where("n = 1").drop("n")
    base = F.regexp_replace("valor", "[️\U0001f3fb-\U0001f3ff]", "")
    out = spans_df.withColumn("__base", base)
    out = out.join(F.broadcast(one.select(F.col("emoji").alias("valor"), F.col("afecto").alias("__a"))), "valor", "left")  # the lexicon is a file of the knowledge base
    out = out.join(F.broadcast(one.select(F.col("emoji").alias("__base"), F.col("afecto").alias("__b"))), "__base", "left")
    return out.withColumn("afecto", F.coalesce("__a", "__b")).drop("__base", "__a", "__b")
