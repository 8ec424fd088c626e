"""Secret scans: patterns, and the guess cost of values that stand where credentials do.

Base spans come from three patterns (assign, access, hex), each leftmost and without
overlaps of its own kind. The method adds `guess` spans: a value of 8 or more characters
after a word of the assign pattern and : or =, or after another credential word (pwd,
passphrase, bearer, credentials, private key, ...) and a separator, which overlaps no base
span and whose guess cost is at least `least` (log10). Values after the former come first;
guess spans do not overlap.

Guess cost is the cheapest segmentation of the value, by dynamic programming over its
places: common words (by rank; capitals and look-alike digits cost more), dates, repeats,
keyboard walks, runs of the alphabet, and brute force for any other character, with a price for
each piece. So "Password2024" is cheap and 16 random characters are not.

Texts are scanned where they stand. Cheap byte tests find the documents that can match at
all; only those are decoded. The time is linear in the text: matched pieces have at
most `PIECE` characters, longer ones are chains of pieces, and a value's segmentation ends
where none can cost less than `ENOUGH` any more: such a value's cost is given as at least that
much. Base spans need no judgement and have no cost.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive;
repeated documents are scanned one by one; empty tables give empty results; further columns
are carried along unchanged, and an added column whose name the table has already gets
underscores at the end.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import added_names, map_arrow

# fixed values: the base patterns and the least number of characters
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "guess")
CONTEXT = re.compile(r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|passcode|pin|auth|authorization|bearer|credentials?|private_?key|client_?key|access_?key|secret_?key|encryption_?key|login)["']?(?:\x20*+[:=]\x20*+|\x20++)["']?([^\s"'<>,;]{8,}+)""", re.A | re.I)
BASE_CONTEXT = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", re.A | re.I)
VALUE_END = re.compile(r"""[\s"'<>,;]""", re.A)
NEEDLES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"pwd", b"pass", b"pin", b"auth", b"bearer", b"credential", b"private", b"client", b"access", b"encryption", b"login")
GUESS, ENOUGH = 10.0, 100.0
PIECE = 40
_JOIN = 0.3

# fixed values: words of common passwords, the commonest first
WORDS = """password 123456 qwerty admin welcome letmein login master secret changeme default test guest root user
dragon monkey shadow sunshine princess football baseball superman batman trustno hello freedom whatever michael jordan
hunter ranger buster soccer hockey killer george andrew charlie thomas daniel jessica pepper ginger summer winter spring
autumn monday friday january february march april june july august september october november december love lover angel
secure system server database oracle mysql postgres backup public private example sample demo token passwd pass key
access client service account company internet computer network office manager student teacher school london berlin paris
madrid cookie coffee banana orange purple yellow silver golden diamond tiger lion eagle phoenix thunder matrix ninja
mustang ferrari mercedes porsche harley cowboy chelsea arsenal liverpool barcelona your here none null true false enter
value replace insert placeholder dummy temp temporary foobar test123 abc123 iloveyou passwort geheim schatz hallo
motdepasse bonjour soleil contraseña hola amor""".split()
LOOKALIKE = str.maketrans("4@831!0$57", "aabeiiosst")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATES = [re.compile(p) for p in (r"(?:19|20)\d\d[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", r"(?:19|20)\d\d")]
DATE_COST = (log10(365 * 120), log10(365 * 120), log10(120))


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, int], int, dict[str, set[str]]]:
    ranks = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
    beside: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, c in enumerate(row):
            near = {row[x + d] for d in (-1, 1) if 0 <= x + d < len(row)}
            for dy, shift in ((-1, (0, 1)), (1, (-1, 0))):  # each row stands half a key to the right of the one above
                if 0 <= y + dy < len(ROWS):
                    near |= {ROWS[y + dy][x + s] for s in shift if 0 <= x + s < len(ROWS[y + dy])}
            beside[c] = near
    return ranks, max(map(len, ranks)), beside


def _brute(c: str) -> float:
    return log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def guess_cost(value: str, enough: float = float("inf")) -> float:
    """log10 of the guesses that the cheapest segmentation needs; where that is more than enough, some bound below it that is enough."""
    ranks, longest, beside = _tables()
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    plain = low.translate(LOOKALIKE)
    best = [0.0] + [float("inf")] * n

    def offer(i: int, j: int, cost: float) -> None:
        if best[i] + cost + _JOIN < best[j]:
            best[j] = best[i] + cost + _JOIN

    reach = PIECE + longest  # no piece is longer: every segmentation has a border among so many places
    for i in range(n):
        if i % reach == 0 and i >= reach and (least := min(best[i - reach : i + 1])) >= enough:
            return least
        c = best[i] + _brute(value[i])
        if c < best[i + 1]:
            best[i + 1] = c
        for j in range(i + 3, min(n, i + longest) + 1):
            for text, extra in ((low[i:j], 0.0), (plain[i:j], 0.6)):
                if (rank := ranks.get(text)) is not None:
                    capitals = 0.0 if value[i:j].islower() or not value[i:j].isalpha() else 0.3 if value[i].isupper() else 1.0
                    offer(i, j, log10(rank + 1) + extra + capitals)
                    break
        if value[i].isdigit():
            for pattern, cost in zip(DATES, DATE_COST, strict=True):
                if m := pattern.match(value, i):
                    offer(i, m.end(), cost)
        j = i + 1
        while j < n and j - i < PIECE and low[j] in beside.get(low[j - 1], ()):
            j += 1
            if j - i >= 3:
                offer(i, j, log10(47) + 0.35 * (j - i))
        for step in (1, -1):
            j = i + 1
            while j < n and j - i < PIECE and ord(value[j]) - ord(value[j - 1]) == step and value[j].isalnum():
                j += 1
                if j - i >= 3:
                    offer(i, j, log10(26) + 0.3 + log10(j - i))
        for size in (1, 2, 3, 4):
            unit, j = value[i : i + size], i + size
            cost = sum(map(_brute, unit))
            while j + size <= n and j - i < PIECE and value.startswith(unit, j):
                j += size
                if j - i >= 3:
                    offer(i, j, cost + log10((j - i) / size))
    return best[n]


def _base_values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values after the words of the assign pattern stand; they may overlap."""
    end = -1
    for m in BASE_CONTEXT.finditer(text):
        a = m.end()
        if a > end:
            stop = VALUE_END.search(text, a)
            end = stop.start() if stop else len(text)
        if end - a >= LEAST["assign"]:
            yield a, end


def find(text: str, least: float = GUESS) -> list[tuple[str, int, int, str, float | None]]:
    """(kind, start, end, value, guess cost of guess spans) of all spans, by start and kind."""
    spans = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    spans += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    spans += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    out = [(*s, None) for s in spans]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    for a, b in sorted((s[1], s[2]) for s in spans):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for a, b in chain(_base_values(text), (m.span(1) for m in CONTEXT.finditer(text))):
        at = bisect_left(taken, (b,))
        if at and taken[at - 1][1] > a:
            continue
        if (cost := guess_cost(text[a:b], max(least, ENOUGH))) >= least:
            out.append(("guess", a, b, text[a:b], cost))
            taken.insert(at, (a, b))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _may(data: np.ndarray, offsets: np.ndarray) -> Iterator[int]:
    """Documents that hold a keyword, AKIA or 32 hexadecimal digits in a row."""
    hexadecimal = np.zeros(256, bool)
    hexadecimal[0x30:0x3A] = hexadecimal[0x61:0x67] = True
    for lo, hi in tk.chunks(offsets):
        a, z = int(offsets[lo]), int(offsets[hi])
        other = np.flatnonzero(~hexadecimal[data[a:z]])
        other = np.concatenate([[-1], other, [z - a]])
        long = np.flatnonzero(np.diff(other) > LEAST["hex"])
        runs = set()
        # a run may cross the borders of documents: each of them is held against its own part
        for x, y in zip((other[long] + 1 + a).tolist(), (other[long + 1] + a).tolist(), strict=True):
            first, last = int(np.searchsorted(offsets, x, "right")) - 1, int(np.searchsorted(offsets, y, "left"))
            parts = np.diff(np.clip(offsets[first : last + 1], x, y))
            runs.update((first + np.flatnonzero(parts >= LEAST["hex"])).tolist())
        for d in range(lo, hi):
            raw = data[offsets[d] : offsets[d + 1]].tobytes()
            low = raw.lower()
            if d in runs or b"AKIA" in raw or any(w in low for w in NEEDLES):
                yield d


def _scan(text_at: int, least: float):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("cost", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(text_at))
            out: list[list] = [[] for _ in range(batch.num_rows)]
            for d in _may(data, offsets):
                text = data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
                out[d] = [dict(zip(("kind", "start", "end", "value", "cost"), s, strict=True)) for s in find(text, least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [f"c{i}" for i in range(batch.num_columns + 1)])

    return run


def scan(docs: DataFrame, text: str = "text", *, least: float = GUESS) -> DataFrame:
    """docs with sc_spans: array<struct<kind, start, end, value, cost>>, by start and kind."""
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("cost", T.DoubleType())])
    return map_arrow(docs, _scan(docs.columns.index(text), least), T.StructType([*docs.schema.fields, T.StructField(added_names(docs.columns, ["sc_spans"])[0], T.ArrayType(span))]))


def digest(docs: DataFrame) -> DataFrame:
    df = scan(docs.select("doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("sc_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(written(F.filter("sc_spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        written(F.col("sc_spans")).alias("spans"),
    )
