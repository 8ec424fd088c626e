"""Language identification: scripts narrow the candidates, then Viterbi over word scores labels spans.

Words are runs of letters (ASCII letters, A-Z folded, and whatever is not ASCII). A language
scores a word by the log probabilities of its byte trigrams, counted (hashed to 2**15 classes)
over all training rows: those with a language whose crc32(doc_id) mod 3 is not 1. A word's
script, from the lead bytes of its characters, leaves as candidates the languages that
write at least `rare` of their training words in it (all, if none does). Viterbi with a
penalty for each change of language labels the words; runs of one label are the spans,
and the language with most bytes of words is the document's.

Counting combines within each task, so what is shuffled and collected is one row per
language and class, whatever the input. Labelling happens where the document stands:
documents of a batch step together, longest first, in groups of bounded size, so a very
long document takes no more memory than its own words.

Defined cases: a null text or one without any letter (by Unicode) is `und` with score 0 and no
spans; ties go to the language that comes first by code point; without training rows every
document is `und`; repeated documents are labelled one by one; empty tables give empty
results; further columns are carried along unchanged, and added columns whose names the table
has already get underscores at the end. Of more than `languages` values of lang, those with
fewer training words are not learnt (ties: the first by code point); what is shuffled, collected
and sent to the tasks is bounded by that, whatever stands in lang.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import added_names, map_arrow, saved

LETTERS = tk.Alphabet("letters", fold=True)
CLASSES = 1 << 15
PENALTY, RARE, NARROW = 12.0, 0.001, 30.0
GROUP_WORDS = 1 << 20

_FOLD = np.zeros(256, np.uint32)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def _scripts() -> np.ndarray:
    """Script of a character by the first byte of its UTF-8; 0 is Latin, also of what tells nothing."""
    t = np.zeros(256, np.uint8)
    # fixed values: ranges of lead bytes for Greek, Cyrillic, Armenian, Hebrew, Arabic, Syriac to NKo, Indic and Thai, Georgian to Khmer, Kana, Han, Hangul, other planes
    for i, (lo, hi) in enumerate([(0xCD, 0xCF), (0xD0, 0xD4), (0xD5, 0xD5), (0xD6, 0xD7), (0xD8, 0xDB), (0xDC, 0xDF), (0xE0, 0xE0), (0xE1, 0xE1), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED), (0xF0, 0xF4)], 1):
        t[lo : hi + 1] = i
    return t


_SCRIPT = _scripts()
N_SCRIPTS = int(_SCRIPT.max()) + 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The trigram class of each byte in the range of the words, and each word's script."""
    lo, hi = int(starts[0]), int(ends[-1])
    c = np.zeros(hi - lo + 2, np.uint32)
    c[1:-1] = _FOLD[data[lo:hi]]
    g = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    return (g >> np.uint32(17)).astype(np.int32), np.maximum.reduceat(_SCRIPT[data[lo:hi]], starts - lo)


def _pieces(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + tk.PIECE * 4)))
        yield i, j
        i = j


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, lang. At the end one row per language and class that occurs; scripts are classes from CLASSES on."""
    keys, sums, names = np.zeros(0, np.int64), np.zeros(0, np.int64), {}
    size = CLASSES + N_SCRIPTS
    for b in batches:
        data, offsets = tk.utf8(b.column(0))
        lang = np.array([names.setdefault(x, len(names)) for x in b.column(1).to_pylist()], np.int64)
        found = [keys]
        times = [sums]
        for lo, hi in tk.chunks(offsets):
            starts, ends, first = tk.words(data, offsets[lo : hi + 1], LETTERS)
            of = np.repeat(lang[lo:hi], np.diff(first))
            for i, j in _pieces(starts, ends):
                g, script = _grams(data, starts[i:j], ends[i:j])
                base = int(starts[i])
                inside = LETTERS.word[data[base : int(ends[j - 1])]]
                owner = np.repeat(of[i:j], ends[i:j] - starts[i:j])
                for x in (owner * size + g[inside], of[i:j] * size + CLASSES + script):
                    u, n = np.unique(x, return_counts=True)
                    found.append(u)
                    times.append(n)
        keys, at = np.unique(np.concatenate(found), return_inverse=True)
        sums = np.bincount(at, np.concatenate(times), minlength=len(keys)).astype(np.int64)
    lang = np.array(list(names), object)
    for lo in range(0, len(keys), 1 << 16):
        k = keys[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(lang[k // size], pa.string()), pa.array((k % size).astype(np.int32)), pa.array(sums[lo : lo + (1 << 16)])], ["lang", "c", "n"])


class Model:
    def __init__(self, counts: pa.Table, rare: float):
        lang = np.array(counts.column("lang").to_pylist(), object)
        self.langs = sorted(set(lang.tolist()))
        n = np.zeros((len(self.langs), CLASSES + N_SCRIPTS))
        if self.langs:
            n[np.searchsorted(self.langs, lang.astype(str)), counts.column("c").to_numpy()] = counts.column("n").to_numpy()
        grams, scripts = n[:, :CLASSES] + 0.5, n[:, CLASSES:]
        self.table = np.ascontiguousarray(np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32))
        share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
        out = share < rare
        out[:, out.all(0)] = False
        self.narrow = np.ascontiguousarray((out * -NARROW).T.astype(np.float32))

    def words(self, data, starts, ends) -> np.ndarray:
        """A score for each word and language."""
        score = np.empty((len(starts), len(self.langs)), np.float32)
        for i, j in _pieces(starts, ends):
            g, script = _grams(data, starts[i:j], ends[i:j])
            base = int(starts[i])
            inside = LETTERS.word[data[base : int(ends[j - 1])]]
            size = ends[i:j] - starts[i:j]
            edge = np.cumsum(size) - size
            g = g[inside]
            for k in range(len(self.langs)):
                score[i:j, k] = np.add.reduceat(self.table[g, k], edge)
            score[i:j] += self.narrow[script]
        return score


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of words; document d has the words first[d] to first[d + 1]. Documents step together."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    begin, size = first[:-1][order], size[order]
    back = np.empty(score.shape, np.uint8 if score.shape[1] < 256 else np.int32)
    label = np.zeros(len(score), np.int32)
    if not len(order):
        return label
    itself = np.arange(score.shape[1])
    v = score[begin].copy()
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # documents with at least so many words
    for t in range(1, int(size[0])):
        a = active[t]
        at, u = begin[:a] + t, v[:a]
        jump = u.max(1, keepdims=True) - penalty
        stay = u >= jump
        back[at] = np.where(stay, itself, u.argmax(1)[:, None])
        v[:a] = score[at] + np.where(stay, u, jump)
    state = v.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        label[at] = state[:a]
        if t:
            state[:a] = back[at, state[:a]]
    return label


def _has_letter(text: np.ndarray, ascii_letters: np.ndarray) -> bool:
    if ascii_letters[text[:200]].any() or ascii_letters[text].any():
        return True
    return any(map(str.isalpha, text.tobytes().decode("utf-8", "replace")))


def _label(text_at: int, model: Model, penalty: float, spans: bool):
    n_langs = len(model.langs)

    ascii_letters = np.zeros(256, bool)
    ascii_letters[65:91] = ascii_letters[97:123] = True

    def finish(held: list) -> Iterator[pa.RecordBatch]:
        """Labels the documents of the batches held, all together, and yields the batches."""
        parts = [x for _, scored in held for x in scored]
        words = np.concatenate([x[0] for x in parts]) if parts else np.zeros((0, max(n_langs, 1)), np.float32)
        size = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in parts)])
        counts = np.concatenate([np.zeros(0, np.int64), *(x[2] for x in parts)])
        first = np.concatenate([[0], np.cumsum(counts)])
        label = viterbi(words, first, penalty)
        doc = np.repeat(np.arange(len(counts)), counts)
        mass = np.bincount(doc * max(n_langs, 1) + label, size, minlength=len(counts) * max(n_langs, 1)).reshape(len(counts), -1)
        cut = np.ones(len(label), bool)
        cut[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(cut)
        many, d = np.diff(np.append(at, len(label))), 0
        edge = np.searchsorted(doc[at], np.arange(len(counts) + 1))
        for batch, _ in held:
            data, offsets = tk.utf8(batch.column(text_at))
            names, score, marks = [], [], []
            for i in range(batch.num_rows):
                total = mass[d].sum() if n_langs else 0.0
                if total > 0 and _has_letter(data[offsets[i] : offsets[i + 1]], ascii_letters):
                    best = int(mass[d].argmax())
                    names.append(model.langs[best])
                    score.append(float(mass[d, best] / total))
                    own = range(int(edge[d]), int(edge[d + 1])) if spans else ()
                    marks.append([{"lang": model.langs[label[at[j]]], "word": int(at[j] - first[d]), "words": int(many[j])} for j in own])
                else:
                    names.append("und")
                    score.append(0.0)
                    marks.append([])
                d += 1
            columns = [*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())]
            if spans:
                columns.append(pa.array(marks, pa.list_(pa.struct([("lang", pa.string()), ("word", pa.int32()), ("words", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            data, offsets = tk.utf8(batch.column(text_at))
            scored = []
            for lo, hi in tk.chunks(offsets):
                starts, ends, first = tk.words(data, offsets[lo : hi + 1], LETTERS)
                if n_langs and len(starts):
                    scored.append((model.words(data, starts, ends), ends - starts, np.diff(first)))
                else:
                    scored.append((np.zeros((0, max(n_langs, 1)), np.float32), np.zeros(0, np.int64), np.zeros(hi - lo, np.int64)))
                many += len(scored[-1][0])
            held.append((batch, scored))
            if many >= GROUP_WORDS:
                yield from finish(held)
                held, many = [], 0
        if held:
            yield from finish(held)

    return run


LANGUAGES = 256
"""The most values of lang that are learnt; each is 130 kB of the model."""


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", *, rare: float = RARE, languages: int = LANGUAGES) -> Model:
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counts = map_arrow(rows, _count, "lang string, c int, n long").groupBy("lang", "c").agg(F.sum("n").alias("n"))
    counts = saved(counts)
    words = counts.where(F.col("c") >= CLASSES).groupBy("lang").agg(F.sum("n").alias("w"))
    top = words.orderBy(F.desc("w"), "lang").limit(languages).select("lang")
    return Model(counts.join(F.broadcast(top), "lang").toArrow(), rare)  # at most `languages` rows


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", *, penalty: float = PENALTY, spans: bool = True, model: Model | None = None) -> DataFrame:
    """docs with li_lang, li_score (share of the words' bytes) and, if asked for, li_spans (language, first word, words)."""
    model = model or train(docs, text, lang, doc_id)
    more = [T.StructField("li_lang", T.StringType()), T.StructField("li_score", T.DoubleType())]
    if spans:
        more.append(T.StructField("li_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("word", T.IntegerType()), T.StructField("words", T.IntegerType())]))))
    more = [T.StructField(n, f.dataType) for n, f in zip(added_names(docs.columns, [f.name for f in more]), more, strict=True)]
    return map_arrow(docs, _label(docs.columns.index(text), model, penalty, spans), T.StructType([*docs.schema.fields, *more]))


def digest(docs: DataFrame) -> DataFrame:
    model = train(docs.select("doc_id", "text", "lang"))
    df = identify(docs.select("doc_id", "text"), model=model)
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"), F.size("li_spans").alias("n_spans"))
