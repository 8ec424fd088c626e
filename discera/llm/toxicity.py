"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

1. A bounded sample of labelled training rows (`per_class` of each class, in hash order;
   the only rows whose labels are seen) gives lexicons: word beginnings of 3 to 9 bytes and
   whole words that stand in many toxic and few clean sample documents, either at all or
   densely. A fixed list of common insults is added.
2. Lexicons are parted by their evidence: the fixed list; words, short and long beginnings
   that stand in a document at all; and the same three that stand densely. Each is a voter,
   beside patterns (shouting, strings of marks, the second person near an insult) and the given
   label. A voter says toxic, clean or nothing. Expectation maximisation over the sample estimates the share of toxic
   documents and each voter's rates in both classes; voters whose errors go together (the
   correlation of their residuals) share their weight.
3. Logistic regression is fitted to the posteriors, on counts and densities of the lexicons'
   hits and the patterns. It scores every whole text, null ones as empty.

Only text is an input of a score. Documents are scored where they stand, in pieces of
bounded size, without a shuffle. A lexicon entry stands in 1 of 50 toxic sample documents (densely:
1 of 200) at least, so their number is bounded by the sample's size and texts, not by the
corpus; all that meet the conditions are kept. Words are compared by hash.

Defined cases: empty and null texts have the score of a text without words; a label that is
neither 0 nor 1, a null doc_id in labels, or a doc_id with both labels teaches nothing; without
toxic or without clean training rows only the fixed list and the patterns vote; repeated
documents are scored one by one; further columns are carried along unchanged, and an added
column whose name the table has already gets underscores at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import map_arrow, own, restored

PER_CLASS = 4000
THRESHOLD = 0.7
LETTERS = tk.Alphabet("letters", fold=True)
LENGTHS = (3, 4, 5, 6, 7, 8, 9)
PARTS = 3
_BITS = 1 << 18

# fixed values: common insults, by language, and second person pronouns
INSULTS = """idiot idiots moron stupid dumb loser losers scum trash worthless pathetic disgusting clown bastard
idiotisch dumm trottel abschaum wertlos widerlich arschloch idiot
imbécile stupide minable ordure connard salaud dégoûtant débile
idiota estúpido imbécil basura escoria patético asqueroso cabrón""".split()
PRONOUNS = "you your yours u du dich dein deine ihr tu toi ton ta vous votre tú usted vosotros".split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).lower().encode(), np.uint8)
    starts, ends, _ = tk.words(data, np.array([0, len(data)]), LETTERS)
    return np.unique(tk.word_hashes(data, starts, ends, LETTERS))


def _features(data, starts, ends) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hash, word number) of word beginnings and, as length 0, of words."""
    yield 0, tk.word_hashes(data, starts, ends, LETTERS), np.arange(len(starts))
    size = ends - starts
    for n in LENGTHS:
        at = np.flatnonzero(size > n)
        yield n, tk.word_hashes(data, starts[at], starts[at] + n, LETTERS) ^ np.uint64(n), at


def _patterns(data, lo: int, hi: int, words: int) -> tuple[float, float]:
    """Shares of capital letters among letters, and of ! and ? among words."""
    c = np.bincount(data[lo:hi], minlength=256)
    upper, lower = int(c[65:91].sum()), int(c[97:123].sum())
    return upper / (upper + lower + 20), (int(c[33]) + int(c[63])) / (words + 20)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature the sample documents of each class that have it, at all and densely."""
    for batch in batches:
        data, offsets = tk.utf8(batch.column(0))
        toxic = np.asarray(batch.column(1)).astype(bool)
        for lo, hi in tk.chunks(offsets):
            starts, ends, first = tk.words(data, offsets[lo : hi + 1], LETTERS)
            counts = np.diff(first)
            doc = np.repeat(np.arange(hi - lo), counts)
            for n, h, at in _features(data, starts, ends):
                d = doc[at]
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, int)
                c = np.diff(np.append(new, len(h)))
                h, d = h[new], d[new]
                dense = (c >= 2) & (c >= 0.008 * counts[d])
                t = toxic[lo:hi][d]
                u, inv = np.unique(h, return_inverse=True)
                sums = [np.bincount(inv, x, minlength=len(u)).astype(np.int64) for x in (t, ~t, t & dense, ~t & dense)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), n, np.int32)), pa.array(tk.signed(u)), *map(pa.array, sums)], ["n", "h", "t", "c", "td", "cd"])


class Model:
    """Lexicons (hash to a bit mask of voters' parts) and the classifier's weights."""

    def __init__(self, lexicon: dict[int, int]):
        self.lexicon = lexicon
        self.keys = np.array(sorted(lexicon), np.uint64)
        self.kinds = np.array([lexicon[k] for k in self.keys.tolist()], np.int64)
        self.bits = np.zeros(_BITS, bool)
        self.bits[self.keys & np.uint64(_BITS - 1)] = True
        self.pronouns = _hash_words(PRONOUNS)
        self.mean = self.scale = self.weight = None
        self.bias = 0.0

    def measure(self, data, offsets) -> np.ndarray:
        """A row of measures for each document: hits and densities by part, patterns."""
        docs = len(offsets) - 1
        starts, ends, first = tk.words(data, offsets, LETTERS)
        counts = np.diff(first)
        doc = np.repeat(np.arange(docs), counts)
        hit = np.zeros(len(starts), np.int64)
        second = np.zeros(docs)
        for n, h, at in _features(data, starts, ends):
            maybe = np.flatnonzero(self.bits[h & np.uint64(_BITS - 1)])
            if len(self.keys) and len(maybe):
                i = np.searchsorted(self.keys, h[maybe])
                i[i == len(self.keys)] = 0
                hit[at[maybe]] |= np.where(self.keys[i] == h[maybe], self.kinds[i], 0)
            if n == 0:
                second = np.bincount(doc[np.isin(h, self.pronouns)], minlength=docs)
        columns = []
        size = counts + 10.0
        for part in range(N_PARTS + 1):
            has = (hit != 0) if part == N_PARTS else (hit >> part & 1).astype(bool)
            k = np.bincount(doc[has], minlength=docs)
            columns += [k, k / size]
        caps = np.array([_patterns(data, int(offsets[d]), int(offsets[d + 1]), int(counts[d])) for d in range(docs)]).reshape(docs, 2)
        return np.column_stack([*columns, caps, second / size, counts])

    def score(self, m: np.ndarray) -> np.ndarray:
        x = (_inputs(m) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


GENERAL, ANY, DENSE = 0, 1, 1 + PARTS
N_PARTS = 1 + 2 * PARTS


def _inputs(m: np.ndarray) -> np.ndarray:
    hits, density = m[:, 0 : 2 * N_PARTS + 2 : 2], m[:, 1 : 2 * N_PARTS + 2 : 2]
    return np.column_stack([np.log1p(np.minimum(hits, 8)), np.minimum(density, 0.03) * 100, m[:, -4:-1]])


def _votes(m: np.ndarray, label: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing; a column for each voter, the label last."""
    columns = []
    for part in range(N_PARTS + 1):
        k, density = m[:, 2 * part], m[:, 2 * part + 1]
        sure = density >= (0.004 if part <= PARTS else 0.01)
        columns.append(np.where((k >= (2 if DENSE <= part < N_PARTS else 1)) & sure, 1, np.where((k == 0) & ((part == N_PARTS) | (part == GENERAL)) | (density < 0.002), -1, 0)))
    caps, marks, second = m[:, -4], m[:, -3], m[:, -2]
    every = m[:, 2 * N_PARTS]
    columns.append(np.where((caps > 0.5) & (every > 0), 1, 0))
    columns.append(np.where((marks > 0.2) & (every > 0), 1, 0))
    columns.append(np.where((second > 0) & (every > 0), 1, 0))
    columns.append(np.where(label > 0, 1, -1))
    return np.column_stack(columns)


def label_model(votes: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posteriors of class 1, and what was estimated. Each voter has, for each class, rates of its three votes.

    The last voter is the given label. Pseudo-counts say that voters are right rather than wrong, the label
    much more so, and that its share of toxic rows is about right; so classes cannot change places or merge.
    A voter that always says the same says nothing.
    """
    n, k = votes.shape
    given = votes[:, -1] > 0
    q = np.where(given, 0.9, 0.1)
    weight = np.ones(k)
    live = (votes != votes[0]).any(0)
    trust = np.full(k, 0.02 * n)
    trust[-1] = 0.5 * n
    for _ in range(rounds):
        prior = np.clip((q.sum() + given.sum()) / (2 * n), 0.01, 0.99)
        rates = np.empty((2, 3, k))
        for c, w in ((1, q), (0, 1 - q)):
            for v in (-1, 0, 1):
                rates[c, v + 1] = ((votes == v) * w[:, None]).sum(0) + 0.5 + (trust if v == 2 * c - 1 else 0)
            rates[c] /= rates[c].sum(0)
        expected = q[:, None] * (rates[1, 2] - rates[1, 0]) + (1 - q[:, None]) * (rates[0, 2] - rates[0, 0])
        residual = votes - expected
        spread = residual.std(0) + 1e-9
        correlation = (residual.T @ residual) / n / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        weight = live / (1 + np.clip(correlation, 0, 1).sum(1))
        ratio = np.log(rates[1]) - np.log(rates[0])
        logit = np.log(prior / (1 - prior)) + (ratio[votes + 1, np.arange(k)] * weight).sum(1)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            q = new
            break
        q = new
    accuracy = prior * rates[1, 2] + (1 - prior) * rates[0, 0]
    return q, {"prior": prior, "accuracy": accuracy, "correlation": correlation, "weight": weight}


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton's method on soft labels y with row weights w."""
    x1 = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x1.shape[1])
    pull = np.full(len(b), ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ b, -30, 30)))
        g = x1.T @ (w * (p - y)) / w.sum() + pull * b
        h = (x1 * (w * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x1 / w.sum() + np.diag(pull)
        step = np.linalg.solve(h, g)
        b -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


def _part(n: int) -> int:
    """Words, short and long beginnings are lexicons of their own."""
    return 0 if n == 0 else 1 if n <= 5 else 2


def _lexicon(rows: list) -> dict[int, int]:
    """Hash to a bit mask of lexicons, from features and whether they stand out at all and densely."""
    out = {int(h): 1 << GENERAL for h in _hash_words(INSULTS)}
    for r in rows:
        h = r.h & 0xFFFFFFFFFFFFFFFF
        for kind, stands in ((ANY, r.any), (DENSE, r.dense)):
            if stands:
                out[h] = out.get(h, 0) | 1 << (kind + _part(r.n))
    return out


def _stands_out(t: Column, c: Column, toxic: int, clean: int, least: float) -> Column:
    """By the z-score of the shares p and q of both classes' documents."""
    p, q, pool = t / float(toxic), c / float(clean), (t + c) / float(toxic + clean)
    z = (p - q) / F.sqrt(pool * (1 - pool) * (1 / toxic + 1 / clean) + 1e-12)
    return (z >= 4) & (t >= 3) & (p >= least) & (q <= 0.03 * p + 0.0005)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", label_id: str = "doc_id", *, per_class: int = PER_CLASS) -> Model:
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(label_id).alias("d")).agg(F.min(label).alias("y"), F.max(label).alias("z")).where(F.col("d").isNotNull() & (F.col("y") == F.col("z")) & ~held_out(F.col("d"))).select("d", "y")
    order = [F.xxhash64(F.lit("toxicity"), F.col("d").cast("string")), "d"]
    picked = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(*order).limit(per_class).collect()]  # bounded: 2 * per_class ids
    sample = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.select(F.col(doc_id).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(sample), "d").select("t", "y")
    size = {y: sum(r.y == y for r in picked) for y in (0, 1)}
    mined = map_arrow(rows, _mine, "n int, h long, t long, c long, td long, cd long").groupBy("n", "h").agg(*(F.sum(c).alias(c) for c in ("t", "c", "td", "cd")))
    found = []
    if min(size.values()) >= 2:
        marks = [_stands_out(F.col(t), F.col(c), size[1], size[0], least).alias(n) for t, c, least, n in (("t", "c", 0.02, "any"), ("td", "cd", 0.005, "dense"))]
        found = mined.select("n", "h", *marks).where("any or dense").collect()  # bounded by the sample
    model = Model(_lexicon(sorted(found, key=lambda r: (r.h, r.n))))

    def measured(batches):
        for b in batches:
            data, offsets = tk.utf8(b.column(0))
            m = [model.measure(data, offsets[lo : hi + 1]) for lo, hi in tk.chunks(offsets)]
            m = np.concatenate(m) if m else np.zeros((0, 2 * N_PARTS + 6))
            yield pa.RecordBatch.from_arrays([tk.lists(m.ravel(), np.full(len(m), m.shape[1]), pa.float64()), b.column(1).cast(pa.int32())], ["m", "y"])

    got = map_arrow(rows, measured, "m array<double>, y int").collect()  # bounded by per_class
    if {r.y for r in got} == {0, 1}:
        m, y = np.array([r.m for r in got]), np.array([r.y for r in got])
    else:
        m, y = _default_rows()
    q, model.estimates = label_model(_votes(m, y))
    x = _inputs(m)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    model.weight, model.bias = _logistic((x - model.mean) / model.scale, q, np.ones(len(q)))
    return model


def _default_rows() -> tuple[np.ndarray, np.ndarray]:
    """Stands in for a sample where a class is missing: texts with more and more insults, and without."""
    m = np.zeros((200, 2 * N_PARTS + 6))
    for i in range(100):
        k, n = 1 + i % 5, 20 + 3 * i
        for part in (GENERAL, N_PARTS):
            m[i, 2 * part], m[i, 2 * part + 1] = k, k / (n + 10)
        m[i, -1] = m[100 + i, -1] = n
    return m, np.repeat([1, 0], 100)


def _scorer(text_at: int, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = tk.utf8(b.column(text_at))
            s = [model.score(model.measure(data, offsets[lo : hi + 1])) for lo, hi in tk.chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *s]))], [f"c{i}" for i in range(b.num_columns + 1)])

    return run


def _scored(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, options: dict) -> DataFrame:
    """docs, named by `own`, with tx_score."""
    model = train(docs, labels, text, doc_id, **options)
    return map_arrow(docs, _scorer(docs.columns.index(text), model), T.StructType([*docs.schema.fields, T.StructField("tx_score", T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with tx_score (0 to 1)."""
    df, names = own(docs, text, doc_id)
    return restored(_scored(df, labels, *names, options), docs.columns, "tx_score")


def clean(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs without those that score threshold or more."""
    df, names = own(docs, text, doc_id)
    return restored(_scored(df, labels, *names, options).where(F.col("tx_score") < threshold), docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    df = score(docs.select("doc_id", "text"), labels)
    return df.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tx_score").alias("score"), F.when(F.col("tx_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
