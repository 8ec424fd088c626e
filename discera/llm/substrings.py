"""Substring dedup: seed with winnowed anchors, extend both ways, keep repeats of `length` words or more.

Words are cut at white space and compared as they are. A window is `length` consecutive
words of one document; every word goes that stands in a window whose words also start
anywhere else, in this document or another. All windows are judged on the input.

1. Seed. Of the word runs of `gram` words in a window the one with the smallest hash (the
   first of equals) is the window's anchor. It depends on the window's words alone, so equal
   windows have equal anchors. Each anchor covers consecutive windows; the words of these are
   its stretch: the anchor, extended both ways as far as its windows go. One row for each
   anchor goes out: hash of the anchor, hash of the stretch, where it begins, its windows.
2. Anchors that stand once are dropped: none of their windows can repeat.
3. Extend. Equal stretches are counted (combined before the shuffle). A stretch that stands
   twice repeats as a whole, wherever it stands. Interiors of copies end here.
4. What is left are the edges of repeats: anchors with different stretches. One example of
   each such stretch gives its windows' hashes; those found in two stretches repeat.
5. The windows found, joined where they overlap, are the maximal repeats of at least `length`
   words; their words are taken out of the text.

The rows follow the number of words, not of pairs: a passage in m documents has m rows for
each anchor and no pair is formed. Keys with many rows are only counted or summed (before
the shuffle) or met in equi-joins, which adaptive execution splits.

Defined cases: null or empty text has no words and an empty result; rows that repeat a
doc_id are documents of their own (equal rows repeat each other); a document of fewer than
`length` words loses nothing; empty tables give empty results; further columns are carried
along unchanged, and added columns whose names the table has already get underscores at the
end. Words and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import map_arrow, own, restored, row_key, saved, split_join

LENGTH, GRAM = 35, 12
SPACE = tk.Alphabet("space", fold=False)
_B = 0x5851F42D4C957F2D
_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and their inverses modulo 2**64, for word positions."""
    if len(_CACHE.get("p", ())) < n:
        size = max(n, 1 << 20)
        p, q = np.full(size, _B, np.uint64), np.full(size, pow(_B, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        if size > 1 << 22:  # an extraordinary document: not kept
            return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
        _CACHE["p"], _CACHE["q"] = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    return _CACHE["p"], _CACHE["q"]


class _Runs:
    """Hashes of any runs of words, from one running sum."""

    def __init__(self, h: np.ndarray):
        self.p, self.q = _powers(len(h) + 1)
        self.sum = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.p[: len(h)], out=self.sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sum[end] - self.sum[start]) * self.q[start]
        return tk.mix(x + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _first_smallest(v: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the place of its smallest, the first of equals."""
    at, have = np.arange(len(v), dtype=np.int64), 1

    def meet(a, b):
        return np.where(v[b] < v[a], b, a)

    while have * 2 <= width:
        at = meet(at[:-have], at[have:])
        have *= 2
    if have < width:
        step = width - have
        at = meet(at[:-step], at[step:])
    return at


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            for lo, hi in tk.chunks(offsets):
                starts, ends, first = tk.words(data, offsets[lo : hi + 1], SPACE)
                counts = np.diff(first)
                if not len(counts) or counts.max() < length:
                    continue
                h = tk.word_hashes(data, starts, ends, SPACE)
                grams = tk.gram_hashes(h, gram)
                doc = np.repeat(np.arange(hi - lo), counts)
                at = _first_smallest(grams, length - gram + 1)  # the anchor of each window
                window = np.flatnonzero(doc[: len(at)] == doc[length - 1 : length - 1 + len(at)])
                at = at[window]
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
                i = np.flatnonzero(new)
                begin, n = window[i], np.diff(np.append(i, len(at)))
                owner = doc[begin]
                stretch = _Runs(h)(begin, begin + n + length - 1)
                keys = batch.column(0).slice(lo, hi - lo).take(pa.array(owner))
                columns = [keys, pa.array(tk.signed(grams[at[i]])), pa.array(tk.signed(stretch)), pa.array((begin - first[owner]).astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "a", "s", "b", "n"])

    return run


def _windows(length: int):
    """The window hashes of examples of stretches; lone: whether the stretch stands once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            wanted = batch.column(2)
            at = 0
            for lo, hi in tk.chunks(offsets):
                starts, ends, first = tk.words(data, offsets[lo : hi + 1], SPACE)
                part = wanted.slice(lo, hi - lo)
                flat, per = part.flatten(), np.asarray(part.value_lengths().fill_null(0)).astype(np.int64)
                b, n, lone = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                owner = np.repeat(np.arange(hi - lo), per)
                n = n.astype(np.int64)
                begin = np.repeat(first[owner] + b, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                h = _Runs(tk.word_hashes(data, starts, ends, SPACE))(begin, begin + length)
                row = np.repeat(owner, n)
                keys = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(tk.signed(h)), pa.array((begin - first[row]).astype(np.int32)), pa.array(np.repeat(lone.astype(bool), n))], ["k", "w", "b", "lone"])
                at = hi

    return run


def _cut(text_at: int, spans_at: int, length: int, drop: bool = False):
    """Appends the number of words, of removed ones, and the words that stay, joined by single spaces; with drop the text itself goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(text_at), batch.column(spans_at)
            total, gone, kept = [], [], []
            for text, own in zip(texts, spans, strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                cut = np.zeros(n + 1, np.int64)
                if own.is_valid:
                    own = own.values
                    begin, count = own.field(0).to_numpy(zero_copy_only=False).astype(np.int64), own.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                    np.add.at(cut, begin, 1)
                    np.add.at(cut, np.minimum(begin + count + length - 1, n), -1)
                hit = np.cumsum(cut[:n]) > 0
                if hit.any():
                    words = [words[i] for i in np.flatnonzero(~hit)]
                total.append(n)
                gone.append(int(hit.sum()))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            columns = [c for i, c in enumerate(batch.columns) if i != spans_at and not (drop and i == text_at)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [f"c{i}" for i in range(len(columns) + 3)])

    return run


def repeats(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """keyed: k long, t string. Returns k and its repeated windows: spans array<struct<b, n>>, n windows from word b on."""
    anchors = map_arrow(keyed, _anchors(length, gram), "k long, a long, s long, b int, n int")
    twice = anchors.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a")
    seeds = saved(split_join(anchors, twice, ["a"]))
    stretches = seeds.groupBy("a", "s").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k", "b", "n")).alias("x"))
    mixed = stretches.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("a")
    edges = split_join(stretches, mixed, ["a"]).select("x.k", F.struct("x.b", "x.n", (F.col("c") == 1).alias("lone")).alias("x"))
    wanted = edges.groupBy("k").agg(F.collect_list("x").alias("xs"))
    windows = map_arrow(keyed.join(wanted, "k").select("k", "t", "xs"), _windows(length), "k long, w long, b int, lone boolean")
    again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.max("lone").alias("l")).where("c > 1 and l").select("w")
    single = split_join(windows.where("lone"), again, ["w"]).select("k", "b", F.lit(1).alias("n"))
    whole = split_join(seeds, stretches.where("c > 1").select("a", "s"), ["a", "s"]).select("k", "b", "n")
    return whole.union(single).groupBy("k").agg(F.collect_set(F.struct("b", "n")).alias("spans"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with sd_words, sd_removed (long) and sd_text, the words that stay, joined by one space."""
    df, (text, doc_id) = own(docs, text, doc_id)
    key, _ = row_key(df, doc_id, text)
    found = repeats(df.select(key.alias("k"), F.col(text).alias("t")), length, gram).select(F.col("k").alias("sd_k"), F.col("spans").alias("sd_spans"))
    out = df.withColumn("sd_row", key).join(found, F.col("sd_row") == F.col("sd_k"), "left").select(*df.columns, "sd_spans")
    schema = T.StructType([*df.schema.fields, T.StructField("sd_words", T.LongType()), T.StructField("sd_removed", T.LongType()), T.StructField("sd_text", T.StringType())])
    return restored(map_arrow(out, _cut(df.columns.index(text), len(df.columns), length), schema), docs.columns, "sd_words", "sd_removed", "sd_text")


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words that stay. Texts are shuffled once: all steps that need them use the same exchange."""
    key, by_id = row_key(docs, "doc_id", "text")
    keyed = docs.select(key.alias("k"), F.col("text").alias("t")).where("k is not null")
    cut = map_arrow(keyed.join(repeats(keyed, length, gram), "k", "left").select("k", "t", "spans"), _cut(1, 2, length, drop=True), "k long, n_words long, n_removed long, kept string")
    rows = cut.select("k", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    if by_id:
        return rows.withColumn("k", F.col("k").cast(docs.schema["doc_id"].dataType)).withColumnRenamed("k", "doc_id")
    return docs.select(key.alias("k"), "doc_id").join(rows.dropDuplicates(["k"]), "k").drop("k")


DIGEST_SQL = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM worded WHERE len(w) >= 35)),
again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hit AS (
  SELECT DISTINCT doc_id, i + o AS i FROM windows JOIN again USING (h), (SELECT unnest(range(0, 35)) AS o)),
words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM worded)
SELECT d.doc_id, count(words.i) AS n_words, count(hit.i) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY words.i) FILTER (hit.i IS NULL), '')) AS kept_sha256
FROM documents d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN hit ON hit.doc_id = words.doc_id AND hit.i = words.i
GROUP BY d.doc_id
"""
