"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over whole documents.

Words are runs of digits, letters a-z (A-Z are lowered) and non-ASCII characters. Each
benchmark item gives all its windows of `window` words, or itself where it is shorter;
an item without words gives none. A document word inside any occurrence of a window is
hit. Hash matches are verified word by word before they count.

The benchmark is read in blocks of at most `block_words` words, each turned into one
closure of bounded size (an item of more words is cut into pieces that overlap by less than a
window); the blocks are chained in one stage over the documents, so documents are never
shuffled, whatever the size of a document or the number of hits.

Defined cases: null or empty text has no words and is clean; a null benchmark text gives
no window; a null item_id is ignored; rows that repeat an item_id count once per id;
repeated documents are judged one by one; empty tables give empty or clean results;
further columns are carried along unchanged, and added columns whose names the table has
already get underscores at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import map_arrow, own, restored, saved

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_WORDS = 1_000_000
ALNUM = tk.Alphabet("alnum", fold=True)
_FILTER = 1 << 20


class WindowIndex:
    """Windows of one benchmark block by length: sorted hashes, each with its item and its place in the block's words.

    pieces: item, text, and whether the text is a whole item (only then may it be shorter than a window). A window
    takes some 16 bytes; the words of those that are met are put together when they are.
    """

    def __init__(self, pieces: list[tuple[str, str, bool]], window: int):
        self.items = [p[0] for p in pieces]
        raw = [p[1].encode("utf-8", "surrogatepass") for p in pieces]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
        self.data = np.frombuffer(b"".join(raw).lower(), np.uint8)
        self.starts, self.ends, first = tk.words(self.data, offsets, ALNUM)
        hashes = tk.word_hashes(self.data, self.starts, self.ends, ALNUM)
        counts = np.diff(first)
        self.by_length = {}
        for k in sorted({min(window, n) for n, p in zip(counts.tolist(), pieces, strict=True) if n and (n >= window or p[2])}):
            whole = np.array([min(window, n) == k and (n >= window or p[2]) for n, p in zip(counts.tolist(), pieces, strict=True)], bool)
            owner = np.repeat(np.arange(len(pieces)), counts)
            grams = tk.gram_hashes(hashes, k)
            at = np.flatnonzero((owner[: len(grams)] == owner[k - 1 :]) & whole[owner[: len(grams)]])
            at = at[np.argsort(grams[at], kind="stable")]
            bits = np.zeros(_FILTER, bool)
            bits[grams[at] & np.uint64(_FILTER - 1)] = True
            self.by_length[k] = (np.packbits(bits), grams[at], at.astype(np.int32), owner[at].astype(np.int32))
        self.met: dict[tuple[int, int], dict[tuple[bytes, ...], set[str]]] = {}

    def _words(self, i: int, k: int) -> tuple[bytes, ...]:
        return tuple(self.data[a:b].tobytes() for a, b in zip(self.starts[i : i + k].tolist(), self.ends[i : i + k].tolist(), strict=True))

    def _texts(self, k: int, lo: int, hi: int) -> dict[tuple[bytes, ...], set[str]]:
        """The windows of one hash, word by word, with their items; kept once met."""
        if (found := self.met.get((k, lo))) is None:
            _, _, at, owner = self.by_length[k]
            found = self.met[k, lo] = {}
            for i, o in zip(at[lo:hi].tolist(), owner[lo:hi].tolist(), strict=True):
                found.setdefault(self._words(i, k), set()).add(self.items[o])
        return found

    def scan(self, data, starts, ends, first, hashes):
        """Hit flags of words, and the items found in each document."""
        n = len(starts)
        delta = np.zeros(n + 1, np.int64)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        items: dict[int, set[str]] = {}
        for k, (bits, known, _, _) in self.by_length.items():
            if n < k:
                continue
            grams = tk.gram_hashes(hashes, k)
            maybe = np.unpackbits(bits).view(bool)[grams & np.uint64(_FILTER - 1)]
            maybe &= doc[: n - k + 1] == doc[k - 1 :]
            maybe = np.flatnonzero(maybe)
            lo, hi = np.searchsorted(known, grams[maybe], "left"), np.searchsorted(known, grams[maybe], "right")
            real = hi > lo
            for i, a, b in zip(maybe[real].tolist(), lo[real].tolist(), hi[real].tolist(), strict=True):
                w = tuple(data[starts[j] : ends[j]].tobytes().lower() for j in range(i, i + k))
                if (found := self._texts(k, a, b).get(w)) is not None:
                    delta[i] += 1
                    delta[i + k] -= 1
                    items.setdefault(int(doc[i]), set()).update(found)
        return np.cumsum(delta[:-1]) > 0, items


def _schema(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in more)])


def _scan(text_at: int, state: int | None, index: WindowIndex, last: bool, clean: bool):
    """The function of one block; state: where the columns of earlier blocks begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.utf8(batch.column(text_at))
            n_words, n_hit, items, places, texts = [], [], [], [], []
            old = None if state is None else (batch.column(state).to_pylist(), batch.column(state + 1).to_pylist())
            for lo, hi in tk.chunks(offsets):
                starts, ends, first = tk.words(data, offsets[lo : hi + 1], ALNUM)
                hit, found = index.scan(data, starts, ends, first, tk.word_hashes(data, starts, ends, ALNUM))
                for d in range(hi - lo):
                    a, b = int(first[d]), int(first[d + 1])
                    at, ids = hit[a:b], found.get(d, set())
                    if old:
                        ids = ids | set(old[1][lo + d])
                        at = at.copy()
                        at[old[0][lo + d]] = True
                    n_words.append(b - a)
                    n_hit.append(int(at.sum()))
                    items.append(sorted(ids))
                    if not last:
                        places.append(np.flatnonzero(at).tolist())
                    if clean and last:
                        texts.append(_cut(data, offsets[lo + d], offsets[lo + d + 1], starts[a:b], ends[a:b], at))
            columns = list(batch.columns[: state if state is not None else batch.num_columns])
            if not last:
                columns += [pa.array(places, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            else:
                columns += [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
                columns += [pa.array(texts, pa.string())] * clean
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


def _cut(data, lo, hi, starts, ends, hit) -> str | None:
    """The text without its runs of hit words; null where nothing is hit."""
    if not hit.any():
        return None
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    parts, at = [], int(lo)
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        parts.append(data[at : starts[a]].tobytes())
        at = int(ends[b - 1])
    parts.append(data[at:hi].tobytes())
    return b"".join(parts).decode("utf-8", "replace")


def _pieces(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> DataFrame:
    """i, t, w: items in pieces of at most about `most` words, which overlap by less than a window, so each window is in one; w: whether the piece is the whole item."""
    words = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    split = benchmark.select(F.col(item).cast("string").alias("i"), words.alias("ws")).where("i is not null and size(ws) > 0")
    at = split.select("i", "ws", F.explode(F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)), F.lit(most))).alias("a"))
    return at.select("i", F.array_join(F.slice("ws", F.col("a") + 1, F.lit(most + window - 1)), " ").alias("t"), (F.size("ws") <= most + window - 1).alias("w"))


def _annotated(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int, block_words: int, clean: bool) -> DataFrame:
    """docs, named by `own`, with dc_words, dc_hit, dc_items and perhaps dc_text."""
    bench = saved(_pieces(benchmark, item, item_text, window, block_words))
    chars = bench.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // (2 * block_words)))  # a word and its separator are two characters at least
    df = docs
    for b in range(blocks):
        rows = [(r.i, r.t, r.w) for r in bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toLocalIterator()]
        last, state = b == blocks - 1, None if b == 0 else len(docs.columns)
        more = [("dc_at", T.ArrayType(T.IntegerType())), ("dc_ids", T.ArrayType(T.StringType()))]
        if last:
            more = [("dc_words", T.LongType()), ("dc_hit", T.LongType()), ("dc_items", T.ArrayType(T.StringType()))] + [("dc_text", T.StringType())] * clean
        df = map_arrow(df, _scan(docs.columns.index(text), state, WindowIndex(rows, window), last, clean), _schema(docs, *more))
    return df


def annotate(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, clean: bool = False) -> DataFrame:
    """docs with dc_words, dc_hit (long) and dc_items (sorted strings); with clean also dc_text, the text without hit words (null: nothing was hit)."""
    df, (text,) = own(docs, text)
    return restored(_annotated(df, benchmark, text, item, item_text, window, block_words, clean), docs.columns, "dc_words", "dc_hit", "dc_items", *["dc_text"] * clean)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without hit words; a document of which no word is left goes, untouched ones stay as they are."""
    df, (text,) = own(docs, text)
    cut = _annotated(df, benchmark, text, item, item_text, window, block_words, True).where("dc_hit = 0 or dc_hit < dc_words")
    return restored(cut.withColumn(text, F.coalesce("dc_text", F.col(text))), docs.columns)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document with its counts and the digest of the items found."""
    df = annotate(docs.select("doc_id", "text"), benchmark)
    return df.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        F.col("dc_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ","), 256).alias("items_sha256"),
        (F.col("dc_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DIGEST_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE item_id IS NOT NULL AND len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, s)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
