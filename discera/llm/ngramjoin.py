"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct shingles of `k` words (A-Z lowered, words cut at white
space); a document with fewer words has its whole sequence as its only shingle, one
without words has none. Documents link where 100 * |x & y| >= percent * |x | y|. The
result is each document's set size and its component under links; every decision is exact
but for 64-bit hashes of shingles.

1. Equal sets (128-bit digests) form classes; from step 3 on only the smallest member counts.
2. A safe first filter on the smallest hashes of each set: of the first n - ceil(t n) + l
   shingles in any common order, a linked pair shares as many as the smaller l of the two, so
   that many must stand in another document. What falls here has no link to another set.
   One row per shingle goes out, with its document.
3. For what is left all shingles are counted, and those of one document only are dropped:
   they come first in the rare-first order, so they fill the prefix. The others are kept
   sorted by frequency. Sets with too few of them fall.
4. Star: within the documents that have a shingle in their prefix, all are held against the
   one with the fewest lone shingles, which is near most of its kin; each document
   is verified against the leader it meets most often. So a group of m near copies gives m
   pairs, not m * m / 2.
5. The rest, exactly: where a prefix shingle still joins different components, every
   document outside its largest component is paired with all documents of other components
   that pass the length and positional filters; pairs are made distinct, pass the suffix
   filter (an upper bound of the overlap from counts in hash classes) and are verified once.
   Pairs within a component need no check: they cannot change the result.

A shingle that a fiftieth of all documents have is found beforehand, by lossy counting in each
task: one that has a share of all rows has it in some task's rows. Such shingles are known to be
shared and stand last in the rare-first order; their rows are dealt by document when
shingles are counted, so no task holds all rows of one. Any order would be exact. Joins on
shingles are plain equi-joins which adaptive execution splits.

Defined cases: null or empty text has size 0 and is a component of its own; rows that
repeat a doc_id are documents of their own, and a null doc_id never becomes a component
id while the component has another; ties go to the smallest doc_id; empty tables give
empty results; further columns are carried along unchanged, and added columns whose names
the table has already get underscores at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as tk
from .common import components, likely_in, map_arrow, own, restored, row_key, saved, split_join

K, PERCENT = 5, 75
SPACE = tk.Alphabet("space", fold=True)
BINS = 16


def _sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of documents: their distinct shingle hashes, each document's ascending, and the set sizes."""
    data, offsets = tk.utf8(column)
    for lo, hi in tk.chunks(offsets):
        starts, ends, first = tk.words(data, offsets[lo : hi + 1], SPACE)
        h = tk.word_hashes(data, starts, ends, SPACE)
        counts = np.diff(first)
        doc = np.repeat(np.arange(hi - lo), counts)
        grams = tk.gram_hashes(h, k)
        whole = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
        grams, owner = grams[whole], doc[: len(whole)][whole]
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            short = np.array([tk.gram_hashes(h[first[d] : first[d + 1]], int(counts[d]))[0] for d in few], np.uint64)
            grams, owner = np.concatenate([grams, short]), np.concatenate([owner, few])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
        yield grams, np.bincount(owner, minlength=hi - lo)


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """n - ceil(t n) + 1: a linked pair shares one of so many first shingles."""
    return np.where(n > 0, n - (n * percent + 99) // 100 + 1, 0)


HOT = 0.02
"""Shingles that so many of all documents have (for certain; from half as many on, perhaps) are known to be shared and go round the frequency counts."""


class _Frequent:
    """Lossy counting of the shingles that a task sees: an entry may miss HOT / 8 of the documents at most, and there are never many more than a few thousand a shingle of the mean set."""

    def __init__(self):
        self.names, self.counts, self.missed, self.docs = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def add(self, grams: np.ndarray, docs: int) -> None:
        before = int(self.docs * HOT / 8)
        self.docs += docs
        values, counts = np.unique(grams, return_counts=True)
        names, at = np.unique(np.concatenate([self.names, values]), return_inverse=True)
        total, missed = np.zeros(len(names), np.int64), np.full(len(names), before)
        total[at[: len(self.names)]], missed[at[: len(self.names)]] = self.counts, self.missed
        total[at[len(self.names) :]] += counts
        stay = total + missed > self.docs * HOT / 8
        self.names, self.counts, self.missed = names[stay], total[stay], missed[stay]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        stay = (self.counts >= self.docs * HOT * 3 / 8) & (self.counts > 1)
        return self.names[stay], self.counts[stay]


def _sizes(k: int):
    """A row for each document; and rows without a key, whose da is a shingle that is frequent in a task and n its count there."""

    def run(batches):
        frequent = _Frequent()
        for b in batches:
            n, da, db = [], [], []
            for grams, counts in _sets(b.column(1), k):
                edge = np.concatenate([[0], np.cumsum(counts)])
                for out, salt in ((da, 0x9E3779B97F4A7C15), (db, 0xD1B54A32D192ED03)):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(grams * np.uint64(salt)), dtype=np.uint64)])
                    out.append(tk.signed(tk.mix(total[edge[1:]] - total[edge[:-1]] + counts.astype(np.uint64))))
                n.append(counts)
                frequent.add(grams, len(counts))
            join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(join(n), pa.int64()), pa.array(join(da)), pa.array(join(db))], ["k", "n", "da", "db"])
        names, times = frequent.found()
        nothing = pa.nulls(len(names), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, pa.array(times, pa.int64()), pa.array(tk.signed(names)), nothing], ["k", "n", "da", "db"])

    return run


def _tokens(k: int, percent: int | None, hot: np.ndarray):
    """The first shingles of each set in hash order (all where percent is None). hot: the frequent ones, the rarest first; what stands for them is odd and keeps that order, all others are even."""
    order = np.argsort(hot)
    names, places = hot[order], (order.astype(np.uint64) << np.uint64(1)) | np.uint64(1)

    def run(batches):
        for b in batches:
            at = 0
            for grams, n in _sets(b.column(1), k):
                take = n if percent is None else np.minimum(n, _prefix(n, percent) + n // SAMPLE)
                edge = np.concatenate([[0], np.cumsum(n)])
                rank = np.arange(len(grams)) - np.repeat(edge[:-1], n)
                kept = grams[rank < np.repeat(take, n)]
                i = np.minimum(np.searchsorted(names, kept), max(len(names) - 1, 0))
                kept = np.where(names[i] == kept, places[i], kept & ~np.uint64(1)) if len(names) else kept & ~np.uint64(1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(n)), pa.array(n, pa.int64()), tk.lists(tk.signed(kept), take, pa.int64())], ["k", "n", "h"])
                at += len(n)

    return run


SAMPLE = 25
"""The first filter looks at n // SAMPLE shingles more, and asks for as many more shared ones."""


def _enough(overlap: Column, n: Column, m: Column, percent: int) -> Column:
    """overlap >= percent % of the union of sets of sizes n and m."""
    return (100 + percent) * overlap >= percent * (n + m)


def roots(docs: DataFrame, key: Column, text: str = "text", *, k: int = K, percent: int = PERCENT) -> DataFrame:
    """nj_key, nj_size and nj_root, the smallest key reachable, for each key."""
    keyed = docs.select(key.alias("k"), F.col(text).alias("t"))
    counted = saved(map_arrow(keyed, _sizes(k), "k long, n long, da long, db long"))
    sizes = counted.where("k is not null")
    least = HOT * 3 / 8 * sizes.count()
    often = counted.where("k is null").groupBy("da").agg(F.sum("n").alias("n")).where((F.col("n") > 1) & (F.col("n") >= least)).orderBy("n", "da").toArrow()
    hot = np.asarray(often.column("da")).astype(np.int64).view(np.uint64)  # at most 8 / (3 * HOT) times the mean size of a set
    classes = sizes.where("n > 0").groupBy("da", "db", "n").agg(F.min("k").alias("rep"))

    is_hot = F.col("h").bitwiseAND(1) == 1
    # rows of a frequent shingle need not meet: they are dealt by document, and their order among themselves is known
    counts = F.when(is_hot, F.lit(1 << 40)).otherwise(F.count(F.lit(1)).over(W.partitionBy("h", F.when(is_hot, F.col("k")).otherwise(F.lit(0)))))
    sample = map_arrow(keyed, _tokens(k, percent, hot), "k long, n long, h array<long>").select("k", F.explode("h").alias("h"))
    shared = sample.withColumn("c", counts).where("c > 1").groupBy("k").agg(F.count(F.lit(1)).alias("s"))
    left = saved(shared.join(classes.select(F.col("rep").alias("k"), "n").distinct(), "k").where(F.expr(f"s >= 1 + n * {percent} div {100 * SAMPLE}")).select("k"))

    full = map_arrow(likely_in(keyed, left, "k").join(left, "k"), _tokens(k, None, hot), "k long, n long, h array<long>").select("k", "n", F.explode("h").alias("h"))
    ranked = full.withColumn("c", counts).where("c > 1").groupBy("k", "n").agg(F.sort_array(F.collect_set(F.struct("c", "h"))).alias("o"))
    sets = ranked.where(F.size("o") * 100 >= F.col("n") * percent)
    hashes = F.transform("o", lambda x: x["h"])
    bins = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.size(F.filter("o", lambda x: F.pmod(x["h"], F.lit(BINS)) == i)))
    sets = saved(sets.select("k", "n", (F.col("n") - F.size("o")).alias("lone"), hashes.alias("h"), bins.alias("bins")))

    head = sets.select("k", "n", "lone", F.posexplode(F.expr(f"slice(h, 1, int(greatest(0, n - (n * {percent} + 99) div 100 + 1 - lone)))")).alias("i", "h"))
    head = head.select("h", "k", "n", "lone", (F.col("lone") + F.col("i")).alias("p"))

    leaders = head.groupBy("h").agg(F.min(F.struct("lone", "k", "n", "p")).alias("x"), F.count(F.lit(1)).alias("c")).where("c > 1")
    near = split_join(head, leaders.select("h", F.col("x.k").alias("lk"), F.col("x.n").alias("ln"), F.col("x.p").alias("lp")), ["h"]).where("k <> lk").where(_may(F.col("n"), F.col("p"), F.col("ln"), F.col("lp"), percent))
    best = near.groupBy("k", "lk").agg(F.count(F.lit(1)).alias("c")).groupBy("k").agg(F.max(F.struct("c", F.negative("lk").alias("x"))).alias("m"))
    stars = _verified(best.select(F.col("k").alias("a"), F.negative(F.col("m.x")).alias("b")), sets, percent)
    stars = saved(stars)
    roots = components(stars)

    labelled = head.join(roots.select(F.col("node").alias("k"), "root"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    per = labelled.groupBy("h", "root").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("h").agg(F.max(F.struct("c", "root")).alias("m"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("h", F.col("m.root").alias("main"))
    opened = saved(split_join(labelled, main, ["h"]))
    minor = opened.where("root <> main").select("h", *(F.col(c).alias(f"x_{c}") for c in ("k", "n", "p", "root")))
    pairs = opened.join(minor, "h").where((F.col("root") != F.col("x_root")) & _may(F.col("n"), F.col("p"), F.col("x_n"), F.col("x_p"), percent))
    pairs = pairs.select(F.greatest("k", "x_k").alias("a"), F.least("k", "x_k").alias("b")).distinct()
    more = _verified(pairs, sets, percent)
    final = components(stars.unionByName(more))

    members = split_join(sizes.where("n > 0").select("da", "db", "n", "k"), classes, ["da", "db", "n"]).select("k", "n", "rep")
    members = members.union(sizes.where("n = 0").select("k", "n", F.lit(None).cast("long"))).dropDuplicates(["k"])
    classed = members.join(final.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return classed.select(F.col("k").alias("nj_key"), F.col("n").alias("nj_size"), F.coalesce("root", "rep", "k").alias("nj_root"))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs with nj_size and nj_component (long)."""
    df, (text, doc_id) = own(docs, text, doc_id)
    key, by_id = row_key(df, doc_id, text)
    result = roots(df, key, text, **options)
    out = df.withColumn("nj_row", key).join(result, F.col("nj_row") == F.col("nj_key"), "left")
    if by_id:
        return restored(out.withColumn("nj_component", F.col("nj_root")), docs.columns, "nj_size", "nj_component")
    names = df.select(key.alias("k"), F.col(doc_id).alias("d")).join(result, F.col("k") == F.col("nj_key")).groupBy(F.col("nj_root").alias("nj_r")).agg(F.min("d").alias("nj_component"))
    return restored(out.join(names, F.col("nj_root") == F.col("nj_r")), docs.columns, "nj_size", "nj_component")


def _may(n: Column, p: Column, m: Column, q: Column, percent: int) -> Column:
    """Length filter, and positional filter for a first common shingle at positions p and q."""
    lengths = (100 * F.least(n, m)) >= (percent * F.greatest(n, m))
    return lengths & _enough(F.least(n - p, m - q), n, m, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that link; the suffix filter comes before the intersection."""
    side = lambda x: sets.select(F.col("k").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "h", "bins")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.aggregate(F.zip_with("a_bins", "b_bins", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    linked = F.when(_enough(most, F.col("a_n"), F.col("b_n"), percent), _enough(F.size(F.array_intersect("a_h", "b_h")), F.col("a_n"), F.col("b_n"), percent))
    return both.where(linked).select("a", "b")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs, but one row of each component of linked documents: that with the smallest doc_id. Documents without words stay."""
    df, (text, doc_id) = own(docs, text, doc_id)
    key, by_id = row_key(df, doc_id, text)
    if by_id:
        gone = roots(df, key, text, **options).where("nj_root <> nj_key").select("nj_key")
        return restored(df.join(gone, key == F.col("nj_key"), "left_anti"), docs.columns)
    result = roots(df, key, text, **options)
    named = df.select(key.alias("nj_row"), F.col(doc_id).alias("nj_d")).join(result.where("nj_size > 0"), F.col("nj_row") == F.col("nj_key"))
    first = F.min(F.struct(F.col("nj_d").isNull().alias("nj_null"), "nj_d", "nj_row"))  # a document without an id comes last
    keep = named.groupBy("nj_root").agg(first.alias("nj_m")).select(F.col("nj_m.nj_row").alias("nj_key"))
    rows = df.withColumn("nj_row", key)
    one = rows.join(keep, F.col("nj_row") == F.col("nj_key"), "left_semi").dropDuplicates(["nj_row"])
    blank = rows.join(result.where("nj_size = 0").select("nj_key"), F.col("nj_row") == F.col("nj_key"), "left_semi")
    return restored(one.union(blank), docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text")).select("doc_id", F.col("nj_size").alias("n_shingles"), F.col("nj_component").alias("component_id"))


DIGEST_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0) GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meets AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM meets JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(y) AS component_id
FROM documents d JOIN reached r ON r.x = d.doc_id LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""
