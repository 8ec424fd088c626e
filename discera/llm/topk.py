"""Exact top-k search by exhaustive term-at-a-time accumulation, partition selection and merge.

Vectors become whole numbers, floor(scale * x), and are held as the terms (dimensions) in which
they are not 0. Queries are held in blocks of at most about `block_bytes`, each sent to all
tasks; every task passes over its candidates in tiles, whose terms are turned into postings. For each
term, the queries that have it scatter their weight times the posting's weights into a
dense array of scores; the best k of a tile are found by partition selection on a key that
joins score and place, and merged into the task's best so far. A task returns k rows per
query, whatever it has read; a window over the queries merges the tasks' results. Candidates
are never shuffled or capped, and a long vector costs its own terms only.

Defined cases: vectors that are null or hold null or non-finite components, or whose scaled
components leave the doubles, take no part, as queries or candidates; a shorter vector counts as 0
in the terms that it lacks; a row is never a candidate of the query with its own vec_id; rows
that repeat a vec_id are candidates of their own, and queries that repeat one share a list;
ties go to the smaller vec_id; null ids take no part; fewer candidates than k are all
returned; scores beyond a long saturate; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, saved

K, SCALE, BLOCK_BYTES, TOGETHER = 5, 256, 8 << 20, 16
Q_TILE, C_TILE = 256, 512
_SAFE = float(1 << 53)
_FIELDS = "query_id long, vec_id long, score long"


class _Sparse:
    """Rows of a batch by vec_id, each with its terms and weights."""

    def __init__(self, batch: pa.RecordBatch, scale: int):
        column = batch.column(1)
        size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        weight = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * float(scale))
        row = np.repeat(np.arange(len(size)), size)
        term = np.arange(len(weight)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.asarray(batch.column(0)).astype(np.int64)
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        some = np.flatnonzero(weight)
        some = some[np.argsort(place[row[some]], kind="stable")]
        self.ids = np.sort(ids, kind="stable")
        self.row, self.term, self.weight = place[row[some]], term[some], weight[some]

    def tile(self, lo: int, hi: int) -> "_Postings":
        a, b = np.searchsorted(self.row, [lo, hi])
        return _Postings(self.row[a:b] - lo, self.term[a:b], self.weight[a:b], self.ids[lo:hi])


class _Postings:
    """For each term of a tile the rows that have it, and their weights."""

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray):
        self.ids = ids
        self.most = np.abs(weight).max(initial=0.0)
        self.length = np.bincount(row, np.abs(weight), minlength=1).max()  # the greatest sum of a row's weights
        order = np.argsort(term, kind="stable")
        names, at = np.unique(term[order], return_index=True)
        self.of = {t: (r, w) for t, r, w in zip(names.tolist(), np.split(row[order], at[1:]), np.split(weight[order], at[1:]), strict=True)} if len(names) else {}


def _scores(q: _Postings, c: _Postings) -> np.ndarray:
    """Term at a time: each query row that has the term scatters its weight times the posting's into dense scores.

    Whole numbers of any size (saturated to longs) where products could leave what doubles hold exactly.
    """
    n, m = len(q.ids), len(c.ids)
    exact = q.length * c.most >= _SAFE / 4
    out = np.zeros((n, m), object if exact else np.float64)
    part = None if exact else np.empty((n, m))
    few, many = (q.of, c.of) if len(q.of) <= len(c.of) else (c.of, q.of)
    for t in few:
        if t not in many:
            continue
        (rows, a), (columns, b) = q.of[t], c.of[t]
        if exact:
            out[np.ix_(rows, columns)] += np.outer(np.array([int(x) for x in a], object), np.array([int(x) for x in b], object))
        elif len(rows) == n and len(columns) == m:
            np.multiply(a[:, None], b[None, :], out=part)
            out += part
        elif len(columns) == m:
            out[rows] += a[:, None] * b[None, :]
        else:
            out[np.ix_(rows, columns)] += a[:, None] * b[None, :]
    if exact:
        top = (1 << 63) - 1
        return np.array([max(-top, min(top, int(x))) for x in out.ravel()], np.int64).reshape(n, m)
    return out


class _Best:
    """The k best (score, vec_id) of each query so far."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.zeros((len(ids), 0), np.int64)
        self.vec = np.zeros((len(ids), 0), np.int64)

    def add(self, rows: slice, score: np.ndarray, vec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best of one tile: candidates stand in the order of vec_id, so the earlier place wins a tie."""
        n = len(vec)
        valid = vec[None, :] != self.ids[rows, None]
        exact = score.dtype != np.int64 and np.abs(score).max(initial=0) * n < _SAFE / 2
        if exact:
            key = np.where(valid, score * n + np.arange(n - 1, -1, -1), -np.inf)
            take = min(self.k, n)
            best = np.argpartition(key, n - take, axis=1)[:, n - take :]
        else:
            order = np.argsort(-np.where(valid, score, np.iinfo(np.int64).min + 1).astype(object), axis=1, kind="stable") if score.dtype == np.int64 else np.argsort(np.where(valid, -score, np.inf), axis=1, kind="stable")
            best = order[:, : self.k]
        ok = np.take_along_axis(valid, best, 1)
        return np.where(ok, np.take_along_axis(score, best, 1), 0).astype(np.int64), np.where(ok, vec[best], NONE)

    def merge(self, score: np.ndarray, vec: np.ndarray) -> None:
        score, vec = np.concatenate([self.score, score], 1), np.concatenate([self.vec, vec], 1)
        order = np.lexsort((vec, -score.astype(np.float64) if np.abs(score).max(initial=0) < 1 << 52 else _rank(score), vec == NONE), axis=1)[:, : self.k]
        self.score, self.vec = np.take_along_axis(score, order, 1), np.take_along_axis(vec, order, 1)


NONE = np.iinfo(np.int64).max
"""Marks the absence of a candidate."""


def _rank(score: np.ndarray) -> np.ndarray:
    """Whole numbers that order scores downwards, free of overflow."""
    values, place = np.unique(score, return_inverse=True)
    return len(values) - place.reshape(score.shape)


def _search(queries: _Sparse | None, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = queries.ids if queries else np.zeros(0, np.int64)
        best = _Best(ids, k)
        tiles = [queries.tile(i, i + Q_TILE) for i in range(0, len(ids), Q_TILE)] if queries else []
        for batch in batches:
            rows = _Sparse(batch, scale)
            for lo in range(0, len(rows.ids), C_TILE):
                tile = rows.tile(lo, min(lo + C_TILE, len(rows.ids)))
                found = [best.add(slice(i * Q_TILE, (i + 1) * Q_TILE), _scores(q, tile), tile.ids) for i, q in enumerate(tiles)]
                if found:
                    best.merge(np.concatenate([s for s, _ in found]), np.concatenate([v for _, v in found]))
        q, s, v = np.repeat(ids, best.vec.shape[1]), best.score.ravel(), best.vec.ravel()
        real = v != NONE
        yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(v[real]), pa.array(s[real])], ["query_id", "vec_id", "score"])

    return run


def _merged(df: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", *, k: int = K, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of all other rows for each row where is_query holds."""
    whole = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * float(scale)) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & whole)
    asked = rows.where(is_query).select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.select(F.col(vec_id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    terms = asked.agg(F.sum(F.size("v") + 1).alias("n")).first()["n"] or 0
    blocks = max(1, -(-terms * 8 // block_bytes))
    done, open_ = [], []
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).toArrow().combine_chunks().to_batches()
        open_.append(map_arrow(rows, _search(_Sparse(part[0], scale) if part else None, k, scale), _FIELDS))
        if len(open_) == TOGETHER and b < blocks - 1:  # blocks of queries do not pile up on the driver
            done.append(saved(_merged(_union(open_), k).select("query_id", "vec_id", "score")))
            open_ = []
    return _merged(_union(done + open_), k).select("query_id", "rank", "vec_id", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


DIGEST_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
