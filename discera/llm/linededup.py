"""Line dedup with DataFrame functions only: explode, hash, count documents per hash, drop, reassemble.

A text is split at newlines; a line's key is the line without white space (space, tab to
carriage return) at both ends, A-Z lowered. Keys of at least `min_chars` code points that
stand in at least `min_docs` documents lose their lines everywhere but in the smallest
doc_id that has them; there all its lines stay.

What is shuffled of a line is two 64-bit hashes, its document and its place, never its text,
and the lines of a key are combined before the shuffle (for min_docs = 2 to the smallest and
largest doc_id), so a line in a third of all documents costs one row for each task. Dropped
places come back to their document, whose own text is put together by position; no group of
lines is ever gathered. A document takes time in proportion to its lines.

Defined cases: a null or empty text is one empty line and stays as it is; a key counts once
per doc_id, so rows that repeat a doc_id never shadow each other (they are told apart by a
hash of their text; equal ones lose the same lines); a row with a null doc_id counts nowhere
and keeps all its lines; empty tables give empty results; further columns are carried along
unchanged, and added columns whose names the table has already get underscores at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own, restored, split_join

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _gone(docs: DataFrame, text: Column, doc_id: Column, min_chars: int, min_docs: int) -> DataFrame:
    """d, v (doc_id and hash of a text) and ld_gone: the places of its lines that go, ascending."""
    split = docs.where(doc_id.isNotNull() & (F.char_length(text) >= min_chars)).select(doc_id.alias("d"), F.xxhash64(text).alias("v"), F.split(text, "\n", -1).alias("ls"))
    lines = split.select("d", "v", F.posexplode("ls").alias("i", "l"))  # the text is not copied to each line
    keyed = lines.select("d", "v", "i", key_of(F.col("l")).alias("k")).where(F.char_length("k") >= min_chars)
    rows = keyed.select("d", "v", "i", F.xxhash64("k").alias("a"), F.xxhash64(F.reverse("k"), "k").alias("b"))
    if min_docs == 2:
        held = rows.groupBy("a", "b").agg(F.min("d").alias("keep"), F.max("d").alias("last")).where("keep < last").drop("last")
    else:
        held = rows.select("a", "b", "d").distinct().groupBy("a", "b").agg(F.min("d").alias("keep"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).drop("n")
    return split_join(rows, held, ["a", "b"]).where("d > keep").groupBy("d", "v").agg(F.sort_array(F.collect_set("i")).alias("ld_gone"))


def _annotated(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """docs, named by `own`, with ld_lines, ld_dropped and ld_text."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    gone = _gone(docs, F.col(text), F.col(doc_id), min_chars, min_docs)
    out = docs.join(gone, (F.col(doc_id) == F.col("d")) & (F.xxhash64(text) == F.col("v")), "left")
    # which lines stay: up to each dropped place those since the one before it, and those after the last
    before = F.concat(F.array(F.lit(-1)), F.slice("ld_gone", 1, F.size("ld_gone") - 1))
    runs = F.flatten(F.zip_with("ld_gone", before, lambda i, p: F.concat(F.array_repeat(F.lit(True), i - p - 1), F.array(F.lit(False)))))
    stays = F.concat(runs, F.array_repeat(F.lit(True), F.size(lines) - 1 - F.element_at("ld_gone", -1)))
    kept = F.array_join(F.zip_with(lines, stays, lambda line, s: F.when(s, line)), "\n")  # leaves out nulls
    return out.select(
        *docs.columns,
        F.size(lines).cast("long").alias("ld_lines"),
        F.coalesce(F.size("ld_gone"), F.lit(0)).cast("long").alias("ld_dropped"),
        F.when(F.col("ld_gone").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept).alias("ld_text"),
    )


def annotate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with ld_lines, ld_dropped (long) and ld_text (the lines that stay, joined by newlines)."""
    df, (t, d) = own(docs, text, doc_id)
    return restored(_annotated(df, t, d, min_chars, min_docs), docs.columns, "ld_lines", "ld_dropped", "ld_text")


def clean(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with repeated lines removed; a document of which nothing but white space is left, goes."""
    df, (t, d) = own(docs, text, doc_id)
    out = _annotated(df, t, d, min_chars, min_docs).where((F.col("ld_dropped") == 0) | (F.char_length(F.btrim(F.col("ld_text"), F.lit(SPACE))) > 0))
    return restored(out.withColumn(t, F.when(F.col("ld_dropped") > 0, F.col("ld_text")).otherwise(F.col(t))), docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    df = annotate(docs.select("doc_id", "text"))
    return df.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2("ld_text", 256).alias("kept_sha256"))


DIGEST_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
held AS (
  SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT keyed.*, held.keep IS NOT NULL AND doc_id <> held.keep AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
