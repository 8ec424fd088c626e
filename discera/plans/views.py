"""The engine's tables (documents, units, posts, events, edges, ...) as views of the driver's tables.

Each view stands twice: as a DataFrame for queries, and as a common table expression in
DuckDB's dialect for their oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORIAS = ("euforico", "disforico", "aforico", "ambiforico", "indeterminado")
FORIA_OF = {"purchase": "euforico", "error": "disforico", "click": "aforico", "signup": "ambiforico"}


class Tables:
    """Lazy access to the tables in a folder; attributes are tables, methods are views."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def posts(self) -> DataFrame:
        """One post per turn, answering the turn before; the role is the author."""
        c = self.conversations
        me = F.concat_ws(":", F.col("conv_id"), F.col("turn"))
        before = F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id"), F.col("turn") - 1))
        return c.select(me.alias("post_id"), before.alias("en_respuesta_a"), F.col("conv_id").cast("string").alias("conversacion_id"), F.col("turn"), F.col("role").alias("autor_handle"), F.col("text").alias("texto"))

    def events_view(self) -> DataFrame:
        """Emotion events: a user is a document, its events in the order of time are units."""
        idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
        foria = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in FORIA_OF.items()), F.lit("indeterminado"))
        return self.events.select(F.col("user_id").alias("codigo"), idx.cast("long").alias("frase_idx"), "event_id", F.col("event_type").alias("tipo_emocion"), foria.alias("foria"), "value", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"), "props")

    def post_events(self) -> DataFrame:
        """Events on posts: each word of 4 letters or more whose length is a multiple of 3 is an event; its type is its first letter."""
        words = F.expr("regexp_extract_all(lower(texto), '[a-z]{4,}', 0)")
        p = self.posts().select("post_id", F.posexplode(words).alias("i", "w")).where("length(w) % 3 = 0")
        return p.select("post_id", "i", F.substring("w", 1, 1).alias("tipo"), F.element_at(F.array(*map(F.lit, FORIAS)), (F.length("w") % 5 + 1).cast("int")).alias("foria"))


POSTS = """posts AS (
  SELECT conv_id || ':' || turn AS post_id, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS en_respuesta_a,
         conv_id::VARCHAR AS conversacion_id, turn, role AS autor_handle, text AS texto FROM conversations)"""
EVENTS = """ev AS (
  SELECT user_id AS codigo, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frase_idx, event_id, event_type AS tipo_emocion,
         CASE event_type WHEN 'purchase' THEN 'euforico' WHEN 'error' THEN 'disforico' WHEN 'click' THEN 'aforico' WHEN 'signup' THEN 'ambiforico' ELSE 'indeterminado' END AS foria,
         value, ts, (props::JSON ->> 'k')::BIGINT AS k, props FROM events)"""
POST_EVENTS = (
    POSTS
    + """, pe AS (
  SELECT post_id, i, w[1:1] AS tipo, ['euforico', 'disforico', 'aforico', 'ambiforico', 'indeterminado'][length(w) % 5 + 1] AS foria
  FROM (SELECT post_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT post_id, regexp_extract_all(lower(texto), '[a-z]{4,}') AS ws FROM posts))
  WHERE length(w) % 3 = 0)"""
)
