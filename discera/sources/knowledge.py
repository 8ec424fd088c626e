"""The knowledge base: catalogues and lexicons in JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_entries(spark: SparkSession, path: str, root: str) -> DataFrame:
    """nombre and entrada (JSON) of the entries under a root key of catalogue files."""
    v = F.try_parse_json("value")
    entries = F.from_json(F.try_variant_get(v, f"$.{root}", "variant").cast("string"), "map<string,string>")
    return spark.read.option("wholetext", True).text(path).select(F.explode(entries).alias("nombre", "entrada"))


def visible(entry: Column, genre: str | None) -> Column:
    """Entries without a list of genres are shared; others are seen by the genres they list. No genre sees all."""
    if genre is None:
        return F.lit(True)
    genres = F.from_json(F.get_json_object(entry, "$.generos"), "array<string>")
    return F.coalesce(F.size(genres) <= 0, F.lit(True)) | F.array_contains(genres, genre)


def for_genre(entries: DataFrame, genre: str | None) -> DataFrame:
    return entries.where(F.coalesce(visible(F.col("entrada"), genre), F.lit(True)))
