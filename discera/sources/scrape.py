"""Document scrapers: list the URLs of a range of dates, fetch pages, and turn them into documents."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discera.functions.text import clean_whitespace, strip_boilerplate
from discera.sources import html as ht


class Site(Protocol):
    """fetch returns a page's HTML, or None where there is none."""

    def fetch(self, url: str) -> str | None: ...


def in_range(entries: DataFrame, first: str, last: str) -> DataFrame:
    """Entries (url, fecha) of a range of dates, each url once; entries without a date stay."""
    return entries.where(F.col("fecha").isNull() | F.col("fecha").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).groupBy("url").agg(F.min("fecha").alias("fecha"))


def fetch(entries: DataFrame, site: Site) -> DataFrame:
    """Entries with their pages."""

    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({"url": pdf["url"], "fecha": pdf["fecha"], "html": [site.fetch(u) for u in pdf["url"]]})

    return entries.select("url", "fecha").mapInPandas(run, "url string, fecha date, html string")


def documents(pages: DataFrame, boilerplate: list[str] = ()) -> DataFrame:
    """Pages (url, html) as documents: title from the head, text without markup and known lines."""
    title = F.coalesce(F.nullif(ht.meta(F.col("html"), "og:title"), F.lit("")), ht.title(F.col("html")))
    rows = pages.where(F.col("html").isNotNull()).select(F.coalesce(F.nullif(ht.canonical(F.col("html")), F.lit("")), F.col("url")).alias("url"), title.alias("titulo"), ht.html_text("html").alias("contenido"))
    return rows.withColumn("contenido", strip_boilerplate(clean_whitespace(F.col("contenido")), list(boilerplate))).where("contenido <> ''")
