"""Web pages and feeds: text, metadata, sitemaps and RSS."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIP = {"script", "style", "template", "noscript", "title"}
BREAK = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer", "header", "nav", "ul", "ol", "table"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in SKIP:
            self.hidden += 1
        elif tag in BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BREAK - {"br"}:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def text_of(html: str | None) -> str:
    """Plain text; paragraphs and breaks are newlines, blank lines go."""
    p = _Text()
    p.feed(html or "")
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<html[^>]*\blang=["']([^"']+)""", 1)


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by name or property, in either order of its attributes."""
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]*\b(?:name|property)=["']{name}["'][^>]*\bcontent=["']([^"']*)""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]*\bcontent=["']([^"']*)["'][^>]*\b(?:name|property)=["']{name}["']""", 1)
    return F.when(a != "", a).otherwise(b)


def canonical(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<link[^>]*\brel=["']canonical["'][^>]*\bhref=["']([^"']*)""", 1)


def json_ld(html: Column, path: str) -> Column:
    """A path in the first JSON-LD block."""
    block = F.regexp_extract(html, r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""", 1)
    v = F.try_parse_json(block)
    return F.coalesce(F.try_variant_get(v, path, "string"), F.try_variant_get(v, path.replace("$", "$[0]", 1), "string"))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a[^>]*\bhref=["']([^"']*)"""), F.lit(1))


def sitemap(xml: DataFrame, column: str = "value") -> DataFrame:
    """url and date of the entries of sitemaps."""
    each = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("u")
    return xml.select(each).select(F.trim(F.regexp_extract("u", r"<loc>\s*([^<]*)", 1)).alias("url"), F.try_to_date(F.substring(F.regexp_extract("u", r"<lastmod>\s*([^<]*)", 1), 1, 10), "yyyy-MM-dd").alias("fecha")).where("url <> ''")


def feed(xml: DataFrame, column: str = "value") -> DataFrame:
    """url and date of the items of RSS and the entries of Atom feeds."""
    item = F.regexp_extract_all(F.col(column), F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    rows = xml.select(F.explode(item).alias("i"))
    url = F.coalesce(F.nullif(F.trim(F.regexp_extract("i", r"<link>\s*([^<]*)</link>", 1)), F.lit("")), F.nullif(F.regexp_extract("i", r"""<link[^>]*href=["']([^"']*)""", 1), F.lit("")))
    raw = F.trim(F.regexp_extract("i", r"<(?:pubDate|published|updated)>([^<]*)<", 1))
    rfc = F.regexp_extract(raw, r"(\d{1,2} [A-Za-z]{3} \d{4})", 1)
    return rows.select(url.alias("url"), F.coalesce(F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd"), F.try_to_date(F.nullif(rfc, F.lit("")), "d MMM yyyy")).alias("fecha")).where("url is not null")
