"""Acquisition of posts as a Python data source: the interface to a platform, paged by a cursor."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Platform(Protocol):
    """search returns (posts, next cursor or None)."""

    def search(self, query: str, cursor: str | None) -> tuple[list[dict], str | None]: ...


class MemoryPlatform:
    """Pages of posts that are given; for tests and dry runs."""

    def __init__(self, posts: list[dict], page: int = 2):
        self.posts, self.page = posts, page

    def search(self, query: str, cursor: str | None) -> tuple[list[dict], str | None]:
        at = int(cursor or 0)
        found = [p for p in self.posts if query.lower() in p.get("texto", "").lower()]
        return found[at : at + self.page], str(at + self.page) if at + self.page < len(found) else None


def pages(platform: Platform, query: str, most: int | None = None) -> Iterator[dict]:
    """All posts of a query, page by page, up to most."""
    cursor, n = None, 0
    while True:
        found, cursor = platform.search(query, cursor)
        for post in found:
            if most is not None and n >= most:
                return
            n += 1
            yield post
        if cursor is None:
            return


FIELDS = ("id", "texto", "autor_handle", "fecha")


class PostSource(DataSource):
    """format("discera_posts"): options query (parted by | into partitions) and max_items; the platform is set by PostSource.platform."""

    platform: Platform = MemoryPlatform([])

    @classmethod
    def name(cls) -> str:
        return "discera_posts"

    def schema(self) -> str:
        return ", ".join(f"{f} string" for f in FIELDS)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, type(self).platform)


class _Reader(DataSourceReader):
    def __init__(self, options, platform: Platform):
        self.queries = str(options.get("query", "")).split("|")
        self.most = int(options["max_items"]) if "max_items" in options else None
        self.platform = platform

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for post in pages(self.platform, partition.value, self.most):
            yield tuple(post.get(f) for f in FIELDS)
