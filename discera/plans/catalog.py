"""All queries of the library: importing the modules registers them."""

from __future__ import annotations

from discera.plans import catalog_files, catalog_graph, catalog_groups, catalog_rows, catalog_stages, catalog_text  # noqa: F401
from discera.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
