"""All registered queries of the event engine: name -> callable, and name -> DuckDB SQL."""

from __future__ import annotations

from .plans import feed_queries, ingest_queries, item_queries, record_queries, source_queries, story_queries  # noqa: F401  (they register their queries)
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
