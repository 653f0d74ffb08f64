"""Registered queries of the analytics engine over the star-schema tables, and their DuckDB equivalents."""

from __future__ import annotations

from .registered import learning, rows, stats, streams  # noqa: F401  they register their queries
from .registered.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
