"""The registered queries of the core and their SQL."""

from __future__ import annotations

from . import search_queries, store_queries
from .operators import queries as pipeline
from .search_queries import flagship  # noqa: F401


def queries() -> dict:
    return search_queries.queries() | store_queries.queries() | pipeline.queries()


def oracle_sql() -> dict[str, str]:
    return search_queries.oracle_sql() | store_queries.oracle_sql() | pipeline.oracle_sql()
