"""Named queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import gate_queries, library_queries, listing_queries, parse_queries, retrieval_queries, store_queries, stored_queries, text_queries

_MODULES = (text_queries, retrieval_queries, store_queries, parse_queries, library_queries, listing_queries, stored_queries, gate_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable of (session, table folder)."""
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
