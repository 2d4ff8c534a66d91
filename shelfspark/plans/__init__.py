"""Registered queries over the given tables."""

from shelfspark.plans import (
    catalog_queries,
    join_queries,
    merge_queries,
    page_queries,
    scalar_queries,
    source_queries,
    stream_queries,
)  # noqa: F401
from shelfspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
