"""Named queries with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.operators.skew import spread_out
from shelfspark.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


# What tells the rows of a table apart.
ROW_KEYS = {"part": ["p_partkey"], "events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]}


class Tables:
    """Parquet tables of one folder, opened on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str) -> DataFrame:
        """The table for work that is costly per row: over all cores, however few row groups it is stored in."""
        return spread_out(getattr(self, name), *ROW_KEYS[name])


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a query; `sql` is its oracle, left out where SQL cannot say it."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(tune(spark), folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return wrap
