"""Joins and picks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A key from this many rows on is cut into slices of about that size.
HEAVY_ROWS = 5_000_000
# Rows without a key match nothing; they are spread over this many slices.
NULL_SLICES = 512
# Tasks per core that dealt-out rows make, and the rows of one where that would be more.
TASKS_PER_CORE = 4
TASK_ROWS = 200_000
# Fewer rows than this are not worth a task of their own.
LEAST_ROWS = 256


def spread_out(df: DataFrame, *keys: str) -> DataFrame:
    """A stored table's rows dealt out by unique keys, where one task would read more than a core's share of them.

    A file's row group is read by one task, whatever its bytes are cut into, so a compact file ends up in one task while
    the work per row may take a millisecond. The rows per task are counted first, which reads no column; a table that is
    stored in enough parts stays where it is. For costly work on narrow rows; columns nobody reads don't move.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    held = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    parts = max(min(TASKS_PER_CORE * cores, held["rows"] // LEAST_ROWS), held["rows"] // TASK_ROWS)
    if parts <= 1 or held["largest"] * cores <= held["rows"]:
        return df
    return df.repartition(parts, *keys)


def spread_join(
    facts: DataFrame,
    keyed: DataFrame,
    on: str,
    spread_by: Sequence[str],
    how: str = "inner",
    weight: str | None = None,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Join many fact rows to one row per key without piling a heavy key on one task.

    Keys with at least `heavy_rows` fact rows are cut into slices: a fact row
    picks its slice from a hash of `spread_by`, the keyed row is repeated once
    per slice. The list of heavy keys has one row per `heavy_rows` fact rows at
    most; the planner broadcasts it where its size allows and joins it like any
    table else. Rows with a null key match nothing and are spread. `weight` names a column of
    `keyed` that already holds the row counts and saves the counting pass.
    """
    if weight is None:
        counts = facts.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("_rows"))
    else:
        counts = keyed.select(on, F.col(weight).alias("_rows"))
    heavy = counts.where(F.col("_rows") >= heavy_rows).select(on, (F.ceil(F.col("_rows") / heavy_rows) + 1).cast("int").alias("_slices"))
    pick = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in spread_by]), F.coalesce("_slices", F.lit(1)))
    null_pick = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in spread_by]), F.lit(NULL_SLICES))
    sliced = facts.join(heavy, on, "left").withColumn(
        "_slice", F.when(F.col(on).isNull(), null_pick).otherwise(pick).cast("int")
    )
    repeated = keyed.join(heavy, on, "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    )
    return sliced.drop("_slices").join(repeated.drop("_slices"), [on, "_slice"], how).drop("_slice")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. The rank limit is applied inside each map task before the shuffle."""
    from pyspark.sql import Window

    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")
