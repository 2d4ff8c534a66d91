"""Progress of keyed pulls: a small control table next to the stream checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def advance(cursors: DataFrame, progress: DataFrame) -> DataFrame:
    """Cursor rows (key, next_url, completed, updated_at) after the newest progress per key.

    A page with no next URL completes its key.
    """
    last = progress.groupBy("key").agg(F.max_by("next_url", "seq").alias("_next"), F.max("seq").alias("_seq"))
    joined = cursors.join(last, "key", "full_outer")
    moved = F.col("_seq").isNotNull()
    done = F.coalesce("_next", F.lit("")) == ""
    return joined.select(
        "key",
        F.when(moved, F.coalesce("_next", F.lit(""))).otherwise(F.col("next_url")).alias("next_url"),
        F.when(moved, done).otherwise(F.col("completed")).alias("completed"),
        F.when(moved, F.col("_seq")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def pending(cursors: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys still to pull, with where to go on: completed keys are skipped."""
    known = cursors.select("key", "next_url", "completed")
    return keys.join(known, "key", "left").where(~F.coalesce("completed", F.lit(False))).select("key", F.coalesce("next_url", F.lit("")).alias("next_url"))


def reset(cursors: DataFrame, hit: Column) -> DataFrame:
    """Chosen keys start over."""
    return cursors.withColumns(
        {
            "next_url": F.when(hit, F.lit("")).otherwise(F.col("next_url")),
            "completed": F.when(hit, F.lit(False)).otherwise(F.col("completed")),
        }
    )
