"""Records of quoted text files that Spark splits inside a file, though cells hold line breaks.

Files are read by lines, so a large one is many tasks. Whether a line ends a record depends on all quotes before it. Each
block of a file (what one task reads) is summed up as a map of states: for either state at its start, outside or inside
quotes, how many records end in it and the state at its end. Composed along the file, these give every block its state and
record number, and so every line its record; only records of several lines are then gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, line, odd): the lines of text files in the order of (block, n); odd says that quotes don't pair up."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")
    )
    return placed.withColumn("odd", (quotes % 2).cast("int"))


def block_states(lines: DataFrame) -> DataFrame:
    """(file, block, inside, before): the state in which each block starts, and the records that end before it.

    lines: with `turned`, the state after each line if its block starts outside quotes.
    """
    maps = lines.groupBy("file", "block").agg(
        (F.sum("odd") % 2).alias("turns"), F.count_if(F.col("turned") == 0).alias("ends_outside"), F.count_if(F.col("turned") == 1).alias("ends_inside")
    )
    # one row per block of a file: few rows however long the file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    started = maps.withColumn("inside", F.coalesce(F.sum("turns").over(earlier) % 2, F.lit(0)))
    ends = F.when(F.col("inside") == 0, F.col("ends_outside")).otherwise(F.col("ends_inside"))
    return started.select("file", "block", "inside", F.coalesce(F.sum(ends).over(earlier), F.lit(0)).alias("before"))


def read_quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of quoted files, numbered from 0 in each file; blank ones are left out.

    A line break inside quotes stays in the text. Files end their last record wherever they end.
    """
    within = Window.partitionBy("file", "block").orderBy("n")
    lines = quoted_lines(spark, path).withColumn("turned", F.sum("odd").over(within) % 2)
    ended = within.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns(
        {
            "_outside": F.coalesce(F.sum((F.col("turned") == 0).cast("bigint")).over(ended), F.lit(0)),
            "_inside": F.coalesce(F.sum((F.col("turned") == 1).cast("bigint")).over(ended), F.lit(0)),
        }
    )
    states = block_states(lines)
    placed = lines.join(states, ["file", "block"])
    after = (F.col("turned") + F.col("inside")) % 2
    first = (F.col("turned") + F.col("odd") + F.col("inside")) % 2 == 0
    record = F.col("before") + F.when(F.col("inside") == 0, F.col("_outside")).otherwise(F.col("_inside"))
    placed = placed.select("file", record.alias("record"), "block", "n", "line", (first & (after == 0)).alias("whole"))
    several = placed.where(~F.col("whole")).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("lines"))
    texts = placed.where("whole").select("file", "record", F.col("line").alias("text")).union(several.select("file", "record", F.array_join("lines.line", "\n")))
    return texts.withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
