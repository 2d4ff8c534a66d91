"""Helpers shared by the operators: session settings, written tables, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.session import tune
from shelfspark.session import written as stored

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Batches for Python are bounded by bytes, so a worker holds few long texts at once, and narrow rows go many at a time.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "16384",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # shuffle files go when their query ends, not when the driver happens to collect garbage
    "spark.sql.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the operators; partition counts stay the cluster's."""
    tune(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Delete the folder of a written table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered_totals(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `amount` over all rows that precede in `order` (exclusive), at any size.

    A window over one global order would take all rows to one task. Here rows are dealt by ranges of the order, summed
    inside each range, and the ranges' own totals (one row per partition) are summed before they are added.
    `order` must tell all rows apart that differ in what is returned.
    """
    ranged = df.withColumn("_amount", amount).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy("_part")
        .agg(F.sum("_amount").alias("_sum"))
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    )
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
        .join(parts, "_part")
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_amount", "_part", "_inside", "_before")
    )
