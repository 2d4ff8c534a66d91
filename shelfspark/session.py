"""Session settings, shared folders and lineage cutting used by every job."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even when the next step groups by the same key
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # whole pages go to Python in batches of bounded size
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the plans rely on; partition counts stay the cluster's."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def packed_package() -> bytes:
    """This package's sources as a zip file."""
    root = Path(__file__).resolve().parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, str(path.relative_to(root.parent)))
    return buffer.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application; local workers find it where the driver does.

    The zip is handed to the driver's own file server, which executors fetch it from.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="package-")
    path = os.path.join(folder, f"{__package__}.zip")
    with open(path, "wb") as f:
        f.write(packed_package())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def local_session(cores: str = "8", app: str = "shelfspark") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        # else every Column call also sends its place in the Python source to the JVM, and large expressions take seconds more
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHELFSPARK_DRIVER_MEMORY", "8g"))
    )
    spark = tune(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in spark.checkpoint.dir, or has set a checkpoint
    folder on the context. Only a local master, whose one process holds all
    executors, gets a fresh temporary folder, once per application.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """Unused path under the application's part of the shared folder, for a written table or a stream."""
    return f"{_written_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _written_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def clear_written(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; for the end of a job, when no result is read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_written_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows as a table in the shared folder: computed once, of known size, and safe when executors are lost. options: of the Parquet writer."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result outlives the executors that made it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
