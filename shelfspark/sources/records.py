"""Parser records: splitting off malformed ones, quarantine, run export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import or_empty, trim_all
from shelfspark.functions.values import at, kind, parse, to_text


def judged(df: DataFrame, json_col: str) -> DataFrame:
    """Every record with source_url, data (JSON text) and the reason it is refused, if any.

    One pass: both outputs of `split_records` filter this frame.
    """
    doc = df.withColumn("_doc", parse(json_col))
    what = kind(F.col("_doc"))
    data_kind = kind(at(F.col("_doc"), "data"))
    # a literal null counts as present, an absent member does not
    has_data = F.array_contains(F.json_object_keys(json_col), F.lit("data"))
    reason = (
        F.when(F.col("_doc").isNull(), "record is not valid json")
        .when(F.coalesce(what, F.lit("")) != "OBJECT", "record must be an object")
        .when(~has_data, "record.data is required")
        .when(F.coalesce(data_kind, F.lit("")) != "OBJECT", "record.data must be an object")
    )
    return doc.select(
        *df.columns,
        F.when(what == "OBJECT", to_text(at(F.col("_doc"), "sourceUrl"))).alias("source_url"),
        F.when(reason.isNull(), F.to_json(at(F.col("_doc"), "data"))).alias("data"),
        reason.alias("reason"),
    )


def split_records(df: DataFrame, json_col: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): rows with a data object, and the rest with a reason."""
    rows = judged(df, json_col)
    return rows.where(F.col("reason").isNull()).drop("reason"), rows.where(F.col("reason").isNotNull()).drop("data")


def read_rules(rules: DataFrame) -> DataFrame:
    """Mapping rules from (target, JSON text): rules that are no object or say nothing are left out."""
    doc = rules.withColumn("_rule", parse("rule"))
    read = doc.where(kind(F.col("_rule")) == "OBJECT").select(
        trim_all("target").alias("target"),
        to_text(at(F.col("_rule"), "source")).alias("source"),
        to_text(at(F.col("_rule"), "constant")).alias("constant"),
    )
    return read.where((F.col("target") != "") & ((F.col("source") != "") | (F.col("constant") != "")))


def quarantine_rows(invalid: DataFrame, sync_source: str | Column, payload: str) -> DataFrame:
    """Refused rows in the quarantine shape; numbers in the payload in their normal form."""
    source = F.lit(sync_source) if isinstance(sync_source, str) else sync_source
    normal = F.coalesce(F.to_json(parse(payload)), F.to_json(F.struct(F.col(payload).alias("raw"))))
    return invalid.select(
        "run_id", trim_all(or_empty("source_url")).alias("source_url"), source.alias("sync_source"), trim_all("reason").alias("error"), normal.alias("payload")
    )


def write_quarantine(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("sync_source").parquet(path)


def export_run(runs: DataFrame, records: DataFrame, run_id: str, path: str) -> None:
    """Run header and all its records as JSON lines; records stay in as many files as there are tasks."""
    header = runs.where(F.col("run_id") == run_id).select(F.lit("run").alias("kind"), F.to_json(F.struct("*")).alias("body"))
    body = records.where(F.col("run_id") == run_id).select(F.lit("record").alias("kind"), F.to_json(F.struct("*")).alias("body"))
    header.unionByName(body).write.mode("errorifexists").json(path)


def write_run_records(records: DataFrame, path: str, replace: bool = False) -> None:
    """Records by run: appended, or the runs present in the batch rewritten."""
    writer = records.write.partitionBy("run_id")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)
