"""Incremental forms of the syncs and counters on Structured Streaming.

Table-maintaining jobs use foreachBatch and write a new snapshot per batch
under its batch id, so a batch that runs twice leaves the same snapshot.
Counts, sums and firsts are written as partial aggregates per batch and
combined when read; run progress is a stateful aggregation in update mode.
Carts are keyed state; repeats inside a watermark can be kept from storage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.functions.text import short_hash
from shelfspark.operators.commerce import CARRIED_OVER, fold_carts
from shelfspark.operators.joins import match_stock, stock_by_barcode
from shelfspark.operators.merge import apply_stock, upsert_source
from shelfspark.streaming.carts import cart_changes

Fold = Callable[[DataFrame, DataFrame], DataFrame]


def read_events(spark: SparkSession, folder: str, table: str, per_trigger: int | None = None) -> DataFrame:
    """Stream over the parquet files of one table."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def snapshot(root: str, batch_id: int) -> str:
    return f"{root}/snapshot-{batch_id}"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fold_stream(stream: DataFrame, root: str, start: DataFrame, fold: Fold, interval: str | None = None) -> StreamingQuery:
    """Keep a table folded over a stream: snapshot n is fold(snapshot n-1, batch n).

    A finished snapshot is never written again, and a half-written one is
    replaced, so recovery after a lost driver or executor is exact. The last
    two are kept. The table before the first batch is `start`.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, snapshot(root, batch_id)):
            return
        before = spark.read.parquet(snapshot(root, batch_id - 1)) if batch_id > 0 else start
        fold(before, batch).write.mode("overwrite").parquet(snapshot(root, batch_id))
        # the one before stays: a repeated batch starts from it
        _delete(spark, snapshot(root, batch_id - 2))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def last_snapshot(spark: SparkSession, root: str, query: StreamingQuery) -> DataFrame:
    """Table after the newest finished batch of a stopped query."""
    batch_id = query.lastProgress["batchId"] if query.lastProgress else 0
    while batch_id > 0 and not _exists(spark, snapshot(root, batch_id)):
        batch_id -= 1
    return spark.read.parquet(snapshot(root, batch_id))


ACTIONS = ("inserted", "updated", "kept")


def _with_ids(table: DataFrame) -> DataFrame:
    """Rows that a batch inserted without an id get one from their identifiers, so that the next batch finds them."""
    named = F.concat_ws("\u001f", F.lit("new"), *(F.coalesce(c, F.lit("")) for c in ("guid_nom", "guid", "nomcode")))
    return table.withColumn("id", F.coalesce("id", short_hash(named).cast(table.schema["id"].dataType)))


def stream_upsert(stream: DataFrame, root: str, target: DataFrame, order: Sequence[str], interval: str | None = None) -> StreamingQuery:
    """Publisher items into the catalog, batch by batch, with a row of counters for each.

    The counters are observed while the snapshot is written and stored under the batch id, so a batch that runs twice counts
    once. A batch that was lost between its snapshot and its counters is folded again, and only counted.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counters, path = f"{root}/counters/batch-{batch_id}", snapshot(root, batch_id)
        if _exists(spark, counters):
            return
        before = _with_ids(spark.read.parquet(snapshot(root, batch_id - 1))) if batch_id > 0 else target
        seen = Observation(f"batch-{batch_id}")
        merged = upsert_source(before, batch, order).observe(seen, *(F.count_if(F.col("_action") == a).alias(a) for a in ACTIONS))
        if _exists(spark, path):
            merged.write.format("noop").mode("overwrite").save()
        else:
            merged.drop("_action").write.mode("overwrite").parquet(path)
        row = [(batch_id, *(seen.get[a] for a in ACTIONS))]
        spark.createDataFrame(row, "batch_id bigint, inserted bigint, updated bigint, kept bigint").coalesce(1).write.mode("overwrite").parquet(counters)
        # the one before stays: a repeated batch starts from it
        _delete(spark, snapshot(root, batch_id - 2))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def upsert_progress(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, inserted, updated, kept) of every finished batch."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/counters")


def stream_stock(feed: DataFrame, root: str, catalog: DataFrame, shop: str, as_of: Column, interval: str | None = "1 hour") -> StreamingQuery:
    """Stock feed into quantities and prices; one batch runs at a time."""

    def fold(before: DataFrame, batch: DataFrame) -> DataFrame:
        return apply_stock(before, match_stock(before, stock_by_barcode(batch, shop)), as_of)

    return fold_stream(feed, root, catalog, fold, interval)


def stream_carts(events: DataFrame, root: str, empty: DataFrame, interval: str | None = None) -> StreamingQuery:
    """Cart events to current carts: what is in a cart enters the next batch as an add before it."""

    def fold(before: DataFrame, batch: DataFrame) -> DataFrame:
        carried = before.select(
            "user_id", "product_id", F.lit("add").alias("action"), "quantity", F.lit(CARRIED_OVER).cast("bigint").alias("seq")
        )
        return fold_carts(carried.unionByName(batch.select(*carried.columns)))

    return fold_stream(events, root, empty, fold, interval)


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_cart_state(events: DataFrame, root: str, idle_ms: int | None = None) -> StreamingQuery:
    """Cart events, in whatever order they come, to changed items per batch; `current_carts` has what they add up to."""
    events.sparkSession.conf.set(STATE_STORE, ROCKS_DB)
    return update_stream(cart_changes(events, idle_ms), root)


def current_carts(spark: SparkSession, root: str) -> DataFrame:
    return latest(spark, root, ["user_id", "product_id"]).where("quantity IS NOT NULL")


def within_watermark(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The stream without repeats of a key that come within `delay` of event time; state is dropped behind the watermark.

    The column that carries the watermark takes the name _ts. Rows later than the watermark are dropped too, so this stands only
    before jobs for which a row that late no longer counts.
    """
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay).dropDuplicatesWithinWatermark(list(keys)).drop("_ts")


def pull_stream(pages: DataFrame, root: str) -> StreamingQuery:
    """Source pages to storage, resumed where the last run stopped: the checkpoint is the cursor.

    Takes what has arrived and ends. A page is one file of the source folder; a batch that runs twice replaces its folder, so
    no page is lost and none is stored twice.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch-{batch_id}")

    return pages.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def update_stream(aggregated: DataFrame, root: str, mode: str = "update") -> StreamingQuery:
    """Changed rows of a stateful query, one folder per batch; a repeated batch replaces its folder."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/out/batch-{batch_id}")

    return (
        aggregated.writeStream.outputMode(mode)
        .foreachBatch(sink)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def latest(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """Newest row per key over all batches of an update stream."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out")
    values = [c for c in rows.columns if c not in keys and c != "batch_id"]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return picked.select(*keys, "v.*")


def partial_stream(stream: DataFrame, root: str, part: Callable[[DataFrame], DataFrame], interval: str | None = None) -> StreamingQuery:
    """Partial aggregates of each batch, one folder per batch; a repeated batch replaces its folder.

    For aggregates whose parts combine (sums, minima, firsts). The stream holds
    no state, so no row is ever too late.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{root}/out/batch-{batch_id}")

    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def partials(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out")


def _first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per key the row that comes first in `order`; a minimum, so each task sends one row per key."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    picked = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("v"))
    return picked.select(*keys, "v.*")


REVIEW = ["user_id", "product_id"]


def stream_ratings(reviews: DataFrame, root: str) -> StreamingQuery:
    """Reviews (user_id, product_id, ts, review_id, rating): the first one of each user and product, per batch."""
    return partial_stream(reviews, root, lambda batch: _first(batch, REVIEW, ["ts", "review_id"]))


def ratings(parts: DataFrame) -> DataFrame:
    """Rating sum and count per product, one review per user."""
    each = _first(parts, REVIEW, ["ts", "review_id"])
    return each.groupBy("product_id").agg(F.sum("rating").alias("rating_sum"), F.count(F.lit(1)).alias("review_count"))


def stream_views(events: DataFrame, root: str, width: str = "1 hour") -> StreamingQuery:
    """Views per post and window of each batch, however late they come."""

    def part(batch: DataFrame) -> DataFrame:
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        counted = timed.groupBy(F.window("ts", width), "post_id").agg(F.count(F.lit(1)).alias("views"))
        return counted.select(F.col("window.start").alias("window_start"), "post_id", "views")

    return partial_stream(events, root, part)


WINDOW_KEYS = ["window_start", "post_id"]


def stream_windows(events: DataFrame, root: str, width: int = 3600, delay: int = 86400) -> StreamingQuery:
    """Views (ts, post_id) per window of `width` seconds: a window comes out once, when event time is `delay` seconds past it.

    Each batch leaves its open windows as a table, which is all that the next one reads; closed windows and the counts of
    rows that came for a window already closed, the corrections, go to tables of their own. Event time after a batch is
    the latest time seen so far, so it, and what is late, depends on the batches before alone, and a repeated batch
    writes the same. The open windows are written last: with them a batch is done.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _exists(spark, f"{root}/open-{batch_id}"):
            return
        seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
        rows = batch.select(seconds.alias("_ts"), (seconds - F.pmod(seconds, F.lit(width))).alias("window_start"), "post_id").where("_ts IS NOT NULL")
        counted = rows.groupBy(*WINDOW_KEYS).agg(F.count(F.lit(1)).alias("views"), F.max("_ts").alias("_ts"))
        counted.write.mode("overwrite").parquet(f"{root}/counted")
        counted = spark.read.schema(counted.schema).parquet(f"{root}/counted")
        past = spark.read.parquet(f"{root}/time-{batch_id - 1}").first().latest if batch_id > 0 else None
        latest = max((x for x in (past, counted.agg(F.max("_ts")).first()[0]) if x is not None), default=None)
        end = F.col("window_start") + width
        late = (end <= F.lit(past).cast("bigint") - delay) if past is not None else F.lit(False)
        on_time = counted.where(~late).select(*WINDOW_KEYS, "views")
        if batch_id > 0:
            on_time = on_time.unionByName(spark.read.parquet(f"{root}/open-{batch_id - 1}"))
        summed = on_time.groupBy(*WINDOW_KEYS).agg(F.sum("views").alias("views"))
        done = (end <= F.lit(latest).cast("bigint") - delay) if latest is not None else F.lit(False)
        counted.where(late).select(*WINDOW_KEYS, "views").write.mode("overwrite").parquet(f"{root}/corrections/batch-{batch_id}")
        summed.where(done).write.mode("overwrite").parquet(f"{root}/closed/batch-{batch_id}")
        spark.createDataFrame([(latest,)], "latest bigint").coalesce(1).write.mode("overwrite").parquet(f"{root}/time-{batch_id}")
        summed.where(~done).write.mode("overwrite").parquet(f"{root}/open-{batch_id}")
        # the one before stays: a repeated batch starts from it
        for name in ("open", "time"):
            _delete(spark, f"{root}/{name}-{batch_id - 2}")

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def windows(spark: SparkSession, root: str, query: StreamingQuery) -> DataFrame:
    """(window_start, post_id, views, state) of a stopped query; state is closed, correction or open."""
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    while last > 0 and not _exists(spark, f"{root}/open-{last}"):
        last -= 1
    folders = {"closed": f"{root}/closed", "correction": f"{root}/corrections", "open": f"{root}/open-{last}"}
    parts = [spark.read.option("recursiveFileLookup", True).parquet(path).select(*WINDOW_KEYS, "views", F.lit(name).alias("state")) for name, path in folders.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def view_counts(parts: DataFrame, keys: Sequence[str] = ("window_start", "post_id")) -> DataFrame:
    """Views per window and post, or per post alone."""
    return parts.groupBy(*keys).agg(F.sum("views").alias("views"))


def stream_progress(events: DataFrame) -> DataFrame:
    """discovered (largest seen), parsed and retries (sums) and the newest status per run."""
    return events.groupBy("run_id").agg(
        F.max("discovered").alias("discovered"),
        F.sum("parsed").alias("parsed"),
        F.sum("retries").alias("retries"),
        F.max_by("status", "seq").alias("status"),
    )


FIRST_RECORD = ["run_id", "source_url"]


def stream_first_record(records: DataFrame, root: str) -> StreamingQuery:
    """First record per run and URL of each batch, by time, then id."""
    return partial_stream(records, root, lambda batch: _first(batch, FIRST_RECORD, ["created_at", "record_id"]))


def first_records(parts: DataFrame) -> DataFrame:
    return _first(parts, FIRST_RECORD, ["created_at", "record_id"])
