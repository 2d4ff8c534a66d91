"""Streaming jobs run to the end of their input, read back and compared with the batch statement."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.plans.join_queries import FOLDED_CARTS, MATCHES, STOCK_BEST
from shelfspark.plans.merge_queries import ORDER, UPSERTED, incoming_columns
from shelfspark.plans.registry import Tables, query
from shelfspark.plans.shapes import Spark, main_catalog, record_columns, source_catalog, stock_columns, with_shapes
from shelfspark.session import fresh_path
from shelfspark.streaming import jobs as X


def listed(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in columns.items()]


@query("x1_stream_upsert", with_shapes(UPSERTED + " SELECT id, guid_nom, guid, nomcode, isbn, name, annotation, in_main, updated_at FROM merged", "source_catalog"))
def x1(t: Tables):
    items = X.read_events(t.spark, t.folder, "lineitem").selectExpr(*listed(incoming_columns(Spark)), *ORDER)
    target = source_catalog(t).select("id", "guid_nom", "guid", "nomcode", "isbn", "name", "annotation", "in_main", "updated_at")
    root = fresh_path(t.spark, "upsert")
    run = X.stream_upsert(items, root, target, ORDER)
    run.awaitTermination()
    return X.last_snapshot(t.spark, root, run)


@query(
    "x1_stream_upsert_counters",
    with_shapes(
        UPSERTED + " SELECT 0::BIGINT AS batch_id, count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'kept') AS kept FROM merged",
        "source_catalog",
    ),
)
def x1_counters(t: Tables):
    """Counters of the feed's batch; a second start finds nothing new and counts nothing."""
    items = X.read_events(t.spark, t.folder, "lineitem").selectExpr(*listed(incoming_columns(Spark)), *ORDER)
    target = source_catalog(t).select("id", "guid_nom", "guid", "nomcode", "isbn", "name", "annotation", "in_main", "updated_at")
    root = fresh_path(t.spark, "upsert")
    for _ in range(2):
        X.stream_upsert(items, root, target, ORDER).awaitTermination()
    return X.upsert_progress(t.spark, root)


@query(
    "x2_stream_stock_sync",
    with_shapes(
        f", {STOCK_BEST}, {MATCHES}, u AS (SELECT * FROM matches WHERE abs(old_q - quantity) >= 1e-6 OR abs(old_p - price) >= 1e-6)"
        " SELECT m.id, coalesce(u.quantity, m.quantity) AS quantity, coalesce(u.price, m.price) AS price FROM main_catalog m LEFT JOIN u ON m.id = u.id",
        "main_catalog",
        "stock_feed",
    ),
)
def x2(t: Tables):
    feed = X.read_events(t.spark, t.folder, "lineitem").selectExpr(*listed(stock_columns(Spark)))
    catalog = main_catalog(t).select("id", "isbn", "isbn_normalized", "quantity", "price", "updated_at")
    root = fresh_path(t.spark, "stock")
    run = X.stream_stock(feed, root, catalog, "Main Store", F.lit(1900000000).cast("bigint"), interval=None)
    run.awaitTermination()
    return X.last_snapshot(t.spark, root, run).select("id", "quantity", "price")


CART_EVENT = [
    "user_id",
    "user_id * 3 + CAST(floor(value) AS BIGINT) % 3 AS product_id",
    "CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'add' WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'remove'"
    " ELSE CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 'clear' ELSE 'set' END END AS action",
    "CAST(floor(value) AS BIGINT) % 7 + 1 AS quantity",
    "event_id AS seq",
]


@query("x3_stream_cart_state", FOLDED_CARTS)
def x3(t: Tables):
    events = X.read_events(t.spark, t.folder, "events").selectExpr(*CART_EVENT)
    empty = t.spark.createDataFrame([], "user_id bigint, product_id bigint, quantity bigint")
    root = fresh_path(t.spark, "carts")
    run = X.stream_carts(events, root, empty)
    run.awaitTermination()
    return X.last_snapshot(t.spark, root, run)


@query("x3_stream_carts_any_order", FOLDED_CARTS)
def x3_any_order(t: Tables):
    """Four files in no order of time, a stop in the middle, and keyed state that doesn't need an order."""
    path, root = fresh_path(t.spark, "events"), fresh_path(t.spark, "carts")
    for part in range(2):
        half = t.events.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part)
        half.repartition(2, F.xxhash64(F.col("event_id"), F.lit(7))).write.mode("append").parquet(path)
        stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        X.stream_cart_state(stream.selectExpr(*CART_EVENT), root).awaitTermination()
    return X.current_carts(t.spark, root)


@query("s9_resumed_pull", "SELECT event_id, user_id, event_type FROM events")
def s9_resumed(t: Tables):
    """Pages arrive while pulls stop and start again; every row is stored once."""
    path, root = fresh_path(t.spark, "pages"), fresh_path(t.spark, "pulled")
    for part in range(3):
        t.events.where(F.col("event_id") % 3 == part).repartition(2, "event_id").write.mode("append").parquet(path)
        pages = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)
        for _ in range(2):  # a run without anything new stores nothing
            X.pull_stream(pages, root).awaitTermination()
    return X.partials(t.spark, root).select("event_id", "user_id", "event_type")


def shuffled_events(t: Tables):
    """The events as a stream of four files in no order of time, one file per batch."""
    path = fresh_path(t.spark, "events")
    t.events.repartition(4, F.xxhash64("event_id")).write.parquet(path)
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "x4_stream_ratings",
    "SELECT product_id, CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) AS review_count FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts, review_id) AS r"
    " FROM (SELECT user_id, event_id % 5 AS product_id, ts, event_id AS review_id, 1 + CAST(floor(value) AS BIGINT) % 5 AS rating FROM events)) WHERE r = 1 GROUP BY product_id",
)
def x4(t: Tables):
    """Many reviews of the same user and product; the first one counts, in whichever batch it comes."""
    reviews = shuffled_events(t).selectExpr("user_id", "event_id % 5 AS product_id", "ts", "event_id AS review_id", "1 + CAST(floor(value) AS BIGINT) % 5 AS rating")
    root = fresh_path(t.spark, "ratings")
    X.stream_ratings(reviews, root).awaitTermination()
    return X.ratings(X.partials(t.spark, root))


@query(
    "x4_stream_repeats_within_watermark",
    "SELECT CAST(count(*) AS BIGINT) AS stored, CAST(count(DISTINCT review_id) AS BIGINT) AS reviews FROM (SELECT DISTINCT event_id AS review_id FROM events)",
)
def x4_repeats(t: Tables):
    """Every file comes twice; inside the watermark the second copy never reaches storage."""
    path, root = fresh_path(t.spark, "events"), fresh_path(t.spark, "ratings")
    for _ in range(2):
        t.events.repartition(2, F.xxhash64("event_id")).write.mode("append").parquet(path)
    reviews = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(path).selectExpr("user_id", "event_id AS review_id", "ts")
    once = X.within_watermark(reviews, ["review_id"], "ts", "36500 days")
    X.pull_stream(once, root).awaitTermination()
    return X.partials(t.spark, root).agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("review_id").alias("reviews"))


def view_parts(t: Tables):
    views = shuffled_events(t).where("event_type = 'view'").selectExpr("ts", "user_id AS post_id")
    root = fresh_path(t.spark, "views")
    X.stream_views(views, root).awaitTermination()
    return X.partials(t.spark, root)


@query(
    "x5_stream_view_counts",
    "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS window_start, user_id AS post_id, CAST(count(*) AS BIGINT) AS views FROM events WHERE event_type = 'view' GROUP BY ALL",
)
def x5(t: Tables):
    return X.view_counts(view_parts(t)).withColumn("window_start", F.unix_timestamp("window_start"))


@query(
    "x5_stream_closed_windows",
    "SELECT epoch_us(date_trunc('hour', ts)) // 1000000 AS window_start, user_id AS post_id, CAST(count(*) AS BIGINT) AS views, true AS closed_once FROM events WHERE event_type = 'view' GROUP BY ALL",
)
def x5_closed(t: Tables):
    """Files in no order of time: windows that close once, corrections and open windows together have every view."""
    views = shuffled_events(t).where("event_type = 'view'").selectExpr("ts", "user_id AS post_id")
    root = fresh_path(t.spark, "windows")
    run = X.stream_windows(views, root)
    run.awaitTermination()
    found = X.windows(t.spark, root, run).groupBy("window_start", "post_id")
    return found.agg(F.sum("views").alias("views"), (F.count_if(F.col("state") == "closed") <= 1).alias("closed_once"))


@query("x5_stream_view_totals", "SELECT user_id AS post_id, CAST(count(*) AS BIGINT) AS views FROM events WHERE event_type = 'view' GROUP BY user_id")
def x5_totals(t: Tables):
    return X.view_counts(view_parts(t), ["post_id"])


@query(
    "x6_stream_run_progress",
    "SELECT concat('run-', substr(CAST(ts AS STRING), 1, 10)) AS run_id, max(event_id) AS discovered, CAST(sum(CAST(floor(value) AS BIGINT) % 3) AS BIGINT) AS parsed,"
    " count(*) FILTER (event_type = 'error') AS retries, arg_max(event_type, event_id) AS status FROM events GROUP BY 1",
)
def x6(t: Tables):
    events = X.read_events(t.spark, t.folder, "events").selectExpr(
        "concat('run-', substr(CAST(ts AS STRING), 1, 10)) AS run_id",
        "event_id AS discovered",
        "CAST(floor(value) AS BIGINT) % 3 AS parsed",
        "CASE event_type WHEN 'error' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS retries",
        "event_type AS status",
        "event_id AS seq",
    )
    root = fresh_path(t.spark, "progress")
    X.update_stream(X.stream_progress(events), root).awaitTermination()
    return X.latest(t.spark, root, ["run_id"])


@query(
    "x7_stream_first_record",
    with_shapes(
        "SELECT record_id, run_id, source_url FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source_url ORDER BY created_at, record_id) AS r FROM records) WHERE r = 1", "records"
    ),
)
def x7(t: Tables):
    stream = shuffled_events(t).selectExpr(*listed(record_columns()))
    root = fresh_path(t.spark, "first")
    X.stream_first_record(stream, root).awaitTermination()
    return X.first_records(X.partials(t.spark, root)).select("record_id", "run_id", "source_url")
