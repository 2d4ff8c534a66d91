"""Carts, orders, library, views and ranked picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from shelfspark.operators.skew import first_by


# Event numbers start at 0; carts carried over from earlier batches count as adds just before.
CARRIED_OVER = -1
BEFORE_ALL = -2


def fold_carts(events: DataFrame) -> DataFrame:
    """Cart events (user_id, product_id, action, quantity, seq) to the carts they leave.

    add raises an item, set replaces the quantity of an item that is there,
    remove drops it, clear empties the cart. No history is gathered per user:
    the last removal and clearing, the first add after them and the last
    effective set are aggregates, so each step reduces on the map side, and
    the joins back are plain equi-joins the adaptive skew join can split.
    """
    clears = events.where("action = 'clear'").groupBy("user_id").agg(F.max("seq").alias("_clear"))
    items = events.where("action IN ('add', 'set', 'remove')")
    removes = items.groupBy("user_id", "product_id").agg(F.max(F.when(F.col("action") == "remove", F.col("seq"))).alias("_remove"))
    start = removes.join(clears, "user_id", "left").select(
        "user_id", "product_id", F.coalesce(F.greatest("_remove", "_clear"), F.lit(BEFORE_ALL)).cast("bigint").alias("_start")
    )
    live = items.where("action <> 'remove'").join(start, ["user_id", "product_id"]).where(F.col("seq") > F.col("_start"))
    entered = live.where("action = 'add'").groupBy("user_id", "product_id").agg(F.min("seq").alias("_entry"))
    settled = live.join(entered, ["user_id", "product_id"]).where(F.col("seq") >= F.col("_entry"))
    last_set = settled.groupBy("user_id", "product_id").agg(
        F.max(F.when(F.col("action") == "set", F.struct("seq", "quantity"))).alias("_set"),
    )
    added = F.when((F.col("action") == "add") & (F.col("seq") > F.coalesce(F.col("_set.seq"), F.lit(BEFORE_ALL))), F.greatest("quantity", F.lit(1)))
    return (
        settled.join(last_set, ["user_id", "product_id"])
        .groupBy("user_id", "product_id")
        .agg((F.coalesce(F.max("_set.quantity"), F.lit(0)) + F.coalesce(F.sum(added), F.lit(0))).alias("quantity"))
    )


def library_from_orders(orders: DataFrame, owned: DataFrame) -> DataFrame:
    """(user_id, product_id) pairs to add: bought and not yet owned."""
    bought = orders.select("user_id", "product_id").distinct()
    return bought.join(owned, ["user_id", "product_id"], "left_anti")


def user_history(orders: DataFrame, page: int = 1, limit: int = 20) -> DataFrame:
    """One page of every user's orders, newest first, with the user's total.

    The rank limit is pushed below the shuffle, so a user with very many
    orders sends only page * limit rows per task.
    """
    size = 20 if limit < 1 else limit
    upto, skip = max(page, 1) * size, (max(page, 1) - 1) * size
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("order_id"))
    ranked = orders.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= upto)
    totals = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return ranked.where(F.col("position") > skip).join(totals, "user_id")


def top_k(df: DataFrame, metric: str, k: int, id_col: str = "id", flag: str | None = None, drop: Sequence[str] = ()) -> DataFrame:
    shown = df.where(F.coalesce(F.col(flag), F.lit(False))) if flag else df
    return shown.drop(*drop).orderBy(F.desc(metric), F.asc(id_col)).limit(k)


def first_record_per_url(records: DataFrame, limit: int | None = None) -> DataFrame:
    """First record per run and URL; with a limit the earliest ones are kept."""
    first = first_by(records, ["run_id", "source_url"], [F.asc("created_at"), F.asc("record_id")])
    return first if limit is None else first.orderBy("created_at", "record_id").limit(limit)


def merge_candidates(confirmed: DataFrame, likely: DataFrame, n: int) -> DataFrame:
    """Confirmed product URLs by score, then likely ones by their best score, up to n, none twice."""
    tiers = confirmed.select("url", "score", F.lit(0).alias("tier")).unionByName(likely.select("url", "score", F.lit(1).alias("tier")))
    best = tiers.groupBy("url").agg(F.min(F.struct("tier", (-F.col("score")).alias("rank"))).alias("best"))
    ranked = best.select("url", F.col("best.tier").alias("tier"), (-F.col("best.rank")).alias("score"))
    return ranked.orderBy("tier", F.desc("score"), "url").limit(n)
