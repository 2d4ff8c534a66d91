"""Carts as keyed state, counters of repeated batches."""

import random

from shelfspark.session import fresh_path
from shelfspark.streaming import jobs as X
from shelfspark.streaming.carts import Item
from tests.test_scale import CART, cart_log, simulate_carts


def test_an_item_takes_its_events_in_any_order():
    r = random.Random(4)
    for _ in range(300):
        events = [(1, 1, r.choice(["add", "add", "set", "remove"]), r.randrange(1, 5), s) for s in range(r.randrange(1, 9))]
        cleared = r.choice([-1, -1, r.randrange(9)])
        whole = sorted([*events, (1, 1, "clear", 0, cleared)] if cleared >= 0 else events, key=lambda e: (e[4], e[2] != "clear"))
        # a clearing stands right before the event of its number
        whole = [e for e in whole if e[2] == "clear" or e[4] != cleared]
        item = Item()
        shuffled = r.sample(events, len(events)) + r.sample(events, r.randrange(len(events)))
        for _, _, action, quantity, seq in shuffled:
            if seq != cleared:
                item = Item.unpacked(item.packed())
                item.take(action, seq, quantity)
        assert item.quantity(cleared) == simulate_carts(whole).get((1, 1)), (events, cleared)


def test_cart_state_in_any_order_and_after_a_restart(spark):
    events = [(u, p, a, max(q, 1), s) for u, p, a, q, s in cart_log(120)]
    random.Random(5).shuffle(events)
    source, root = fresh_path(spark, "cart-events"), fresh_path(spark, "cart-state")
    for start in (0, 40, 80):
        spark.createDataFrame(events[start : start + 40], CART).coalesce(1).write.mode("append").parquet(source)
        X.stream_cart_state(spark.readStream.schema(CART).parquet(source), root).awaitTermination()
    got = {(r.user_id, r.product_id): r.quantity for r in X.current_carts(spark, root).collect()}
    assert got == simulate_carts(sorted(events, key=lambda e: e[4]))


def test_a_batch_that_lost_its_counters_is_counted_once(spark):
    schema = "seq int, guid_nom string, guid string, nomcode string, name string, updated_at long"
    target = spark.createDataFrame([("1", "g1", "", "", "a", 1), ("2", "g2", "", "", "b", 1)], "id string, guid_nom string, guid string, nomcode string, name string, updated_at long")
    source, root = fresh_path(spark, "items"), fresh_path(spark, "upsert")

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        X.stream_upsert(spark.readStream.schema(schema).parquet(source), root, target, ["seq"]).awaitTermination()
        return sorted(map(tuple, X.upsert_progress(spark, root).collect()))

    assert run([(1, "g1", "", "", "new", 2), (2, "g3", "", "", "more", 2)]) == [(0, 1, 1, 1)]
    assert run([(1, "g3", "", "", "again", 3)]) == [(0, 1, 1, 1), (1, 0, 1, 2)]
    # the last batch is run again without its counters and its commit
    X._delete(spark, f"{root}/counters/batch-1")
    X._delete(spark, f"{root}/checkpoint/commits/1")
    assert run([]) == [(0, 1, 1, 1), (1, 0, 1, 2)]
    assert spark.read.parquet(X.snapshot(root, 1)).count() == 3


def test_windows_close_once_and_late_rows_correct_them(spark):
    r = random.Random(8)
    schema = "ts timestamp, post_id long"
    source, root = fresh_path(spark, "views"), fresh_path(spark, "windows")
    whole, seen = {}, []
    for batch in range(4):
        rows = [(batch * 10_000 + r.randrange(-8_000, 10_000), r.randrange(3)) for _ in range(150)]
        for ts, post in rows:
            key = (ts // 600 * 600 + 1_000_200, post)
            whole[key] = whole.get(key, 0) + 1
        made = spark.createDataFrame([(1_000_200 + ts, post) for ts, post in rows], "s long, post_id long")
        made.selectExpr("timestamp_seconds(s) AS ts", "post_id").coalesce(1).write.mode("append").parquet(source)
        run = X.stream_windows(spark.readStream.schema(schema).parquet(source), root, 600, 3_000)
        run.awaitTermination()
        seen.append(spark.read.option("recursiveFileLookup", True).parquet(f"{root}/open-{batch}").count())
    rows = X.windows(spark, root, run).collect()
    total = {}
    for x in rows:
        total[x.window_start, x.post_id] = total.get((x.window_start, x.post_id), 0) + x.views
    assert total == whole
    closed = [(x.window_start, x.post_id) for x in rows if x.state == "closed"]
    assert len(closed) == len(set(closed)) > 50 and any(x.state == "correction" for x in rows)
    # open windows reach back by the delay alone, so their number doesn't grow with the stream
    assert max(seen) <= 3 * (3_000 + 600) // 600 + 3
