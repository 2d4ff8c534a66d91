"""Splitting of heavy keys, cycles, carts and streams on small inputs."""

import os
import random

from pyspark.sql import functions as F

from shelfspark.functions.values import flatten, parse
from shelfspark.operators import commerce as K, duplicates as D, hierarchy as H, joins as J
from shelfspark.operators.pages import extract_products
from shelfspark.operators.skew import spread_join
from shelfspark.session import fresh_path
from shelfspark.streaming import jobs as X


def test_heavy_keys_split_without_changing_the_join(spark):
    facts = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"))
    keyed = facts.where("key IS NOT NULL").select("key").distinct().withColumn("v", F.length("key"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = facts.join(keyed, "key", how)
        spread = spread_join(facts, keyed, "key", ["id"], how, heavy_rows=20)
        assert sorted(map(repr, spread.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_more_heavy_keys_than_any_list_would_hold(spark):
    facts = spark.range(6000).select("id", (F.col("id") % 1500).alias("key"))
    keyed = spark.range(1500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    got = spread_join(facts, keyed, "key", ["id"], heavy_rows=2)
    assert got.count() == 6000 and got.where("v <> key * 2").isEmpty()


def test_duplicates_are_symmetric_when_one_code_is_heavy(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 70, "978-1").otherwise(F.concat(F.lit("z"), "id")).alias("isbn"), F.lit(None).cast("string").alias("nomcode"))
    ids = {r.id for r in D.duplicate_ids(df, ["isbn", "nomcode"], heavy_rows=10).collect()}
    assert ids == set(range(70))


def test_owner_cycles_end(spark):
    niches = spark.createDataFrame([("a", "A", "b"), ("b", "B", "a"), ("c", "C", "b"), ("d", "D", "zz"), ("e", "E", "d")], "guid string, name string, owner_guid string")
    assert {r.guid for r in H.niche_descendants(niches, "a").collect()} == {"a", "b", "c"}
    subjects = spark.createDataFrame([("s", "S", "e")], "guid string, name string, owner_guid string")
    assert {r.guid for r in H.niche_tree(niches, subjects).collect()} == {"d", "e", "s"}


def simulate_carts(events):
    carts = {}
    for user, product, action, quantity, _ in events:
        if action == "clear":
            for key in [k for k in carts if k[0] == user]:
                del carts[key]
        elif action == "remove":
            carts.pop((user, product), None)
        elif action == "set":
            if (user, product) in carts:
                carts[(user, product)] = quantity
        else:
            carts[(user, product)] = carts.get((user, product), 0) + max(quantity, 1)
    return carts


def cart_log(n):
    rng = random.Random(3)
    return [(rng.randrange(4), rng.randrange(3), rng.choices(["add", "set", "remove", "clear"], [6, 3, 1, 1])[0], rng.randrange(0 if i % 9 == 0 else 1, 5), i) for i in range(n)]


CART = "user_id long, product_id long, action string, quantity long, seq long"


def test_carts_match_a_simulation(spark):
    events = [(u, p, a, max(q, 1) if a == "set" else q, s) for u, p, a, q, s in cart_log(200)]
    got = {(r.user_id, r.product_id): r.quantity for r in K.fold_carts(spark.createDataFrame(events, CART)).collect()}
    assert got == simulate_carts(events)


def test_cart_stream_carries_over_batches_and_resumes(spark):
    events = [(u, p, a, max(q, 1), s) for u, p, a, q, s in cart_log(90)]
    source, root = fresh_path(spark, "cart-events"), fresh_path(spark, "cart-state")
    empty = spark.createDataFrame([], "user_id bigint, product_id bigint, quantity bigint")
    for start in (0, 30, 60):
        spark.createDataFrame(events[start:start + 30], CART).coalesce(1).write.mode("append").parquet(source)
        run = X.stream_carts(spark.readStream.schema(CART).parquet(source), root, empty)
        run.awaitTermination()
    assert sorted(p for p in os.listdir(root) if p.startswith("snapshot")) == ["snapshot-1", "snapshot-2"]
    got = {(r.user_id, r.product_id): r.quantity for r in X.last_snapshot(spark, root, run).collect()}
    assert got == simulate_carts(events)


def test_partial_links_prefer_the_longest_name(spark):
    closure = H.category_closure(spark.createDataFrame([("1", "Books", "0"), ("2", "Children books", "1"), ("3", "Book", "1")], "id string, name string, parent_id string"))
    products = spark.createDataFrame([(1, "modern children books", ""), (2, "oo", None), (3, " BOOK ", "x"), (4, None, "zzz")], "id long, subject_name string, niche_name string")
    got = {r.id: r.category_ids for r in J.link_categories(products, closure).collect()}
    assert got == {1: ["1", "2"], 2: ["1", "2"], 3: ["1", "3"], 4: None}


def test_flatten_keeps_what_lies_deeper_as_text(spark):
    row = spark.createDataFrame([('{"a":{"b":{"c":{"d":1}}},"l":[1,2.5,"x"],"o":[{"k":true}]}',)], "d string").select(flatten(parse("d"), 3).alias("m")).first()
    assert row.m == {"a.b.c": '{"d":1}', "l": "1, 2.5, x", "o.0.k": "true"}


def test_listing_pages_give_no_product(spark):
    pages = spark.createDataFrame(
        [(1, "https://s.example/catalog/", "<html><h1>Catalog</h1></html>"), (2, "https://s.example/product/7", '<div class="product-info"><h1>Pen</h1><span itemprop="sku">9</span></div>')],
        "page_id long, url string, html string",
    )
    assert {r.page_id for r in extract_products(pages).collect()} == {2}


def test_rows_of_a_compact_file_reach_all_cores(spark, tmp_path):
    """One row group is one task's, whatever the file is cut into; costly work on it has to be dealt out first."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from shelfspark.plans.registry import Tables

    pq.write_table(pa.table({"p_partkey": range(20_000), "p_name": ["n"] * 20_000}), tmp_path / "part.parquet")
    t = Tables(spark, str(tmp_path))
    sizes = [r["count"] for r in t.spread("part").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) * spark.sparkContext.defaultParallelism <= 20_000
    # what is stored evenly stays where it is
    t.part.repartition(spark.sparkContext.defaultParallelism).write.parquet(str(tmp_path / "events.parquet"))
    assert "Exchange" not in t.spread("events")._jdf.queryExecution().executedPlan().toString()


def test_best_candidate_reads_a_page_once(spark):
    """The pick and the count of candidates come from one pass over the pages: no join of the candidates with themselves."""
    from pyspark.sql import functions as F

    from shelfspark.operators import pages as P

    doc = '<script type="application/ld+json">[{"@type": "Product", "name": "a"}, {"@type": "Book", "name": "b", "isbn": "9"}, {"@type": "Book", "name": "c", "sku": "1"}]</script>'
    pages = spark.createDataFrame([(1, "http://x/1", doc), (2, "http://x/2", "<p>")], "page_id long, url string, html string")
    best = P.best_candidate(P.json_ld_candidates(pages))
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "Join" not in plan
    got = best.select("page_id", P.get(F.col("record"), "title").alias("title"), "position", "candidates").collect()
    assert [tuple(r) for r in got] == [(1, "b", 1, 3)]


def test_the_main_upsert_sorts_no_compact_file_in_one_task(spark, tmp_path, monkeypatch):
    """The pick of a batch's first rows sorts what a task reads: a file of one row group is dealt out before it."""
    from shelfspark.plans import merge_queries as Q
    from shelfspark.plans.registry import Tables

    spark.read.parquet("/root/testdata/sf0.01/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    monkeypatch.setattr(Q.M, "upsert_main", lambda current, source, *a, **k: seen.append(source) or current)
    Q.main_upsert(Tables(spark, str(tmp_path)))
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < sum(sizes) / 2
