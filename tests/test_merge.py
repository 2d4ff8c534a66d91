"""Merge rules against a row-by-row simulation."""

import random

from pyspark.sql import functions as F

from shelfspark.operators import merge as M

COLUMNS = "id long, source_guid_nom string, source_guid string, source_nomcode string, source_product_id string, isbn string, isbn_normalized string, name string, brand_name string, price double, updated_at long, created_at long"
KEYS = ["source_guid_nom", "source_guid", "source_nomcode"]


def simulate(current, rows):
    """One update after the other, as a document store would do it."""
    table = [dict(r) for r in current]
    skipped = 0
    for row in rows:
        if not (row["name"] or "").strip():
            skipped += 1
            continue
        if row["id"] is not None:
            hit = next((t for t in table if t["id"] == row["id"]), None)
            looked = True
        else:
            key = next((k for k in KEYS if row[k]), None)
            looked = key is not None
            hit = next((t for t in table if t[key] == row[key]), None) if looked else None
        if hit is None:
            table.append({**{k: None for k in current[0]}, **{k: v for k, v in row.items() if v not in (None, "", 0.0)}})
        else:
            for k, v in row.items():
                if v not in (None, "", 0.0):
                    hit[k] = v
    return table, skipped


def test_import_follows_row_order_and_chains(spark):
    rng = random.Random(7)
    current = [
        dict(id=i, source_guid_nom=f"g{i}", source_guid=f"u{i}" if i % 2 else None, source_nomcode=None, source_product_id=None, isbn=None,
             isbn_normalized=None, name=f"old{i}", brand_name="b", price=1.0, updated_at=1, created_at=1)
        for i in range(6)
    ]
    rows = []
    for n in range(60):
        kind = rng.choice(["nom", "guid", "code", "chain", "blank"])
        base = dict(id=None, source_guid_nom="", source_guid="", source_nomcode="", name=f"n{n}", brand_name=rng.choice(["", f"x{n}"]), price=rng.choice([0.0, float(n + 1)]))
        k = rng.randrange(8)
        if kind == "nom":
            base["source_guid_nom"] = f"g{k}"
        elif kind == "guid":
            base["source_guid"] = f"u{k}"
        elif kind == "code":
            base["source_nomcode"] = f"c{k}"
        elif kind == "chain":
            # introduces a second identifier that later rows are looked up by
            base["source_guid_nom"], base["source_nomcode"] = f"g{k + 20}", f"c{k + 20}"
            if rng.random() < 0.5:
                base["source_guid_nom"] = ""
        else:
            base["name"] = " "
        rows.append(base)
    want, skipped = simulate(current, rows)
    df = spark.createDataFrame([tuple(r.values()) for r in current], COLUMNS)
    batch = spark.createDataFrame(
        [(n, r["id"], r["source_guid_nom"], r["source_guid"], r["source_nomcode"], None, None, r["name"], r["brand_name"], r["price"]) for n, r in enumerate(rows)],
        "seq int, id long, source_guid_nom string, source_guid string, source_nomcode string, source_product_id string, isbn string, name string, brand_name string, price double",
    )
    table, refused = M.upsert_imported(df, batch, ["seq"], F.lit(2).cast("bigint"))
    show = ["source_guid_nom", "source_guid", "source_nomcode", "name", "brand_name", "price"]
    got = sorted(repr([r[c] or None for c in show]) for r in table.select(*show).collect())
    assert got == sorted(repr([t[c] or None for c in show]) for t in want)
    assert refused.count() == skipped


def test_upsert_twice_is_upsert_once(spark):
    current = spark.createDataFrame([("1", "g1", "", "", "a", "note", False)], "id string, guid_nom string, guid string, nomcode string, name string, annotation string, in_main boolean")
    batch = spark.createDataFrame([(1, "g1", "", "", "b", "", False), (2, "g2", "", "", "c", "x", True)], "seq int, guid_nom string, guid string, nomcode string, name string, annotation string, in_main boolean")
    once = M.upsert_source(current, batch, ["seq"]).drop("_action")
    by_key = {r.guid_nom: r for r in once.collect()}
    assert by_key["g1"].name == "b" and by_key["g1"].annotation == "note"
    named = once.withColumn("id", F.coalesce("id", "guid_nom"))
    twice = M.upsert_source(named, batch, ["seq"]).drop("_action")
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, named.collect()))


def test_replace_clears_what_upsert_keeps(spark):
    current = spark.createDataFrame([(1, "b", 5.0, 2.0)], "id long, brand_name string, price double, pages double")
    edits = spark.createDataFrame([(1, "", 0.0, -1.0)], "id long, brand_name string, price double, pages double")
    row = M.replace_rows(current, edits).first()
    assert row.brand_name is None and row.pages is None and row.price == 0.0


def test_kept_and_deleted_make_the_whole(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, name string")
    kept, gone = M.delete_rows(df, F.col("name") == "a")
    assert {r.id for r in kept.collect()} == {2, 3} and {r.id for r in gone.collect()} == {1}


def test_clash_with_a_stored_identifier_is_skipped(spark):
    current = spark.createDataFrame([(1, "g1", None, None, None, None, None, "a", "b", 1.0, 1, 1), (2, "g2", None, None, None, None, None, "c", "d", 1.0, 1, 1)], COLUMNS)
    batch = spark.createDataFrame([(0, 1, "g2", "", "", None, None, "new", "", 0.0)], "seq int, id long, source_guid_nom string, source_guid string, source_nomcode string, source_product_id string, isbn string, name string, brand_name string, price double")
    table, refused = M.upsert_imported(current, batch, ["seq"], F.lit(2).cast("bigint"))
    assert {r.name for r in table.collect()} == {"a", "c"}
    assert [r.reason for r in refused.collect()] == ["duplicate key"]


def test_a_clash_without_a_place_in_the_order_is_skipped_and_not_applied(spark):
    """Refused rows are told apart by themselves, not by order columns that may be null."""
    from pyspark.sql import functions as F

    from shelfspark.operators import merge as M

    columns = "id long, source_guid_nom string, source_guid string, source_nomcode string, source_product_id string, isbn string, isbn_normalized string, name string, updated_at long, created_at long"
    current = spark.createDataFrame([(1, "A", None, None, None, None, None, "one", 0, 0), (2, "B", None, None, None, None, None, "two", 0, 0)], columns)
    rows = spark.createDataFrame(
        [(1, "B", None, None, None, None, None, "clash", None), (2, "B", None, None, None, None, None, "TWO", 1), (None, None, None, None, None, None, None, " ", 2)],
        "id long, source_guid_nom string, source_guid string, source_nomcode string, source_product_id string, isbn string, isbn_normalized string, name string, at long",
    )
    table, skipped = M.upsert_imported(current, rows, ["at"], F.lit(9).cast("long"))
    assert sorted((r.id, r.name, r._action) for r in table.collect()) == [(1, "one", "kept"), (2, "TWO", "updated")]
    assert sorted(r.reason for r in skipped.collect()) == ["duplicate key", "name is required"]
    assert sorted(r.reason for r in M.skipped_imports(current, rows).collect()) == ["duplicate key", "name is required"]
