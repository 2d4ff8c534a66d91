"""Matching between catalogs, feeds, runs and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.keys import (
    SOURCE_KEY,
    catalog_code,
    identities,
    main_key,
    source_key_with_id,
    stable_key,
)
from shelfspark.functions.text import non_blank, norm_code_ascii, trim_all
from shelfspark.functions.values import kind, parse
from shelfspark.operators.filters import is_stock_syncable
from shelfspark.operators.merge import upsert_main
from shelfspark.operators.skew import HEAVY_ROWS, spread_join
from shelfspark.session import written

MAIN_SOURCE_KEY = [("guidNom", "source_guid_nom"), ("guid", "source_guid"), ("nomcode", "source_nomcode")]


def _number(c: Column) -> Column:
    return trim_all(c).try_cast("double")


def stock_by_barcode(feed: DataFrame, shop: str) -> DataFrame:
    """One (code, quantity, price) per barcode out of the feed's shop arrays.

    Quantity sums the matching shops; price is the first positive one, else
    the last that parses. Of several items with one barcode the larger
    quantity wins, then the larger price; quantities count as equal within
    1e-6, so they are compared on that grid. A plain aggregate: partial
    maxima leave each task before the shuffle.
    """
    wanted = shop.strip().lower()

    def mine(entries: str) -> Column:
        return F.transform(
            F.filter(entries, lambda e: F.lower(trim_all(e["shop"])).contains(wanted)), lambda e: _number(e["amount"])
        )

    amounts = F.filter(mine("amounts"), lambda n: n.isNotNull())
    prices = F.filter(mine("prices"), lambda n: n.isNotNull())
    positive = F.filter(prices, lambda n: n > 0)
    quantity = F.aggregate(amounts, F.lit(0.0), lambda a, b: a + b)
    price = F.coalesce(F.get(positive, F.lit(0)), F.get(prices, F.size(prices) - 1), F.lit(0.0))
    items = feed.select(norm_code_ascii(trim_all("barcode")).alias("code"), quantity.alias("quantity"), price.alias("price"))
    best = items.where(F.col("code") != "").groupBy("code").agg(
        F.max(F.struct(F.round("quantity", 6).alias("grid"), "price", "quantity")).alias("best")
    )
    return best.select("code", "best.quantity", "best.price")


def unique_feed(feed: DataFrame, order: Sequence[Column]) -> DataFrame:
    """First feed item per id, else per barcode; items with neither are dropped."""
    from shelfspark.operators.skew import first_by

    code = F.nullif(norm_code_ascii(trim_all("barcode")), F.lit(""))
    key = F.coalesce(F.concat(F.lit("id:"), non_blank("id")), F.concat(F.lit("barcode:"), code))
    keyed = feed.withColumn("_key", key).where(F.col("_key").isNotNull())
    return first_by(keyed, ["_key"], order).drop("_key")


def union_segments(segments: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Overlapping feed extracts merged; the earliest segment's copy of an item stays."""
    tagged = [s.withColumn("_segment", F.lit(i)) for i, s in enumerate(segments)]
    whole = tagged[0]
    for more in tagged[1:]:
        whole = whole.unionByName(more)
    return unique_feed(whole, [F.asc("_segment"), *[F.asc(c) for c in order]]).drop("_segment")


def completeness(merged: DataFrame, expected: int | Column) -> DataFrame:
    """One row: found, expected, complete."""
    want = F.lit(expected) if isinstance(expected, int) else expected
    found = F.count(F.lit(1))
    return merged.agg(found.alias("found"), F.max(want).cast("bigint").alias("expected")).withColumn(
        "complete", F.col("found") >= F.col("expected")
    )


def stock_matches(catalog: DataFrame, stock: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Catalog rows with an ISBN next to the stock of their code."""
    candidates = catalog.where(is_stock_syncable()).select(
        "id", catalog_code().alias("code"), F.col("quantity").alias("old_quantity"), F.col("price").alias("old_price")
    )
    return spread_join(candidates.where(F.col("code").isNotNull()), stock, "code", ["id"], heavy_rows=heavy_rows)


def match_stock(catalog: DataFrame, stock: DataFrame) -> DataFrame:
    """Updates (id, isbn_normalized, quantity, price) where the stored values are missing or differ."""

    def differs(old: str, new: str) -> Column:
        return F.col(old).isNull() | (F.abs(F.col(old) - F.col(new)) >= 1e-6)

    hits = stock_matches(catalog, stock)
    changed = hits.where(differs("old_quantity", "quantity") | differs("old_price", "price"))
    return changed.select("id", F.col("code").alias("isbn_normalized"), "quantity", "price")


# Columns that spread publisher rows without any key over the tasks.
SOURCE_ROW = ["id", "name"]


def flag_in_main(source: DataFrame, main: DataFrame) -> DataFrame:
    """Publisher rows with `in_main`: both sides reduce to their first identifier."""
    present = main.select(main_key().alias("_key")).where(F.col("_key").isNotNull()).distinct().withColumn("_hit", F.lit(True))
    keyed = source.withColumn("_key", F.coalesce(source_key_with_id(), F.concat(F.lit("none:"), F.xxhash64(*SOURCE_ROW).cast("string"))))
    return keyed.join(present, "_key", "left").withColumn("in_main", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def missing_keys(source: DataFrame, main: DataFrame) -> DataFrame:
    """Source keys the main catalog lacks."""
    have = main.select(main_key().alias("key"))
    return source.select(source_key_with_id().alias("key")).where("key IS NOT NULL").distinct().join(have, "key", "left_anti")


def common_keys(source: DataFrame, main: DataFrame) -> DataFrame:
    have = main.select(main_key().alias("key"))
    return source.select(source_key_with_id().alias("key")).where("key IS NOT NULL").distinct().join(have, "key", "left_semi")


def copy_to_main(
    source: DataFrame,
    main: DataFrame,
    order: Sequence[str],
    as_of: Column,
    category: tuple[str, list[str]] | None = None,
    only_missing: bool = True,
) -> DataFrame:
    """Selected publisher rows copied into the main catalog, by default only those it lacks."""
    chosen = source
    if only_missing:
        lacking = missing_keys(source, main).select(F.col("key").alias("_lack"))
        chosen = source.withColumn("_lack", source_key_with_id()).join(lacking, "_lack", "left_semi").drop("_lack")
    return upsert_main(main, chosen, order, as_of, category)


#: Length of the pieces that texts are looked up by.
GRAM = 3


def _grams(c: Column, n: Column | int) -> Column:
    """Distinct pieces of n letters; none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.length(c) - n + 1)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, n))))


def anchored(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """(needle, hay) candidates: every hay that has the needle's rarest piece.

    A hay that contains the needle has all its pieces, so it is among those of any one of them. Needles shorter than a
    piece are pieces themselves; hays are cut to such lengths only where a needle has them.
    """
    sizes = needles.agg(F.collect_set(F.least(F.length(needle), F.lit(GRAM)))).scalar()
    cut = F.flatten(F.array_compact(F.transform("_sizes", lambda n: _grams(F.col(hay), n))))
    postings = hays.select(hay, sizes.alias("_sizes")).select(hay, F.explode(cut).alias("_gram"))
    counts = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_count"))
    own = needles.select(needle, F.explode(_grams(F.col(needle), F.least(F.length(needle), F.lit(GRAM)))).alias("_gram"))
    weighed = own.join(counts, "_gram", "left").groupBy(needle).agg(F.min(F.struct(F.coalesce("_count", F.lit(0)).alias("count"), "_gram")).alias("_rarest"))
    # a piece that no hay has rules the needle out
    anchors = weighed.where(F.col("_rarest.count") > 0).select(needle, F.col("_rarest._gram").alias("_gram"))
    return anchors.join(postings, "_gram").select(needle, hay)


def contained(needles: DataFrame, needle: str, hays: DataFrame, hay: str) -> DataFrame:
    """(needle, hay) of all distinct non-empty needles that a distinct hay contains."""
    return anchored(needles, needle, hays, hay).where(F.contains(F.col(hay), F.col(needle)))


def partial_matches(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Best category name inside a term, or around it: the longest, then by name, then by id.

    "Contains" is looked up in an inverted index of three-letter pieces, in both directions, so pairs meet only on the
    rarest piece of the shorter text.
    """
    plain = names.select("name")
    hits = contained(plain, "name", terms, "term").select("term", "name").union(contained(terms.select("term"), "term", plain, "name").select("term", "name"))
    best = hits.join(names, "name").groupBy("term").agg(F.min(F.struct((-F.length("name")).alias("size"), "name", "category_id")).alias("best"))
    return best.select("term", F.col("best.category_id").alias("partial_id"))


def link_categories(products: DataFrame, closure: DataFrame) -> DataFrame:
    """Add category_ids and category_path by subject, then niche name; exact before partial.

    All matching happens on distinct terms; the products meet the finished
    lookup twice, with the term's row count as the guide for splitting a term
    that very many products share.
    """
    folded = F.lower(trim_all("name"))
    names = closure.groupBy(folded.alias("name")).agg(F.min("id").alias("category_id")).where("name <> ''")
    keyed = products.drop("category_ids", "category_path").withColumns(
        {"_subject": F.lower(non_blank("subject_name")), "_niche": F.lower(non_blank("niche_name"))}
    )
    terms = (
        keyed.select(F.explode(F.array_distinct(F.array("_subject", "_niche"))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    # distinct terms are read several times below; the products are scanned for them once
    terms = written(terms, "terms")
    exact = terms.join(names.withColumnRenamed("name", "term"), "term", "left").withColumnRenamed("category_id", "exact_id")
    unmatched = exact.where(F.col("exact_id").isNull()).select("term")
    decided = exact.join(partial_matches(unmatched, names), "term", "left").select(
        "term", "rows", F.coalesce("exact_id", "partial_id").alias("id"), F.col("exact_id").isNotNull().alias("exact")
    )
    where_to = closure.dropDuplicates(["id"]).select("id", F.struct("ancestor_ids", "path").alias("at"))
    lookup = decided.join(where_to, "id").select("term", "rows", "exact", "at")

    def side(prefix: str, c: str) -> DataFrame:
        return lookup.select(
            F.col("term").alias(c), F.col("rows").alias(f"{prefix}rows"), F.col("exact").alias(f"{prefix}exact"), F.col("at").alias(f"{prefix}at")
        )

    linked = spread_join(keyed, side("_s", "_subject"), "_subject", ["id"], "left", weight="_srows")
    linked = spread_join(linked, side("_n", "_niche"), "_niche", ["id"], "left", weight="_nrows")
    at = F.coalesce(F.when(F.col("_sexact"), F.col("_sat")), F.when(F.col("_nexact"), F.col("_nat")), F.col("_sat"), F.col("_nat"))
    done = linked.withColumn("_at", at)
    return done.select(
        *[c for c in products.columns if c not in ("category_ids", "category_path")],
        F.col("_at.ancestor_ids").alias("category_ids"),
        F.col("_at.path").alias("category_path"),
    )


def priced_items(carts: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines (user_id, product_id, quantity, price_at_add) with the price that counts.

    Lines of unknown products are dropped; a price of 0 at the time of adding
    falls back to the product's.
    """
    shelf = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("price").alias("_price"))
    joined = spread_join(carts, shelf, "product_id", ["user_id", "product_id"])
    price = F.when(F.coalesce("price_at_add", F.lit(0.0)) == 0, F.col("_price")).otherwise(F.col("price_at_add"))
    return joined.select("user_id", "product_id", "product_name", "quantity", price.alias("price"))


def order_totals(items: DataFrame) -> DataFrame:
    """Lines, units and amount (in cents, so that sums are exact) per user."""
    cents = F.round(F.col("price") * 100).cast("bigint") * F.col("quantity")
    return items.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"), F.sum(cents).alias("amount_cents")
    )


def rejected_carts(carts: DataFrame, items: DataFrame) -> DataFrame:
    """Users whose cart holds no known product."""
    return carts.select("user_id").distinct().join(items.select("user_id").distinct(), "user_id", "left_anti")


def previous_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The newest finished run with records, other than the given one."""
    usable = runs.where((F.col("run_id") != run_id) & (F.col("status") == "finished") & (F.col("records") > 0))
    return usable.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)


def canonical(data: Column | str) -> Column:
    """JSON text with sorted keys and normal spacing, for whole-record equality."""
    return F.to_json(parse(data))


def comparable_record(data: Column | str) -> Column:
    """Canonical text of a record; what can't be read compares as the text it is, and null equals null."""
    text = F.col(data) if isinstance(data, str) else data
    return F.coalesce(canonical(text), text)


def diff_runs(records: DataFrame, runs: DataFrame, run_id: str) -> DataFrame:
    """Status per record of a run: new, changed or unchanged against the previous run."""
    before = previous_run(runs, run_id).select("run_id")
    old = records.join(before, "run_id", "left_semi")
    last = old.groupBy("source_url").agg(F.max(F.struct("created_at", "record_id", comparable_record("data").alias("data")))["data"].alias("_old"))
    now = records.where(F.col("run_id") == run_id)
    joined = spread_join(now, last.withColumn("_seen", F.lit(True)), "source_url", ["record_id"], "left")
    status = F.when(F.col("_seen").isNull(), "new").when(comparable_record("data").eqNullSafe(F.col("_old")), "unchanged").otherwise("changed")
    return joined.select("record_id", "source_url", status.alias("status"))


# Identifier fields of a mapped row, in order of trust.
DIFF_IDENTIFIERS = [
    "source.guidNom",
    "main.sourceGuidNom",
    "source.guid",
    "main.sourceGuid",
    "source.nomcode",
    "main.sourceNomcode",
    "source.isbn",
    "main.isbn",
]


def comparable(v: Column) -> Column:
    """JSON text of a value; blank text, zero and an empty list all read as null."""
    what = kind(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(what == "VOID", F.lit(None))
        .when(what == "STRING", F.concat(F.lit('"'), non_blank(text), F.lit('"')))
        .when(what == "ARRAY", F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) > 0, F.to_json(v)))
        .when(what.isin("OBJECT", "BOOLEAN"), F.to_json(v))
        .otherwise(F.when(text.try_cast("double") != 0, F.to_json(v)))
    )


def diff_fields(local: DataFrame, remote: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """Mapped local rows against remote ones: record_id, identifier, status, changed.

    `local.data` is JSON text, `rules` maps a target field to (source field,
    constant); the source field comes first here. `remote` holds identifier
    and `data` (JSON of target fields). Only local fields are compared; one
    the remote lacks always differs.
    """
    doc = F.try_variant_get(parse("data"), "$", "map<string,variant>")
    entries = []
    for target, (source, constant) in rules.items():
        if source:
            value, present = F.element_at(doc, F.lit(source)), F.map_contains_key(doc, F.lit(source))
        elif constant:
            value, present = parse(F.to_json(F.struct(F.lit(constant).alias("c")))), F.lit(True)
            value = F.try_variant_get(value, "$.c", "variant")
        else:
            continue
        entries.append(F.when(present, F.struct(F.lit(target).alias("field"), comparable(value).alias("local"))))
    mapped = local.select("record_id", F.filter(F.array(*entries), lambda e: e.isNotNull()).alias("fields"))
    by_name = F.map_from_entries("fields")
    texts = [F.regexp_replace(F.element_at(by_name, F.lit(i)), '^"|"$', "") for i in DIFF_IDENTIFIERS if i in rules]
    keyed = mapped.withColumn("identifier", F.coalesce(*texts) if texts else F.lit(None).cast("string"))
    known = F.try_variant_get(parse("data"), "$", "map<string,variant>")
    other = remote.select("identifier", F.transform_values(known, lambda _, v: F.coalesce(comparable(v), F.lit(""))).alias("_remote"))
    joined = spread_join(keyed, other, "identifier", ["record_id"], "left")
    differing = F.filter(
        "fields",
        lambda e: ~F.map_contains_key("_remote", e["field"])
        | (F.coalesce(e["local"], F.lit("")) != F.element_at(F.col("_remote"), e["field"])),
    )
    changed = F.transform(
        differing,
        lambda e: F.struct(e["field"].alias("field"), e["local"].alias("local"), F.element_at(F.col("_remote"), e["field"]).alias("remote")),
    )
    status = F.when(F.col("_remote").isNull(), "new").when(F.size(differing) > 0, "changed").otherwise("unchanged")
    return joined.select(
        "record_id",
        "identifier",
        status.alias("status"),
        F.when(F.col("_remote").isNotNull(), changed).otherwise(F.array().cast("array<struct<field:string,local:string,remote:string>>")).alias("changed"),
    )


def refresh_flags(source: DataFrame, deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """After main rows are deleted, `in_main` of the touched publisher rows: is the key still there."""
    touched = deleted.select(stable_key([(k, c) for k, c in MAIN_SOURCE_KEY]).alias("_key")).where("_key IS NOT NULL").distinct()
    left = remaining.select(F.explode(identities(MAIN_SOURCE_KEY)).alias("_key")).distinct().withColumn("_still", F.lit(True))
    verdict = touched.join(left, "_key", "left").select("_key", F.coalesce("_still", F.lit(False)).alias("_still"))
    carried = source.select("id", F.explode(identities(SOURCE_KEY)).alias("_key"))
    new = carried.join(verdict, "_key").groupBy("id").agg(F.max("_still").alias("_flag"))
    return source.join(new, "id", "left").withColumn("in_main", F.coalesce("_flag", "in_main")).drop("_flag")


def ownership_violations(rows: DataFrame, owners: DataFrame, ref: str) -> DataFrame:
    """Rows whose referenced record is missing or belongs to another user."""
    held = owners.select(F.col("id").alias(ref), F.col("user_id").alias("_owner"))
    joined = spread_join(rows, held, ref, ["id"], "left")
    reason = F.when(F.col("_owner").isNull(), "not found").when(F.col("_owner") != F.col("user_id"), "not owned by the user")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_owner")
