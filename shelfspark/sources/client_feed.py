"""Client shop feeds: reading, identifiers, ISBN, price, category, quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.functions.numbers import positive
from shelfspark.functions.text import looks_like_isbn_ean, primary_link, short_hash, split_category, trim_all
from shelfspark.operators.skew import first_by

ITEM = (
    "struct<domain:string,url:string,name:string,gtin:string,barcode:string,code:string,code_type:string,isbn:string,ean:string,"
    "description:string,price:double,cost:double,currency:string,image:string,brand:string,category:string,availability:string,"
    "source:string,required_ok:boolean,required_fields:array<string>,missing_required:array<string>,error:string>"
)
FEED_SCHEMA = f"domains array<struct<domain:string,items:array<{ITEM}>>>"
UNKNOWN_DOMAIN = "unknown-domain"


def field(c: Column | str) -> Column:
    """Hard spaces to plain ones, trimmed; null to ''."""
    text = F.col(c) if isinstance(c, str) else c
    return trim_all(F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" ")))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def flatten_feed(docs: DataFrame) -> DataFrame:
    """domains[].items[] to rows with their place: file, domain_index, item_index."""
    buckets = docs.select("file", F.posexplode("domains").alias("domain_index", "bucket"))
    rows = buckets.select(
        "file", "domain_index", F.col("bucket.domain").alias("bucket_domain"), F.posexplode("bucket.items").alias("item_index", "item")
    )
    domain = F.coalesce(_filled(field("item.domain")), _filled(field("bucket_domain")), F.lit(UNKNOWN_DOMAIN))
    return rows.select("file", "domain_index", "item_index", domain.alias("row_domain"), "item.*")


def read_client_feed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Feed files by path, glob or comma list; each file is one JSON document."""
    listed = paths.split(",") if isinstance(paths, str) else list(paths)
    wanted = sorted({p.strip() for p in listed if p.strip()})
    docs = spark.read.schema(FEED_SCHEMA).option("multiLine", True).json(wanted)
    return flatten_feed(docs.withColumn("file", F.input_file_name()))


def read_client_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same feed with one document per line, which splits over tasks."""
    docs = spark.read.schema(FEED_SCHEMA).json(path)
    return flatten_feed(docs.withColumn("file", F.input_file_name()))


# Fixed value: the kind that converted items carry.
SOURCE_KIND = "products_client_all"


def raw_item(items: DataFrame, no_dashes) -> Column:
    """The item as publisher JSON: source labels, identifiers once each, PRICE and COST; empty ones are left out."""
    code_isbn = F.when(F.lower(field("code_type")) == "isbn", no_dashes(F.col("_code")))
    code_ean = F.when(F.lower(field("code_type")) == "ean", no_dashes(F.col("_code")))
    named = [("ISBN", code_isbn), ("EAN", code_ean), ("ISBN", F.col("_isbn")), ("EAN", F.col("_ean")), ("GTIN", F.col("_gtin")), ("BARCODE", F.col("_barcode")), ("CODE", F.col("_code"))]
    shown: dict[str, Column] = {}
    earlier: list[Column] = []
    for key, value in named:
        fresh = _filled(F.coalesce(value, F.lit("")))
        for other in earlier:
            fresh = F.when(~F.coalesce(F.upper(fresh) == F.upper(other), F.lit(False)), fresh)
        shown[key] = F.coalesce(fresh, shown[key]) if key in shown else fresh
        earlier.append(value)
    price, cost = positive(F.col("price")), positive(F.col("cost"))
    known = set(items.columns)
    lists = {k: F.col(c) for k, c in (("REQUIRED", "required_fields"), ("MISSING_REQUIRED", "missing_required")) if c in known}
    if "MISSING_REQUIRED" in lists:
        lists["MISSING_REQUIRED"] = F.when(F.size(lists["MISSING_REQUIRED"]) > 0, lists["MISSING_REQUIRED"])
    parts = {
        "SOURCE_KIND": F.lit(SOURCE_KIND),
        "SOURCE_DOMAIN": F.col("row_domain"),
        "SOURCE_URL": F.col("_url"),
        "SOURCE_LABEL": field("source"),
        "CODE_TYPE": field("code_type"),
        "CATEGORY": field("category"),
        "AVAILABILITY": field("availability"),
        "CURRENCY": field("currency"),
        "REQUIRED_OK": F.coalesce("required_ok", F.lit(False)),
        **lists,
        "ERROR": _filled(field("error")),
        **shown,
        "PRICE": price,
        "COST": F.when(price.isNull() | (F.abs(price - cost) >= 1e-6), cost),
    }
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))


def normalize_feed(items: DataFrame, keep_empty_name: bool = False) -> DataFrame:
    """Feed items to catalog candidates with identifiers, price, path, raw item and quality score.

    Rows keep `skip`, the reason a row takes no part, and `synthetic`, whether
    its identifier had to be made up from the URL or name. With
    `keep_empty_name` an item without a name gets one from its place.
    """

    def squeezed(c: str) -> Column:
        return F.replace(field(c), F.lit(" "), F.lit(""))

    def no_dashes(c: Column) -> Column:
        return F.replace(F.replace(field(c), F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))

    keyed = items.withColumns(
        {
            "_gtin": squeezed("gtin"),
            "_barcode": squeezed("barcode"),
            "_code": squeezed("code"),
            "_isbn": no_dashes(F.col("isbn")),
            "_ean": no_dashes(F.col("ean")),
            "_url": field("url"),
            "_name": field("name"),
        }
    )
    given = F.coalesce(*[_filled(F.col(c)) for c in ("_code", "_barcode", "_gtin", "_ean", "_isbn")])
    made = F.coalesce(
        F.when(F.col("_url") != "", F.concat(F.lit("url-"), short_hash("_url"))),
        F.when(F.col("_name") != "", F.concat(F.lit("name-"), short_hash(F.concat("row_domain", F.lit("|"), "_name")))),
        F.concat(F.lit("row-"), (F.col("item_index") + 1).cast("string")),
    )
    typed_code = F.when(F.lower(field("code_type")).isin("isbn", "ean"), no_dashes(F.col("_code")))
    candidates = F.array("_isbn", "_ean", typed_code, no_dashes(F.col("_barcode")), no_dashes(F.col("_code")), no_dashes(F.col("_gtin")))
    isbn = F.coalesce(F.get(F.filter(candidates, lambda c: looks_like_isbn_ean(c)), F.lit(0)), F.lit(""))
    path = F.coalesce(split_category(field("category")), F.array().cast("array<string>"))
    named = keyed.withColumns(
        {
            "nomcode": F.coalesce(given, made),
            "synthetic": given.isNull(),
            "isbn_out": isbn,
            "price_out": F.coalesce(positive(F.col("cost")), positive(F.col("price"))),
            "path": path,
        }
    )
    named = named.withColumn("raw", raw_item(items, no_dashes))
    if keep_empty_name:
        unnamed = F.concat(F.lit("Unnamed product "), (F.col("item_index") + 1).cast("string"))
        named = named.withColumn("_name", F.coalesce(_filled(F.col("_name")), unnamed))
    shaped = named.select(
        "file",
        "domain_index",
        "item_index",
        "row_domain",
        F.when(F.col("_name") == "", "no name").alias("skip"),
        "synthetic",
        F.concat(F.lit("client:"), "row_domain", F.lit(":"), "nomcode").alias("guid_nom"),
        F.concat(
            F.lit("client_url:"),
            short_hash(F.coalesce(_filled(F.col("url")), F.concat("row_domain", F.lit("|"), "nomcode"))),
        ).alias("guid"),
        "nomcode",
        F.col("isbn_out").alias("isbn"),
        F.col("_name").alias("name"),
        field("description").alias("annotation"),
        primary_link(field("image")).alias("cover_url"),
        field("brand").alias("brand_name"),
        F.coalesce(F.get("path", F.lit(0)), F.lit("")).alias("subject_name"),
        F.coalesce(F.get("path", F.lit(1)), F.lit("")).alias("niche_name"),
        F.array_join("path", " / ").alias("category_path"),
        F.col("price_out").alias("price"),
        F.coalesce("required_ok", F.lit(False)).alias("required_ok"),
        F.col("_url").alias("source_url"),
        "raw",
    )
    return shaped.withColumn("score", quality_score())


def quality_score() -> Column:
    """How complete a candidate is: the weights rank copies of one product."""

    def worth(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    return (
        worth(F.col("name") != "", 100)
        + worth(F.col("annotation") != "", 15)
        + worth(F.col("cover_url") != "", 20)
        + worth(F.col("price").isNotNull(), 20)
        + worth(F.col("brand_name") != "", 10)
        + worth(F.col("isbn") != "", 10)
        + worth(F.col("required_ok"), 5)
    )


PLACE = ["file", "domain_index", "item_index"]


def best_record(candidates: DataFrame) -> DataFrame:
    """One row per guid_nom: the highest score, the first seen among equals."""
    usable = candidates.where(F.col("skip").isNull())
    return first_by(usable, ["guid_nom"], [F.desc("score"), *[F.asc(c) for c in PLACE]])


def feed_stats(candidates: DataFrame) -> DataFrame:
    """Counters of one conversion in a single row.

    `replaced` counts the rows that beat every earlier copy of their product,
    which needs the running best score per product; the rest are plain sums.
    """
    from pyspark.sql import Window

    usable = candidates.where(F.col("skip").isNull())
    # equal scores of one product collapse to their first row: at most one row per distinct score is left
    # (scores have under 200 values), so the running best sees a bounded group
    firsts = usable.groupBy("guid_nom", "score").agg(
        F.min(F.struct(*PLACE)).alias("place"), F.max(F.struct(F.col("price").isNotNull().alias("p"))).alias("_p")
    )
    earlier = Window.partitionBy("guid_nom").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    raised = firsts.withColumn("best_before", F.max("score").over(earlier))
    replaced = raised.agg(F.sum(F.when(F.col("score") > F.col("best_before"), 1).otherwise(0)).alias("value"))
    best = best_record(candidates)
    totals = candidates.agg(
        F.count(F.lit(1)).alias("input_items"),
        F.sum(F.when(F.col("skip") == "no name", 1).otherwise(0)).alias("skipped_no_name"),
        F.sum(F.when(F.col("skip").isNull() & F.col("synthetic"), 1).otherwise(0)).alias("synthetic_identifiers"),
    )
    kept = best.agg(
        F.count(F.lit(1)).alias("output_items"),
        F.sum(F.when(F.col("price").isNotNull(), 1).otherwise(0)).alias("with_price"),
        F.sum(F.when(F.col("isbn") != "", 1).otherwise(0)).alias("with_isbn"),
    )

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("bigint") for c in df.columns]))).alias("counter", "value"))

    counters = long(totals).unionByName(long(kept)).unionByName(replaced.select(F.lit("replaced").alias("counter"), F.col("value").cast("bigint")))
    names = ["input_items", "skipped_no_name", "synthetic_identifiers", "output_items", "with_price", "with_isbn", "replaced"]
    row = counters.agg(*[F.coalesce(F.max(F.when(F.col("counter") == n, F.col("value"))), F.lit(0)).alias(n) for n in names])
    return row.withColumn("discarded", F.col("input_items") - F.col("skipped_no_name") - F.col("output_items") - F.col("replaced"))
