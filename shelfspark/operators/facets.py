"""Distinct values, facets, counts and small reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.covers import first_cover
from shelfspark.functions.text import clean_array, trim_all
from shelfspark.functions.urls import extract_domain
from shelfspark.operators.filters import UNCATEGORIZED, is_uncategorized


def first_rows(df: DataFrame, limit: int | None) -> DataFrame:
    """The first rows of an order, where the caller asks for a limit."""
    return df if limit is None else df.limit(limit)


def distinct_values(df: DataFrame, c: str, limit: int | None = None) -> DataFrame:
    """Distinct non-empty values, trimmed for show after the dedupe, so trimmed twins both stay."""
    values = (
        df.select(F.col(c).alias("raw"))
        .where(trim_all("raw") != "")
        .distinct()
        .select(trim_all("raw").alias("value"), "raw")
        .orderBy("value", "raw")
    )
    return first_rows(values, limit).select("value")


def distinct_array_values(df: DataFrame, c: str, limit: int | None = None) -> DataFrame:
    return distinct_values(df.select(F.explode(c).alias(c)), c, limit)


def facet_meta(df: DataFrame, scalars: dict[str, str], arrays: dict[str, str]) -> DataFrame:
    """All facet values in one scan: every row becomes its (facet, value) pairs, then one distinct."""
    single = [F.array(F.struct(F.lit(k).alias("facet"), F.col(c).alias("value"))) for k, c in scalars.items()]

    def tagged(k: str, c: str) -> Column:
        values = F.coalesce(c, F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(k).alias("facet"), v.alias("value")))

    many = [tagged(k, c) for k, c in arrays.items()]
    pairs = df.select(F.inline(F.array_distinct(F.concat(*single, *many))))
    return pairs.where(trim_all("value") != "").distinct().select("facet", trim_all("value").alias("value"))


def unique_authors(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Author references by guid; the name comes from the oldest row, then the smallest id."""
    refs = df.select("updated_at", "id", F.inline("author_refs"))
    named = refs.where((F.col("guid") != "") & (F.col("name") != ""))
    picked = named.groupBy("guid").agg(F.min(F.struct("updated_at", "id", "name")).alias("first"))
    return first_rows(picked.select("guid", F.col("first.name").alias("name")).orderBy("name", "guid"), limit)


def source_domains(df: DataFrame) -> DataFrame:
    """Distinct hosts over both source ids, the cover and every cover link."""
    texts = F.concat(F.array("source_guid_nom", "source_guid", "cover_url"), F.coalesce(F.map_values("covers"), F.array().cast("array<string>")))
    hosts = F.array_distinct(F.transform(texts, lambda t: extract_domain(t)))
    return df.select(F.explode(hosts).alias("domain")).where(F.col("domain") != "").distinct()


def product_domain() -> Column:
    """Host of the first identifier or cover that names one; none gives null."""
    sources = F.array("source_guid_nom", "source_guid", first_cover("cover_url", "covers"))
    hosts = F.filter(F.transform(sources, lambda x: extract_domain(x)), lambda h: h != "")
    return F.get(hosts, F.lit(0))


def category_hint() -> Column:
    """[domain, subject, niche] or [domain, stored path..]; no domain gives a null head."""
    named = clean_array(F.array("subject_name", "niche_name"))
    base = F.coalesce(named, clean_array("category_path"), F.array().cast("array<string>"))
    return F.concat(F.array(product_domain()), base)


def _with_key(hints: DataFrame) -> DataFrame:
    return hints.distinct().withColumn("path_key", F.array_join("path", "\u001f"))


def source_paths(df: DataFrame) -> DataFrame:
    """Distinct source category paths, as `path` plus the joined key they sort by."""
    return _with_key(df.select(category_hint().alias("path")).where(F.element_at("path", 1).isNotNull()))


def uncategorized_hints(df: DataFrame) -> DataFrame:
    """The same over rows without a category; rows without a domain share one label."""
    hints = df.where(is_uncategorized()).select(category_hint().alias("path"))
    return _with_key(
        hints.select(F.when(F.element_at("path", 1).isNotNull(), F.col("path")).otherwise(F.array(F.lit(UNCATEGORIZED))).alias("path"))
    )


def extract_dimension(df: DataFrame, guid: str, name: str, order: Sequence[str], owner: str | None = None) -> DataFrame:
    """Distinct (guid, name) entities inside products, the first row by `order` deciding."""
    payload = F.struct(*[F.col(o) for o in order], F.col(name).alias("_name"), (F.col(owner) if owner else F.lit("")).alias("_owner"))
    picked = df.where(F.col(guid) != "").groupBy(F.col(guid).alias("guid")).agg(F.min(payload).alias("first"))
    return picked.select("guid", F.col("first._name").alias("name"), F.col("first._owner").alias("owner_guid"))


def average_rating(reviews: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Mean and count per product; with a product list, products without reviews show 0 and 0."""
    stats = reviews.groupBy("product_id").agg(
        F.sum("rating").alias("_sum"), F.count(F.lit(1)).alias("review_count")
    ).select("product_id", (F.col("_sum") / F.col("review_count")).alias("average"), "review_count")
    if products is None:
        return stats
    return products.join(stats, "product_id", "left").select(
        "product_id", F.coalesce("average", F.lit(0.0)).alias("average"), F.coalesce("review_count", F.lit(0)).alias("review_count")
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that break a uniqueness rule, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def run_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("run_id").agg(F.count(F.lit(1)).alias("records"))


def distinct_active(df: DataFrame, c: str, flag: str = "is_active") -> DataFrame:
    return df.where(F.coalesce(F.col(flag), F.lit(False)) & (trim_all(c) != "")).select(c).distinct()


def mapping_usage(rules: DataFrame) -> DataFrame:
    """How many targets read each source field."""
    used = rules.where(trim_all("source") != "")
    return used.groupBy(trim_all("source").alias("source")).agg(F.count(F.lit(1)).alias("targets"))


def sync_summary(actions: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Counts per run and target, one column per kind of outcome."""
    counts = [F.sum(F.when(F.col("action") == k, 1).otherwise(0)).alias(k) for k in kinds]
    return actions.groupBy("run_id", "target").agg(*counts, F.count(F.lit(1)).alias("total"))


def detected_fields(records: DataFrame, run_id: str | None = None) -> DataFrame:
    """Distinct keys of all record maps, or of one run's; each task sends a key once."""
    rows = records.where(F.col("run_id") == run_id) if run_id is not None else records
    keys = rows.select(F.explode(F.map_keys("data")).alias("raw")).select(trim_all("raw").alias("field"))
    return keys.where(F.col("field") != "").distinct().orderBy("field")


def link_stats(tree: DataFrame, linked: DataFrame) -> DataFrame:
    """Category totals next to the number of products that got a category, as (metric, value) rows."""
    names = tree.select(F.lower(trim_all("name")).alias("name")).distinct().agg(F.count(F.lit(1)).alias("value"))
    nodes = tree.agg(F.count(F.lit(1)).alias("value"))
    done = linked.agg(F.coalesce(F.sum(F.when(F.size("category_ids") > 0, 1).otherwise(0)), F.lit(0)).alias("value"))
    labelled = [
        part.select(F.lit(label).alias("metric"), "value")
        for label, part in (("total_categories", names), ("total_nodes", nodes), ("linked_products", done))
    ]
    return labelled[0].unionByName(labelled[1]).unionByName(labelled[2])
