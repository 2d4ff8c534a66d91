"""Nested category files and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfspark.functions.text import short_hash, trim_all
from shelfspark.functions.values import as_list, at, parse, to_text
from shelfspark.operators.hierarchy import ROOT
from shelfspark.session import cut_lineage

SITEMAP_ENTRY = "loc string"
URL_TOKEN = r"https?://[^\s<>\"']+"


def flatten_tree(docs: DataFrame, json_col: str = "value", place: str | None = None) -> DataFrame:
    """Nested [{name, children}] of any depth to (id, name, parent_id); roots hang below '0'.

    The id is a hash of the node's place (and of the document's `place`
    column, where there are several), so a rerun gives the same ids. One
    explode per level until no children are left.
    """
    document = F.concat(F.col(place).cast("string"), F.lit("/")) if place else F.lit("")
    level = docs.select(document.alias("_document"), F.posexplode(as_list(parse(json_col))).alias("at", "node"))
    level = level.select(F.lit(ROOT).alias("parent_id"), F.concat("_document", F.col("at").cast("string")).alias("place"), "node")
    found = None
    while True:
        rows = level.select(
            short_hash("place").alias("id"), to_text(at(F.col("node"), "name")).alias("name"), "parent_id", "place", at(F.col("node"), "children").alias("children")
        )
        rows = cut_lineage(rows)
        if rows.isEmpty():
            return found if found is not None else rows.select("id", "name", "parent_id")
        here = rows.select("id", "name", "parent_id")
        found = here if found is None else found.unionByName(here)
        level = rows.select(F.col("id").alias("parent_id"), F.col("place").alias("_up"), F.posexplode(as_list(F.col("children"))).alias("at", "node")).select(
            "parent_id", F.concat("_up", F.lit("."), F.col("at").cast("string")).alias("place"), "node"
        )


def read_category_seed(spark: SparkSession, path: str) -> DataFrame:
    return flatten_tree(spark.read.text(path, wholetext=True))


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """(kind, url): child sitemaps and page URLs of XML sitemap files, gzip included."""

    def entries(tag: str, kind: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).schema(SITEMAP_ENTRY).load(path)
        return rows.select(F.lit(kind).alias("kind"), trim_all("loc").alias("url")).where(F.col("url") != "")

    return entries("sitemap", "sitemap").unionByName(entries("url", "page"))


def read_url_texts(spark: SparkSession, path: str) -> DataFrame:
    """Fallback for files that are no XML: every http(s) token of the text."""
    text = spark.read.text(path)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(URL_TOKEN), F.lit(0))).alias("url")).distinct()
