"""Products that share a normalized code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import first_non_empty, norm_code_unicode, trim_all
from shelfspark.operators.skew import HEAVY_ROWS, first_by, spread_join

MAIN_CODES = ["isbn_normalized", "isbn", "barcode", "code", "source_nomcode"]
SOURCE_CODES = ["isbn", "nomcode"]

# Fields compared in a duplicate report, each with its fallbacks.
GROUP_FIELDS = {
    "isbn": ["isbn", "isbn_normalized"],
    "code": ["code", "source_nomcode"],
    "barcode": ["barcode", "source_nomcode", "code"],
    "gtin": ["gtin"],
}


def _codes(columns: Sequence[str]) -> Column:
    normal = F.transform(F.array(*columns), lambda c: norm_code_unicode(trim_all(c)))
    return F.array_distinct(F.filter(normal, lambda c: c.isNotNull() & (c != "")))


def product_codes(df: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """(id, code) pairs, each code once per product."""
    return df.select(F.col(id_col).alias("id"), F.explode(_codes(columns)).alias("code"))


def shared_codes(pairs: DataFrame) -> DataFrame:
    """Codes on more than one product. Ids are unique, so a plain count pre-aggregates on the map side."""
    return pairs.groupBy("code").agg(F.count(F.lit(1)).alias("products")).where(F.col("products") > 1)


def duplicate_ids(df: DataFrame, columns: Sequence[str], id_col: str = "id", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    pairs = product_codes(df, columns, id_col)
    hits = spread_join(pairs, shared_codes(pairs), "code", ["id"], "left_semi", weight="products", heavy_rows=heavy_rows)
    return hits.select("id").distinct()


def duplicate_products(df: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Whole rows of every product that shares a code with another one."""
    ids = duplicate_ids(df, columns, id_col).withColumnRenamed("id", id_col)
    return df.join(ids, id_col, "left_semi")


def duplicate_summary(df: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """scanned / duplicate_groups / duplicate_products in one row."""
    pairs = product_codes(df, columns, id_col)
    parts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("scanned").alias("k"), "n"),
        shared_codes(pairs).agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_groups").alias("k"), "n"),
        duplicate_ids(df, columns, id_col).agg(F.count(F.lit(1)).alias("n")).select(F.lit("duplicate_products").alias("k"), "n"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("scanned", "duplicate_groups", "duplicate_products")])


def _field_entries() -> Column:
    """array<struct<code, field, raw>> of one product."""
    entries = []
    for name, columns in GROUP_FIELDS.items():
        raw = first_non_empty(*columns)
        entries.append(F.struct(norm_code_unicode(raw).alias("code"), F.lit(name).alias("field"), raw.alias("raw")))
    return F.filter(F.array(*entries), lambda e: e.code.isNotNull() & (e.code != ""))


def group_members(df: DataFrame) -> DataFrame:
    """(code, id, name, fields, raw): a product once per code with the fields that carried it."""
    entries = _field_entries()
    codes = F.array_distinct(F.transform(entries, lambda e: e.code))

    def member(code: Column) -> Column:
        mine = F.filter(entries, lambda e: e.code == code)
        return F.struct(
            code.alias("code"),
            F.array_sort(F.transform(mine, lambda e: e.field)).alias("fields"),
            mine[0].raw.alias("raw"),
        )

    return df.select("id", "name", F.inline(F.transform(codes, member)))


def duplicate_groups(df: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """One row per group member, flat: sort by group_size desc, code, name, id for the report.

    The group header (size, fields, raw value of the smallest id) is a partial
    aggregate; members are never gathered into one array, so a code shared by
    a third of the catalog stays spread over many tasks.
    """
    members = group_members(df)
    present = [
        F.max(F.array_contains("fields", f)).alias(f"_has_{f}") for f in sorted(GROUP_FIELDS)
    ]
    heads = (
        members.groupBy("code")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct("id", "raw")).alias("_first"), *present)
        .where(F.col("group_size") > 1)
        .select(
            "code",
            "group_size",
            F.col("_first.raw").alias("raw_value"),
            F.concat_ws(",", *[F.when(F.col(f"_has_{f}"), F.lit(f)) for f in sorted(GROUP_FIELDS)]).alias("group_fields"),
        )
    )
    flat = members.select("code", "id", "name", F.array_join("fields", ",").alias("fields"))
    return spread_join(flat, heads, "code", ["id"], "inner", weight="group_size", heavy_rows=heavy_rows)


def deletable_duplicates(groups: DataFrame) -> DataFrame:
    """Every grouped product except those that come first, by name then id, in some group."""
    firsts = first_by(groups.select("code", "name", "id"), ["code"], [F.asc("name"), F.asc("id")]).select("id").distinct()
    return groups.select("id").distinct().join(firsts, "id", "left_anti")
