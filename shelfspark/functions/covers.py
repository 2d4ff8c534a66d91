"""Cover maps and entity references of a product row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import clean_array, col, non_blank, trim_all


def _cover_pairs(covers: Column) -> Column:
    pairs = F.transform(F.map_entries(covers), lambda e: F.struct(trim_all(e.key).alias("key"), trim_all(e.value).alias("url")))
    return F.array_sort(F.filter(pairs, lambda p: (p.key != "") & (p.url != "")))


def sanitize_covers(covers: Column | str, cover_url: Column | str | None = None) -> Column:
    """Cover URLs by key order without repeats, renumbered manual_1..n; the main cover joins at the end."""
    urls = F.array_distinct(F.transform(_cover_pairs(col(covers)), lambda p: p.url))
    urls = F.coalesce(urls, F.array().cast("array<string>"))
    if cover_url is not None:
        main = non_blank(cover_url)
        urls = F.when(main.isNotNull() & ~F.array_contains(urls, F.coalesce(main, F.lit(""))), F.concat(urls, F.array(main))).otherwise(urls)
    keys = F.transform(urls, lambda _, i: F.concat(F.lit("manual_"), (i + 1).cast("string")))
    return F.when(F.size(urls) > 0, F.map_from_arrays(keys, urls))


def first_cover(cover_url: Column | str, covers: Column | str) -> Column:
    """Main cover, else the first non-blank of the map by key order; none gives ''."""
    ordered = F.array_sort(F.map_entries(col(covers)))
    urls = F.filter(F.transform(ordered, lambda e: trim_all(e.value)), lambda u: u != "")
    return F.coalesce(non_blank(cover_url), F.get(urls, F.lit(0)), F.lit(""))


def sanitize_refs(refs: Column | str, fields: list[str]) -> Column:
    """Trim the text fields of reference structs and drop entries with none left."""
    trimmed = F.transform(
        col(refs),
        lambda r: F.struct(*[F.coalesce(trim_all(r[f]), F.lit("")).alias(f) for f in fields]),
    )

    def filled(r: Column) -> Column:
        return F.concat(*[r[f] for f in fields]) != ""

    kept = F.filter(trimmed, filled)
    return F.when(F.size(kept) > 0, kept)


def names_from_refs(names: Column | str, refs: Column | str) -> Column:
    """Given names, else the names inside the references."""
    return F.coalesce(clean_array(names), clean_array(F.transform(col(refs), lambda r: r["name"])))


def refs_from_names(refs: Column | str, names: Column | str) -> Column:
    """Given references, else name-only references built from the names."""
    built = F.transform(clean_array(names), lambda n: F.struct(F.lit("").alias("guid"), n.alias("name")))
    given = F.transform(col(refs), lambda r: F.struct(F.coalesce(r["guid"], F.lit("")).alias("guid"), r["name"].alias("name")))
    return F.when(F.size(given) > 0, given).otherwise(built)


def covers_from_links(links: Column) -> Column:
    """List of cover links to the manual_1..n map."""
    urls = clean_array(links)
    return F.map_from_arrays(F.transform(urls, lambda _, i: F.concat(F.lit("manual_"), (i + 1).cast("string"))), urls)
