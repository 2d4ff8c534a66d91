"""Catalog tables as CSV: tolerant reading by header aliases, fixed 43-column writing."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.functions.covers import covers_from_links
from shelfspark.functions.numbers import number_text, parse_bool, parse_int, parse_locale_float
from shelfspark.functions.text import (
    non_blank,
    norm_size,
    or_empty,
    primary_link,
    split_links,
    split_list,
    split_path,
    trim_all,
)
from shelfspark.session import written
from shelfspark.sources.quoted import read_quoted_records

# Column order of a catalog file.
COLUMNS = [
    "id", "name", "isbn", "author_cover", "author_names", "tag_names", "genre_names", "is_info_complete", "description",
    "annotation", "cover_url", "cover_urls", "age_restriction", "pages", "format", "paper_type", "binding_type",
    "characteristics", "board_game_type", "product_type", "target_audience", "min_players", "max_players",
    "min_game_duration_minutes", "max_game_duration_minutes", "material", "subject_name", "niche_name", "brand_name",
    "series_name", "publication_year", "product_weight", "publisher_name", "ikpu", "size", "quantity", "price",
    "category_id", "category_path", "source_guid_nom", "source_guid", "source_nomcode", "source_product_id",
]

# Headings, reduced to letters, that name a column besides its own name.
ALIASES = {
    "name": ["title", "productname", "названиетовара", "наименованиетовара", "товар", "название"],
    "isbn": ["isbn13"],
    "author_cover": ["авторнаобложке", "авторы"],
    "author": ["автор", "author"],
    "author_names": ["authors"],
    "tag_names": ["tags", "теги"],
    "genre_names": ["genres", "жанры"],
    "is_info_complete": ["infocomplete", "fullinfo", "isfullinfo", "полнаяинформация", "инфополная", "полнотаинформации"],
    "description": ["описание"],
    "short_description": ["краткоеописание", "короткоеописание", "shortdescription"],
    "cover_url": [
        "image", "imageurl", "фотоилиссылкинафото", "фото", "ссылканафото", "ссылкинафото", "изображение",
        "photophotolinks", "photo", "photolinks",
    ],
    "cover_urls": [
        "covers", "imagelinks", "coverlinks", "ссылкинаобложки", "ссылкинаизображения", "всеобложки", "всеизображения",
    ],
    "age_restriction": ["age", "возрастноеограничение", "возврастноеограничение"],
    "pages": ["pagecount", "страницы", "количествостраниц"],
    "format": ["формат"],
    "paper_type": ["paper", "типбумаги", "бумага"],
    "binding_type": ["binding", "типпереплета", "переплет"],
    "characteristics": ["характеристики", "характеристика"],
    "board_game_type": ["виднастольнойигры"],
    "product_type": ["type", "тип"],
    "target_audience": ["целеваяаудитория"],
    "min_players": ["минимальноечислоигроков"],
    "max_players": ["максимальноечислоигроков"],
    "min_game_duration_minutes": ["минимальнаяпродолжительностьпартиимин", "минимальнаядлительностьпартиимин"],
    "max_game_duration_minutes": ["максимальнаяпродолжительностьпартиимин", "максимальнаядлительностьпартиимин"],
    "material": ["материал"],
    "subject_name": ["subject"],
    "category": ["категория"],
    "niche_name": ["niche"],
    "subcategory": ["подкатегория", "subcategory"],
    "brand_name": ["brand", "бренд"],
    "series_name": ["serie", "series", "серия"],
    "publication_year": ["yearofpublication", "годиздания"],
    "product_weight": ["weight", "вестовара", "вес"],
    "publisher_name": ["publisher", "издатель", "издательство"],
    "ikpu": ["икпу"],
    "size": ["размер"],
    "size_width": ["sizewidth", "width", "ширина"],
    "size_height": ["sizeheight", "height", "высота"],
    "quantity": ["qty", "количество", "остаток"],
    "price": ["cost", "цена", "стоимость"],
    "category_path": ["путькатегории"],
    "source_guid_nom": ["guidnom"],
    "source_guid": ["guid"],
    "source_nomcode": ["nomcode"],
}
BY_HEADING = {c.replace("_", ""): c for c in COLUMNS} | {a: c for c, names in ALIASES.items() for a in names}
OBJECT_ID = "^[0-9a-fA-F]{24}$"


def heading_key(text: str) -> str:
    """Heading reduced to its letters; runs on the header line alone."""
    bare = text.strip().removeprefix("\ufeff").lower()
    return "".join(ch for ch in bare if ch not in " -./\\:;()_")


def sniff_delimiter(header: str) -> str:
    line = header.removeprefix("\ufeff")
    commas, semicolons, tabs = line.count(","), line.count(";"), line.count("\t")
    if semicolons > commas and semicolons >= tabs:
        return ";"
    if tabs > commas and tabs > semicolons:
        return "\t"
    return ","


def _files(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(file, its first CSV record) of every data file under a path or pattern; the records' text is all that is read."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, out = list(fs.globStatus(place) or []), []
    while found:
        status = found.pop()
        name = status.getPath().getName()
        if status.isDirectory():
            found += [s for s in fs.listStatus(status.getPath()) if s.getPath().getName()[:1] not in ("_", ".")]
        elif name[:1] not in ("_", "."):
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(status.getPath()), "UTF-8"))
            record = reader.readLine()
            while record is not None and record.count('"') % 2 and (more := reader.readLine()) is not None:
                record += "\n" + more
            reader.close()
            if record is not None:
                out.append((status.getPath().toString(), record))
    return out


def headings(record: str, delimiter: str | None = None) -> tuple[str, tuple[str, ...]]:
    """Delimiter and cells of a heading record, by the CSV rules for quotes."""
    line = record.removeprefix("\ufeff")
    # delimiters inside quotes tell nothing
    sep = delimiter or sniff_delimiter("".join(line.split('"')[::2]))
    return sep, tuple(next(csv.reader([line], delimiter=sep), []))


def read_catalog_csv(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = True) -> DataFrame:
    """Catalog rows by header aliases: ragged rows allowed, blank and nameless rows dropped.

    Each file goes by its own heading; files that share one are read together.
    multi_line=False lets Spark split large files, where no cell holds a line
    break.
    """
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for name, record in _files(spark, path):
        groups.setdefault(headings(record, delimiter), []).append(name)
    parts = [_read_files(spark, sorted(names), sep, cells, multi_line) for (sep, cells), names in sorted(groups.items())]
    if not parts:
        return shape_rows(spark.createDataFrame([], "_c0 string"), {})
    return reduce(DataFrame.unionByName, parts)


def read_catalog_csv_split(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """The same rows, with large files split inside, line breaks in cells included.

    Headings are the first records of the files; only the different ones, a few layouts, come to the driver.
    """
    records = written(read_quoted_records(spark, path), "csv-records")
    heads = records.where("record = 0").select("file", F.col("text").alias("_head"))
    parts = []
    for (head,) in sorted(map(tuple, heads.select("_head").distinct().collect())):
        sep, cells = headings(head, delimiter)
        own = heads.where(F.col("_head") == head).select("file")
        schema = ", ".join(f"_c{i} string" for i in range(len(cells)))
        options = {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
        rows = records.where("record > 0").join(own, "file", "left_semi").select(F.from_csv("text", schema, options).alias("row")).select("row.*")
        parts.append(shape_rows(rows, _places(cells)))
    return reduce(DataFrame.unionByName, parts) if parts else shape_rows(spark.createDataFrame([], "_c0 string"), {})


def _places(cells: tuple[str, ...]) -> dict[str, str]:
    """The raw cell of each column that a heading names."""
    places: dict[str, str] = {}
    for i, text in enumerate(cells):
        name = BY_HEADING.get(heading_key(text))
        if name:
            places[name] = f"_c{i}"
        if heading_key(text) == "author":
            places["author_cover"] = f"_c{i}"
    return places


def _read_files(spark: SparkSession, paths: list[str], sep: str, cells: tuple[str, ...], multi_line: bool) -> DataFrame:
    raw = [f"_c{i}" for i in range(len(cells))]
    rows = (
        spark.read.option("sep", sep)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .schema(", ".join(f"{c} string" for c in raw))
        .csv(paths)
    )
    return shape_rows(rows, _places(cells))


def shape_rows(cells: DataFrame, places: dict[str, str]) -> DataFrame:
    """Raw cells to typed catalog rows; `places` maps a column to its cell."""

    def cell(name: str) -> Column:
        if name not in places:
            return F.lit("")
        return trim_all(F.regexp_replace(or_empty(places[name]), "^\\x{FEFF}", ""))

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(cell(n), F.lit("")) for n in names], F.lit(""))

    def object_id(name: str) -> Column:
        return F.when(cell(name).rlike(OBJECT_ID), F.lower(cell(name))).otherwise(F.lit(""))

    width, height = cell("size_width"), cell("size_height")
    sized = F.concat_ws("x", F.nullif(width, F.lit("")), F.nullif(height, F.lit("")))
    by_columns = F.concat_ws(" / ", F.nullif(cell("category"), F.lit("")), F.nullif(cell("subcategory"), F.lit("")))
    links = split_links(cell("cover_urls"))
    typed: dict[str, Column] = {
        "id": object_id("id"),
        "author_cover": first("author_cover", "author"),
        "author_names": split_list(first("author_names", "author")),
        "tag_names": split_list(cell("tag_names")),
        "genre_names": split_list(cell("genre_names")),
        "is_info_complete": parse_bool(cell("is_info_complete")),
        "description": first("description", "annotation", "short_description"),
        "annotation": first("annotation", "short_description", "description"),
        "cover_url": F.coalesce(F.nullif(primary_link(cell("cover_url")), F.lit("")), F.get(links, F.lit(0)), F.lit("")),
        "subject_name": first("subject_name", "category"),
        "niche_name": first("niche_name", "subcategory"),
        "size": norm_size(F.coalesce(F.nullif(cell("size"), F.lit("")), sized)),
        "quantity": parse_locale_float(cell("quantity")),
        "price": parse_locale_float(cell("price")),
        "category_id": object_id("category_id"),
        "category_path": split_path(F.coalesce(F.nullif(cell("category_path"), F.lit("")), by_columns)),
        "source_product_id": object_id("source_product_id"),
    }
    for c in ("pages", "min_players", "max_players", "min_game_duration_minutes", "max_game_duration_minutes", "publication_year"):
        typed[c] = parse_int(cell(c))
    columns = [typed.get(c, cell(c)).alias(c) for c in COLUMNS if c != "cover_urls"]
    rows = cells.select(*columns, covers_from_links(links).alias("covers"))
    return rows.where(F.col("name") != "")


def catalog_csv_rows(df: DataFrame) -> DataFrame:
    """The 43 text columns of a catalog file; columns the table lacks stay empty."""
    known = set(df.columns)
    none = F.array().cast("array<string>")
    covers = F.array_sort(F.map_entries("covers")) if "covers" in known else none
    main_cover = non_blank("cover_url") if "cover_url" in known else F.lit(None).cast("string")
    all_covers = F.concat(
        F.when(main_cover.isNotNull(), F.array(main_cover)).otherwise(none),
        F.coalesce(F.transform(covers, lambda e: trim_all(e["value"])), none) if "covers" in known else none,
    )
    whole = {"pages", "min_players", "max_players", "min_game_duration_minutes", "max_game_duration_minutes", "publication_year"}

    def text(name: str) -> Column:
        if name == "cover_urls":
            return F.array_join(F.array_distinct(F.filter(all_covers, lambda u: u != "")), " | ")
        if name not in known:
            return F.lit("0") if name == "is_info_complete" else F.lit("")
        c = F.col(name)
        if name in ("author_names", "tag_names", "genre_names"):
            return F.array_join(c, " | ")
        if name == "category_path":
            return F.array_join(c, " / ")
        if name == "is_info_complete":
            return F.when(c, "1").otherwise("0")
        if name in whole:
            return F.when(c > 0, c.cast("string")).otherwise("")
        if name in ("quantity", "price"):
            return F.when(c != 0, number_text(c)).otherwise("")
        if name in ("id", "category_id", "source_product_id"):
            shown = c.cast("string")
            return F.when(shown == "000000000000000000000000", "").otherwise(or_empty(shown))
        return or_empty(c.cast("string"))

    return df.select(*[or_empty(text(c)).alias(c) for c in COLUMNS])


def write_catalog_csv(df: DataFrame, path: str, newest_first: bool = True) -> None:
    """Filtered catalog as CSV part files, newest first across the files."""
    rows = df.orderBy(F.desc("updated_at"), F.asc("id")) if newest_first else df
    catalog_csv_rows(rows).write.mode("errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)
