"""Publisher items and reference entities, one JSON object per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfspark.functions.text import or_empty

_NAMED = "GUID string, NAME string"
ITEM_SCHEMA = (
    "GUID string, GUID_NOM string, NOMCODE string, NAME string, NAME_FOR_PRICE string, ISBN string, AUTHOR_COVER string,"
    " ANNOTACIA string, SUBJECT struct<GUID:string,NAME:string,OWNER_GUID:string>,"
    " NICHE struct<GUID:string,NAME:string,OWNER_GUID:string>, IZDAT_BRAND struct<GUID:string,NAME:string>,"
    " SERIE struct<GUID:string,NAME:string>, PUBLISHER struct<GUID:string,NAME:string>,"
    " AUTHOR array<struct<GUID:string,CODE:string,NAME:string,IS_PISATEL:string,IS_PEREVODCHIK:string,IS_HUDOJNIK:string>>,"
    " TAGS array<struct<GUID:string,NAME:string>>, GENRE array<struct<GUID:string,NAME:string>>,"
    " COVERS map<string,struct<LINK:string>>, PAGES string, FORMAT string, PAPER string, PEREPLET_TYPE string,"
    " VOZRASTNOE_OGRANICHENIE string"
)
ENTITY_SCHEMA = (
    "GUID string, CODE string, NAME string, FIRST_NAME string, SURNAME string, SECOND_NAME string, DATE_BIRTH string,"
    " DATE_DEATH string, IS_PISATEL string, IS_PEREVODCHIK string, IS_HUDOJNIK string, IS_NO_ACTIVE string, DESCRIPTION string,"
    " FLAGS struct<WRITER:string,TRANSLATOR:string,PAINTER:string,SPEAKER:string,REDACTOR:string,COMPILLER:string>,"
    " CATEGORY struct<GUID:string>, ORGANIZATION struct<GUID:string,NAME:string>"
)


def flag(c: Column) -> Column:
    """true, 1 and non-zero numbers."""
    return F.coalesce(F.lower(c) == "true", F.lit(False)) | F.coalesce(c.try_cast("double") != 0, F.lit(False))


def whole(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("int"), F.lit(0))


def _names(refs: str) -> Column:
    return F.filter(F.transform(refs, lambda r: r["NAME"]), lambda n: F.coalesce(n, F.lit("")) != "")


def _refs(refs: str, keep_unnamed: bool = False) -> Column:
    shaped = F.transform(refs, lambda r: F.struct(or_empty(r["GUID"]).alias("guid"), or_empty(r["NAME"]).alias("name")))
    return shaped if keep_unnamed else F.filter(shaped, lambda r: r["guid"] != "")


def source_items(df: DataFrame, json_col: str = "value") -> DataFrame:
    """Typed publisher rows out of item JSON; the item text itself stays in `raw`."""
    item = df.select(F.col(json_col).alias("raw"), F.from_json(json_col, ITEM_SCHEMA).alias("i")).select("raw", "i.*")
    authors = F.transform(
        "AUTHOR",
        lambda a: F.struct(
            or_empty(a["GUID"]).alias("guid"),
            or_empty(a["CODE"]).alias("code"),
            or_empty(a["NAME"]).alias("name"),
            flag(a["IS_PISATEL"]).alias("is_writer"),
            flag(a["IS_PEREVODCHIK"]).alias("is_translator"),
            flag(a["IS_HUDOJNIK"]).alias("is_artist"),
        ),
    )
    covers = F.transform_values(
        F.map_filter("COVERS", lambda _, v: F.coalesce(v["LINK"], F.lit("")) != ""), lambda _, v: v["LINK"]
    )
    return item.select(
        or_empty("GUID").alias("guid"),
        or_empty("GUID_NOM").alias("guid_nom"),
        or_empty("NOMCODE").alias("nomcode"),
        F.coalesce(F.nullif("NAME", F.lit("")), "NAME_FOR_PRICE", F.lit("")).alias("name"),
        or_empty("ISBN").alias("isbn"),
        or_empty("AUTHOR_COVER").alias("author_cover"),
        or_empty("ANNOTACIA").alias("annotation"),
        F.col("SUBJECT.GUID").alias("subject_guid"),
        F.col("SUBJECT.NAME").alias("subject_name"),
        F.col("SUBJECT.OWNER_GUID").alias("subject_owner_guid"),
        F.col("NICHE.GUID").alias("niche_guid"),
        F.col("NICHE.NAME").alias("niche_name"),
        F.col("NICHE.OWNER_GUID").alias("niche_owner_guid"),
        F.col("IZDAT_BRAND.GUID").alias("brand_guid"),
        F.col("IZDAT_BRAND.NAME").alias("brand_name"),
        F.col("SERIE.GUID").alias("serie_guid"),
        F.col("SERIE.NAME").alias("serie_name"),
        F.col("PUBLISHER.GUID").alias("publisher_guid"),
        F.col("PUBLISHER.NAME").alias("publisher_name"),
        F.filter(authors, lambda a: a["guid"] != "").alias("author_refs"),
        _names("AUTHOR").alias("author_names"),
        _refs("TAGS").alias("tag_refs"),
        _names("TAGS").alias("tag_names"),
        _refs("GENRE", keep_unnamed=True).alias("genre_refs"),
        _names("GENRE").alias("genre_names"),
        whole(F.col("PAGES")).alias("pages"),
        or_empty("FORMAT").alias("format"),
        or_empty("PAPER").alias("paper_type"),
        or_empty("PEREPLET_TYPE").alias("binding_type"),
        or_empty("VOZRASTNOE_OGRANICHENIE").alias("age_restriction"),
        or_empty(F.element_at("COVERS", F.lit("cover1"))["LINK"]).alias("cover_url"),
        F.when(F.size(covers) > 0, covers).alias("covers"),
        "raw",
    )


def read_source_items(spark: SparkSession, path: str) -> DataFrame:
    return source_items(spark.read.text(path))


def entities(df: DataFrame, kind: str, json_col: str = "value") -> DataFrame:
    """author, tag, series or publisher rows out of entity JSON."""
    e = df.select(F.from_json(json_col, ENTITY_SCHEMA).alias("e")).select("e.*")
    base = [or_empty(c).alias(c.lower()) for c in ("GUID", "CODE", "NAME")]
    if kind == "author":
        # a FLAGS object decides alone; without one three direct fields do
        def role(name: str, direct: str | None) -> Column:
            fallback = flag(F.col(direct)) if direct else F.lit(False)
            return F.when(F.col("FLAGS").isNotNull(), flag(F.col("FLAGS")[name])).otherwise(fallback)

        return e.select(
            *base,
            *[or_empty(c).alias(c.lower()) for c in ("FIRST_NAME", "SURNAME", "SECOND_NAME", "DATE_BIRTH", "DATE_DEATH")],
            role("WRITER", "IS_PISATEL").alias("is_writer"),
            role("TRANSLATOR", "IS_PEREVODCHIK").alias("is_translator"),
            role("PAINTER", "IS_HUDOJNIK").alias("is_artist"),
            role("SPEAKER", None).alias("is_speaker"),
            role("REDACTOR", None).alias("is_redactor"),
            role("COMPILLER", None).alias("is_compiler"),
        )
    if kind == "tag":
        return e.select(*base, (~flag(F.col("IS_NO_ACTIVE"))).alias("is_active"), or_empty(F.col("CATEGORY.GUID")).alias("category_guid"))
    if kind == "series":
        return e.select(
            *base,
            or_empty("DESCRIPTION").alias("description"),
            or_empty(F.col("ORGANIZATION.GUID")).alias("organization_guid"),
            or_empty(F.col("ORGANIZATION.NAME")).alias("organization_name"),
        )
    return e.select(*base)


def read_entities(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return entities(spark.read.text(path), kind)
