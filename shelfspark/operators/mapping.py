"""Record fields to catalog products by mapping rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import clean_array, or_empty, short_hash, split_clean, trim_all
from shelfspark.functions.values import as_list, at, flatten, is_branch, kind, leaf_text, let, parse, texts, to_text
from shelfspark.operators.merge import upsert_imported, upsert_source
from shelfspark.session import cut_lineage
from shelfspark.sources.records import quarantine_rows

# Fields a mapping may fill.
SOURCE_TARGETS = [
    "guidNom", "guid", "nomcode", "barcode", "isbn", "name", "annotation", "authorCover", "authorNames", "coverUrl",
    "subjectName", "nicheName", "brandName", "serieName", "publisher", "pages", "format", "paperType", "bindingType",
    "ageRestriction", "price",
]
MAIN_TARGETS = [
    "sourceGuidNom", "sourceGuid", "sourceNomcode", "barcode", "isbn", "name", "annotation", "authorCover", "authorNames",
    "coverUrl", "subjectName", "nicheName", "brandName", "seriesName", "publisherName", "ageRestriction", "quantity",
    "price", "categoryPath", "categoryId",
]
TARGET_ALIASES = {
    "barcode": ["barcode", "gtin", "gtin13", "gtin14", "sku", "isbn"],
    "nomcode": ["nomcode", "barcode", "gtin", "sku"],
    "isbn": ["isbn", "gtin", "gtin13"],
    "name": ["name", "title"],
    "annotation": ["annotation", "description"],
    "coverUrl": ["cover", "image", "coverurl"],
    "price": ["price", "offers.price"],
}
SOURCE_PREFIX, MAIN_PREFIX = "source.", "main."
SYNTHETIC_PREFIX = "source"


@dataclass(frozen=True)
class Rule:
    source: str = ""
    constant: str = ""


def apply_rules(df: DataFrame, rules: dict[str, Rule], prefix: str, data: str = "data", out: str = "mapped") -> DataFrame:
    """Add map<field, variant>: a non-blank constant, else the record's source field where present."""
    doc = F.try_variant_get(parse(data), "$", "map<string,variant>")
    entries = []
    for target, rule in rules.items():
        name = target.removeprefix(prefix).strip()
        if not target.startswith(prefix) or not name:
            continue
        if rule.constant.strip():
            value = at(parse(F.to_json(F.struct(F.lit(rule.constant.strip()).alias("c")))), "c")
            entries.append(F.struct(F.lit(name).alias("key"), value.alias("value")))
        elif rule.source.strip():
            source = F.lit(rule.source.strip())
            found = F.struct(F.lit(name).alias("key"), F.element_at(doc, source).alias("value"))
            entries.append(F.when(F.map_contains_key(doc, source), found))
    listed = F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else F.array().cast("array<struct<key:string,value:variant>>")
    return df.withColumn(out, F.map_from_entries(listed))


def _names(v: Column) -> Column:
    """List of texts: array members, or one text cut at its first separator kind."""

    def cut(text: Column) -> Column:
        return (
            F.when(text.contains(","), split_clean(text, ","))
            .when(text.contains(";"), split_clean(text, ";"))
            .when(text.contains("|"), split_clean(text, r"\|"))
            .when(text != "", F.array(text))
        )

    def body(x: Column) -> Column:
        members = clean_array(F.transform(as_list(x), to_text))
        return F.when(kind(x) == "ARRAY", members).otherwise(let(to_text(x), cut))

    return let(v, body)


def _path(text: Column) -> Column:
    cuts = [F.when(text.contains(s), F.split(text, p)) for s, p in ((">", ">"), ("|", r"\|"), ("/", "/"), (",", ","))]
    parts = F.filter(F.transform(F.coalesce(*cuts, F.array(text)), trim_all), lambda p: p != "")
    return F.when(F.size(parts) > 0, parts)


def _staged(df: DataFrame, mapped: str, data: str) -> DataFrame:
    """Mapped values and raw fields as text maps, each read once per record."""
    return df.withColumns(
        {
            "_m": F.transform_values(mapped, lambda _, v: to_text(v)),
            "_raw": texts(parse(data)),
            "_authors": _names(F.element_at(F.col(mapped), F.lit("authorNames"))),
            "_tags": _names(F.element_at(F.col(mapped), F.lit("tagNames"))),
            "_genres": _names(F.element_at(F.col(mapped), F.lit("genreNames"))),
        }
    )


def _m(name: str) -> Column:
    return or_empty(F.element_at("_m", F.lit(name)))


def _raw(name: str) -> Column:
    return or_empty(F.element_at("_raw", F.lit(name)))


def _pick(*cs: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def _number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def build_source(df: DataFrame, mapped: str = "mapped", data: str = "data") -> DataFrame:
    """Publisher rows from mapped records: `valid` says whether a name was found.

    A record without any identifier gets one from its URL, title, ISBN or
    GTIN, or from the whole record when all of those are blank.
    """
    staged = _staged(df, mapped, data)
    nomcode = _pick(_m("nomcode"), _m("barcode"))
    seed = F.coalesce(F.nullif(_pick(_raw("source_url"), _raw("title"), _raw("isbn"), _raw("gtin")), F.lit("")), F.col(data))
    no_id = F.concat(_m("guidNom"), _m("guid"), nomcode) == ""
    return staged.select(
        *df.columns,
        F.when(no_id, F.concat(F.lit(SYNTHETIC_PREFIX + "-"), short_hash(seed))).otherwise(_m("guidNom")).alias("guid_nom"),
        _m("guid").alias("guid"),
        nomcode.alias("nomcode"),
        _pick(_m("isbn"), _raw("isbn"), _raw("gtin")).alias("isbn"),
        _pick(_m("name"), _raw("title")).alias("name"),
        _m("authorCover").alias("author_cover"),
        _pick(_m("annotation"), _raw("description")).alias("annotation"),
        _pick(_m("coverUrl"), _raw("image")).alias("cover_url"),
        _m("ageRestriction").alias("age_restriction"),
        _m("format").alias("format"),
        _m("paperType").alias("paper_type"),
        _m("bindingType").alias("binding_type"),
        _m("subjectName").alias("subject_name"),
        _m("brandName").alias("brand_name"),
        _m("serieName").alias("serie_name"),
        _m("publisher").alias("publisher_name"),
        F.col("_authors").alias("author_names"),
        F.col("_tags").alias("tag_names"),
        F.col("_genres").alias("genre_names"),
        F.coalesce(F.regexp_replace(_m("pages"), "[^0-9]", "").try_cast("int"), F.lit(0)).alias("pages"),
        _number(_pick(_m("price"), _raw("price"))).alias("raw_price"),
        (_pick(_m("name"), _raw("title")) != "").alias("valid"),
    )


def build_main(source_rows: DataFrame, mapped: str = "main_mapped", data: str = "data") -> DataFrame:
    """Main-catalog rows: the mapped value, then the publisher row's, then the raw field."""
    staged = _staged(source_rows, mapped, data)

    def own(c: str) -> Column:
        return or_empty(c)

    return staged.select(
        *[c for c in ("record_id", "run_id", "source_url", "created_at", data) if c in source_rows.columns],
        _pick(_m("sourceGuidNom"), own("guid_nom")).alias("source_guid_nom"),
        _pick(_m("sourceGuid"), own("guid")).alias("source_guid"),
        _pick(_m("sourceNomcode"), _m("barcode"), own("nomcode")).alias("source_nomcode"),
        _pick(_m("isbn"), own("isbn"), _raw("isbn"), _raw("gtin")).alias("isbn"),
        _pick(_m("name"), own("name"), _raw("title")).alias("name"),
        _pick(_m("authorCover"), own("author_cover")).alias("author_cover"),
        F.coalesce("_authors", "author_names").alias("author_names"),
        _pick(_m("annotation"), own("annotation"), _raw("description")).alias("annotation"),
        _pick(_m("coverUrl"), own("cover_url"), _raw("image")).alias("cover_url"),
        _pick(_m("ageRestriction"), own("age_restriction")).alias("age_restriction"),
        _pick(_m("subjectName"), own("subject_name")).alias("subject_name"),
        _m("nicheName").alias("niche_name"),
        _pick(_m("brandName"), own("brand_name")).alias("brand_name"),
        _pick(_m("seriesName"), own("serie_name")).alias("series_name"),
        _pick(_m("publisherName"), own("publisher_name")).alias("publisher_name"),
        let(_m("categoryPath"), _path).alias("category_path"),
        F.coalesce(_number(_m("quantity")), F.lit(0.0)).alias("quantity"),
        F.coalesce(_number(_pick(_m("price"), _raw("price"))), F.lit(0.0)).alias("price"),
        F.when(_m("categoryId").rlike("^[0-9a-fA-F]{24}$"), _m("categoryId")).alias("category_id"),
        (_pick(_m("name"), own("name"), _raw("title")) != "").alias("valid"),
    )


def map_records(records: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    """Records with both rule outputs and the publisher-side columns."""
    both = apply_rules(apply_rules(records, rules, SOURCE_PREFIX), rules, MAIN_PREFIX, out="main_mapped")
    return build_source(both)


def sync_run(
    records: DataFrame,
    runs: DataFrame,
    rules: dict[str, Rule],
    source: DataFrame,
    main: DataFrame,
    order: Sequence[str],
    as_of: Column,
) -> dict[str, DataFrame]:
    """Records of finished runs mapped once and merged into both catalogs.

    Returns source, main (both with _action), quarantine and counters. Rows
    with no name on either side go to quarantine.
    """
    finished = runs.where("status = 'finished'").select("run_id")
    usable = records.join(finished, "run_id", "left_semi")
    # three sinks read the mapped rows, so they are computed once; VARIANT maps stay out of the checkpoint
    mapped = map_records(usable, rules)
    mains = cut_lineage(build_main(mapped))
    mapped = cut_lineage(mapped.drop("mapped", "main_mapped"))
    invalid = mapped.where(~F.col("valid")).withColumn("reason", F.lit("mapped product has no name"))
    batch = mapped.where("valid").withColumns({"updated_at": as_of})
    next_source = upsert_source(source, batch.drop("valid", "data"), order)
    incoming = mains.where("valid").withColumns({"id": F.lit(None).cast(main.schema["id"].dataType), "source_product_id": F.lit(None).cast("string")})
    next_main, skipped = upsert_imported(main, incoming.drop("valid", "data"), order, as_of)
    actions = (
        next_source.select(F.lit("source").alias("target"), "_action")
        .unionByName(next_main.select(F.lit("main").alias("target"), "_action"))
        .unionByName(invalid.select(F.lit("source").alias("target"), F.lit("invalid").alias("_action")))
        .unionByName(skipped.select(F.lit("main").alias("target"), F.lit("skipped").alias("_action")))
    )
    counters = actions.groupBy("target").agg(
        *[F.sum(F.when(F.col("_action") == a, 1).otherwise(0)).alias(a) for a in ("inserted", "updated", "skipped", "invalid")]
    )
    return {
        "source": next_source,
        "main": next_main,
        "quarantine": quarantine_rows(invalid, "mapping", "data"),
        "counters": counters,
    }


def _squeeze(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def suggest_mapping(fields: DataFrame, targets: Sequence[str], loose: bool = False) -> DataFrame:
    """(target, source): for each target the first alias a field equals, else ends with (or contains, if loose).

    `fields` is the detected field list in its order (field, position). The
    targets and aliases are constants, so each field row finds its own aliases
    and one min per target picks the winner: no pairing of tables.
    """
    named = fields.select("field", "position", _squeeze(F.col("field")).alias("key"))
    tries = []
    for target in targets:
        field_name = target.split(".", 1)[1]
        for rank, alias in enumerate(TARGET_ALIASES.get(field_name, [field_name])):
            squeezed = "".join(ch for ch in alias.lower() if ch.isascii() and ch.isalnum())
            partial = F.col("key").contains(squeezed) if loose else F.col("key").endswith(squeezed)
            # an exact key beats a partial one of the same alias, a later field beats an earlier one of equal key
            quality = F.when(F.col("key") == squeezed, 0).when(partial, 1)
            place = F.when(F.col("key") == squeezed, -F.col("position")).otherwise(F.col("position"))
            tries.append(
                F.when(
                    quality.isNotNull(),
                    F.struct(F.lit(target).alias("target"), F.lit(rank).alias("rank"), quality.alias("quality"), place.alias("place"), F.col("field").alias("source")),
                )
            )
    hits = named.select(F.inline(F.filter(F.array(*tries), lambda h: h.isNotNull())))
    best = hits.groupBy("target").agg(F.min(F.struct("rank", "quality", "place", "source")).alias("best"))
    return best.select("target", F.col("best.source").alias("source"))


def flatten_records(df: DataFrame, data: str = "data", depth: int = 3) -> DataFrame:
    """Record data as map<dotted key, text>."""
    return df.withColumn("flat", flatten(parse(data), depth))


def flatten_rows(df: DataFrame, node: str, keys: Sequence[str], depth: int = 3) -> DataFrame:
    """(keys..., path, text, place): one row per leaf of a VARIANT column, what `flatten` puts into a map.

    Each level is one lateral `variant_explode_outer`: an object or a list that holds objects is replaced by its members,
    any other value passes as it is. A branch below `depth` stays as JSON text. place holds the positions on the way,
    so it orders the leaves; of equal paths the one with the smallest place counts.
    """
    spark = df.sparkSession
    empty = F.array().cast("array<int>")
    level = df.select(*keys, F.col(node).alias("_node"), F.lit("").alias("path"), empty.alias("place"))
    for _ in range(depth):
        level = level.withColumn("_branch", is_branch(F.col("_node")))
        members = spark.tvf.variant_explode_outer(F.when(F.col("_branch"), F.col("_node")).outer())
        below = level.lateralJoin(members)
        name = F.coalesce(trim_all("key"), F.col("pos").cast("string"))
        within = F.when(F.col("path") == "", name).otherwise(F.concat("path", F.lit("."), name))
        # a branch without members gives one row of nulls, and a blank key hides what is below it
        level = below.where(~F.col("_branch") | (name != "")).select(
            *keys,
            F.when(F.col("_branch"), F.col("value")).otherwise(F.col("_node")).alias("_node"),
            F.when(F.col("_branch"), within).otherwise(F.col("path")).alias("path"),
            F.when(F.col("_branch"), F.concat("place", F.array("pos"))).otherwise(F.col("place")).alias("place"),
        )
    text = F.when(is_branch(F.col("_node")), F.to_json("_node")).otherwise(leaf_text(F.col("_node")))
    return level.where("path <> ''").select(*keys, "path", text.alias("text"), "place").where(F.col("text").isNotNull())
