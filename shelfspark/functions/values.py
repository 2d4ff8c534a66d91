"""Reading loosely typed JSON values (VARIANT columns) as text, numbers and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from shelfspark.functions.numbers import positive
from shelfspark.functions.text import non_blank, trim_all

# Where a publisher item keeps its price, in order of trust.
PRICE_KEYS = ["COST", "PRICE", "RETAIL_PRICE", "BASE_PRICE", "PRICE_RUB"]
NESTED_PRICE_KEYS = ["COST", "PRICE", "RETAIL", "BASE"]
TYPED_PRICE_KEYS = ["PRICE", "COST", "VALUE", "SUM"]


def parse(c: Column | str) -> Column:
    """Text to VARIANT; malformed text gives null."""
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)


def let(v: Column, body: Callable[[Column], Column]) -> Column:
    """body(v) with `v` computed once: the plan names the value and does not repeat its expression."""
    return F.get(F.transform(F.array(v), body), F.lit(0))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type; no value gives null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def as_map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def at(v: Column, key: str) -> Column:
    """Member of an object by its literal name."""
    return F.try_variant_get(v, f'$["{key}"]', "variant")


def _scalar_text(v: Column) -> Column:
    """Text of one scalar: trimmed strings, whole numbers without a fraction."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(F.schema_of_variant(v) == "STRING", trim_all(text)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def _flat_text(v: Column) -> Column:
    """Text of a scalar, or the name (else the @id) of an object."""
    named = F.coalesce(non_blank(F.try_variant_get(v, "$.name", "string")), non_blank(F.try_variant_get(v, '$["@id"]', "string")))
    return F.coalesce(F.when(kind(v) == "OBJECT", named).otherwise(_scalar_text(v)), F.lit(""))


def to_text(v: Column) -> Column:
    """One text for any value: arrays join their non-blank members with a comma; no value gives ''."""

    def body(x: Column) -> Column:
        members = F.array_join(F.filter(F.transform(as_list(x), _flat_text), lambda t: t != ""), ", ")
        return F.coalesce(members, _flat_text(x))

    return let(v, body)


def to_number(v: Column) -> Column:
    """Number of a numeric value or of plain numeric text, comma or dot."""
    text = F.trim(F.replace(F.try_variant_get(v, "$", "string"), F.lit(","), F.lit(".")))
    return text.try_cast("double")


def texts(doc: Column) -> Column:
    """Object to map<key, text>, each value read once."""
    return F.transform_values(as_map(doc), lambda _, v: to_text(v))


def source_price(raw: Column) -> Column:
    """First positive price of a publisher item: top keys, PRICES keys, then PRICES.TYPES[]."""

    def priced(v: Column, keys: list[str]) -> list[Column]:
        return [positive(to_number(at(v, k))) for k in keys]

    prices = at(raw, "PRICES")

    def typed(item: Column) -> Column:
        by_name = F.filter(
            F.transform(
                F.filter(
                    F.array_sort(F.map_keys(as_map(item))), lambda k: F.lower(trim_all(k)).rlike("price|cost|sum")
                ),
                lambda k: positive(to_number(F.element_at(as_map(item), k))),
            ),
            lambda p: p.isNotNull(),
        )
        return F.coalesce(*priced(item, TYPED_PRICE_KEYS), F.get(by_name, F.lit(0)))

    types = F.filter(F.transform(as_list(at(prices, "TYPES")), typed), lambda p: p.isNotNull())
    return F.coalesce(*priced(raw, PRICE_KEYS), *priced(prices, NESTED_PRICE_KEYS), F.get(types, F.lit(0)))


def flatten(v: Column, depth: int = 3) -> Column:
    """Nested object to map<dotted key, text>; what lies below the depth stays as JSON text under its key.

    Arrays of scalars become one joined text, arrays holding objects get
    their index as a key part. Built as nested higher-order functions, so a
    row is flattened in place and nothing is exploded or shuffled.
    """
    return map_of(_leaves(v, F.lit(""), depth))


def first_of_equals(items: Column, key: Callable[[Column], Column]) -> Column:
    """Array without later members of an equal key."""

    def body(xs: Column) -> Column:
        return let(
            F.transform(xs, key),
            lambda keys: F.filter(
                F.transform(xs, lambda x, i: F.when(F.array_position(keys, F.element_at(keys, i + 1)) == i + 1, x)),
                lambda x: x.isNotNull(),
            ),
        )

    return let(items, body)


def map_of(entries: Column) -> Column:
    """Map of (key, value) structs; the first of equal keys stays."""
    return F.map_from_entries(first_of_equals(entries, lambda e: e["key"]))


def merge_missing(a: Column, b: Column) -> Column:
    """Fields of `a`, blank or absent ones filled from `b`."""
    return F.map_zip_with(a, F.coalesce(b, F.create_map().cast("map<string,string>")), lambda _, x, y: F.coalesce(F.nullif(trim_all(x), F.lit("")), y, x))


def _joined(prefix: Column, key: Column) -> Column:
    return F.when(prefix == "", key).otherwise(F.concat(prefix, F.lit("."), key))


_LEAF = "array<struct<key:string,value:string>>"


def _leaf(prefix: Column, text: Column) -> Column:
    return F.array(F.struct(prefix.alias("key"), text.alias("value"))).cast(_LEAF)


def is_branch(v: Column) -> Column:
    """An object, or a list that holds an object, a list or a null."""
    mixed = F.exists(as_list(v), lambda m: kind(m).isin("OBJECT", "ARRAY", "VOID"))
    return F.coalesce(F.when(kind(v) == "OBJECT", True).otherwise(mixed), F.lit(False))


def leaf_text(v: Column) -> Column:
    """Text of a scalar, '' for none; a list of scalars joins its texts, and gives null if there are none."""
    joined = F.array_join(F.filter(F.transform(as_list(v), _flat_text), lambda t: t != ""), ", ")
    return F.when(kind(v) == "ARRAY", F.nullif(joined, F.lit(""))).otherwise(F.coalesce(_scalar_text(v), F.lit("")))


def _leaves(v: Column, prefix: Column, depth: int) -> Column:
    """(key, text) leaves below one named value; objects and mixed arrays share one descent."""
    empty = F.array().cast(_LEAF)
    members = as_list(v)
    scalars = F.forall(members, lambda m: ~kind(m).isin("OBJECT", "ARRAY", "VOID"))
    joined = F.array_join(F.filter(F.transform(members, _flat_text), lambda t: t != ""), ", ")
    text = F.when(F.size(members) >= 0, F.when(scalars & (joined != ""), joined)).otherwise(F.coalesce(_scalar_text(v), F.lit("")))
    leaf = F.when((prefix != "") & text.isNotNull() & (kind(v) != "OBJECT"), _leaf(prefix, text)).otherwise(empty)
    if depth <= 0:
        rest = F.when((prefix != "") & ((kind(v) == "OBJECT") | ((F.size(members) > 0) & ~scalars)), _leaf(prefix, F.to_json(v)))
        return F.coalesce(rest, leaf)
    children = F.when(
        kind(v) == "OBJECT",
        F.transform(F.map_entries(as_map(v)), lambda e: F.struct(trim_all(e["key"]).alias("key"), e["value"].alias("value"))),
    ).when((F.size(members) > 0) & ~scalars, F.transform(members, lambda m, i: F.struct(i.cast("string").alias("key"), m.alias("value"))))
    below = F.flatten(
        F.transform(
            F.filter(children, lambda e: e["key"] != ""),
            lambda e: _leaves(e["value"], _joined(prefix, e["key"]), depth - 1),
        )
    )
    return F.coalesce(below, leaf)
