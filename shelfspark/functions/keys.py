"""Stable identity of catalog rows across feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import non_blank, norm_code_ascii, or_empty

SOURCE_KEY = [("guidNom", "guid_nom"), ("guid", "guid"), ("nomcode", "nomcode")]
SOURCE_KEY_IN_MAIN = SOURCE_KEY + [("id", "id")]
MAIN_KEY = [
    ("guidNom", "source_guid_nom"),
    ("guid", "source_guid"),
    ("nomcode", "source_nomcode"),
    ("id", "source_product_id"),
]


def stable_key(parts: Sequence[tuple[str, str]]) -> Column:
    """First present identifier with its kind in front; none gives null."""
    return F.coalesce(*[F.concat(F.lit(kind + ":"), F.nullif(F.col(c), F.lit(""))) for kind, c in parts])


def source_key() -> Column:
    return stable_key(SOURCE_KEY)


def source_key_with_id() -> Column:
    return stable_key(SOURCE_KEY_IN_MAIN)


def main_key() -> Column:
    return stable_key(MAIN_KEY)


def book_key() -> Column:
    both = (or_empty("isbn_normalized") != "") & (or_empty("name") != "")
    return F.when(both, F.concat(F.lit("isbn+name:"), "isbn_normalized", F.lit(":"), "name"))


def own_key(id_col: str = "id") -> Column:
    return F.concat(F.lit("own:"), F.nullif(F.col(id_col).cast("string"), F.lit("")))


def import_key() -> Column:
    """Key an imported row is looked up by: own id, source ids, then ISBN with name."""
    return F.coalesce(own_key(), main_key(), book_key())


def identities(parts: Sequence[tuple[str, str]], *extra: Column) -> Column:
    """Every key a stored row answers to, not only its first."""
    keys = [F.concat(F.lit(kind + ":"), F.nullif(F.col(c), F.lit(""))) for kind, c in parts]
    return F.filter(F.array(*keys, *extra), lambda k: k.isNotNull())


def catalog_code() -> Column:
    """Stored normalized ISBN, else the one computed from the ISBN; blank gives null."""
    return F.coalesce(non_blank("isbn_normalized"), F.nullif(norm_code_ascii("isbn"), F.lit("")))
