"""Lenient number, flag and price parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import TRUE_WORDS, col, trim_all


def parse_locale_float(c: Column | str) -> Column:
    """Decimal text in either convention; text that is no number gives 0.

    Both marks present: the rightmost is the decimal one. A lone comma with
    exactly three digits behind it groups thousands, otherwise it is decimal.
    """
    value = F.regexp_replace(F.regexp_replace(trim_all(c), "^\\x{FEFF}", ""), r"[ \x{A0}]", "")
    last_comma = F.length(value) - F.instr(F.reverse(value), ",")
    last_dot = F.length(value) - F.instr(F.reverse(value), ".")
    has_comma, has_dot = value.contains(","), value.contains(".")
    no_commas = F.replace(value, F.lit(","), F.lit(""))
    comma_as_dot = F.replace(value, F.lit(","), F.lit("."))
    both = F.when(last_comma > last_dot, F.replace(F.replace(value, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(no_commas)
    lone = F.when(value.rlike("^[^,]+,[^,]{3}$") | value.rlike(",.*,"), no_commas).otherwise(comma_as_dot)
    plain = F.when(has_comma & has_dot, both).when(has_comma, lone).otherwise(value)
    number = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def parse_price_text(c: Column | str) -> Column:
    """Price out of display text: keep digits and marks, the last mark is decimal."""
    kept = F.regexp_replace(col(c), "[^0-9.,]", "")
    last_comma = F.length(kept) - F.instr(F.reverse(kept), ",")
    last_dot = F.length(kept) - F.instr(F.reverse(kept), ".")
    has_comma, has_dot = kept.contains(","), kept.contains(".")
    plain = (
        F.when(
            has_comma & has_dot,
            F.when(last_comma > last_dot, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .otherwise(F.replace(kept, F.lit(","), F.lit(""))),
        )
        .when(has_comma, F.replace(kept, F.lit(","), F.lit(".")))
        .otherwise(kept)
    )
    return F.when(plain.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), plain.try_cast("double"))


def parse_int(c: Column | str) -> Column:
    """Whole part of a positive number, else 0."""
    number = parse_locale_float(c)
    return F.when(number > 0, number.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def parse_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(trim_all(c)).isin(*TRUE_WORDS), F.lit(False))


def digits_to_int(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "[^0-9]", "").try_cast("bigint")


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def float_eq(a: Column | str, b: Column | str, eps: float = 1e-6) -> Column:
    return F.abs(col(a) - col(b)) < F.lit(eps)


def number_text(c: Column | str) -> Column:
    """Shortest text of a double: whole numbers lose the trailing .0."""
    value = col(c)
    whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
