"""Ranked search and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import trim_all
from shelfspark.operators.filters import MainFilter, main_condition, search_any_field

NOT_FOUND = 2147483647


def page_bounds(page: int, limit: int, default: int = 20) -> tuple[int, int]:
    """Page and page size as asked for; below 1 means the first page and the default size."""
    return max(page, 1), default if limit < 1 else limit


def paginate(df: DataFrame, order: Sequence[Column], page: int = 1, limit: int = 20) -> DataFrame:
    """One page in a total order. Offset and limit sit on the sort, so Spark keeps only page*limit rows per task."""
    page, size = page_bounds(page, limit)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def after_key(df: DataFrame, order_col: str, id_col: str, last: tuple[object, object] | None, limit: int) -> DataFrame:
    """Keyset page for deep scrolling: newest first, continuing behind the last row seen."""
    rest = df
    if last is not None:
        value, row_id = last
        rest = df.where((F.col(order_col) < value) | ((F.col(order_col) == value) & (F.col(id_col) > row_id)))
    return rest.orderBy(F.desc(order_col), id_col).limit(limit)


def page_totals(df: DataFrame, limit: int = 20) -> DataFrame:
    """Row total and number of pages of a filtered set."""
    _, size = page_bounds(1, limit)
    total = F.count(F.lit(1))
    return df.agg(total.alias("total_items"), F.ceil(total / F.lit(size)).cast("bigint").alias("total_pages"))


def relevance(df: DataFrame, text: str) -> DataFrame:
    """Add search_rank, name_position and name_length for a literal text."""
    wanted = text.strip().lower()
    shown = trim_all(F.coalesce("name", F.lit("")))
    name = F.lower(shown)
    # a word starts the text or follows white space; with the white space unified this is a plain substring test
    spaced = F.translate(name, "\t\n\r\f", "    ")
    position = F.instr(name, wanted) - 1
    rank = (
        F.when(name == wanted, 4)
        .when(name.startswith(wanted), 3)
        .when(spaced.contains(" " + wanted), 2)
        .when(position >= 0, 1)
        .otherwise(0)
    )
    return df.withColumns(
        {
            "search_rank": rank,
            "name_position": F.when(position >= 0, position).otherwise(F.lit(NOT_FOUND)),
            "name_length": F.length(shown),
        }
    )


def relevance_order(id_col: str = "id") -> list[Column]:
    return [F.desc("search_rank"), F.asc("name_position"), F.asc("name_length"), F.desc("updated_at"), F.asc(id_col)]


def relevance_search(df: DataFrame, text: str, page: int = 1, limit: int = 20, extra: MainFilter | None = None) -> DataFrame:
    """Rows matching a text, best first, one page."""
    matched = df.where(search_any_field(text))
    if extra is not None:
        matched = matched.where(main_condition(extra))
    return paginate(relevance(matched, text), relevance_order(), page, limit)
