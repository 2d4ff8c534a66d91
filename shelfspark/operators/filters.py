"""Catalog predicates and facet filters, built as plain Column conditions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from shelfspark.functions.text import clean_array, decode_path_key, trim_all
from shelfspark.functions.urls import HOST_PATTERN

NO_ID = "000000000000000000000000"
UNCATEGORIZED = "Без категории"

# Bare filter keys.
KEY_WITHOUT_CATEGORY = "other"
KEY_PRIMARY = "group:primary"
KEY_TAG = "^(domain|otherPath|path):"

# Fixed value: a source id that itself names a site.
HAS_SITE = (
    r"(?i)^(https?://|client:(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)+(:|$)"
    r"|(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)+(:[0-9]+)?(/|$))"
)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def sure(condition: Column) -> Column:
    """Unknown counts as no, so that a negation keeps the row."""
    return F.coalesce(condition, F.lit(False))


def has_substring(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def search_any_field(text: str) -> Column:
    """Literal text, any case, in the name, ISBN, authors or source id."""
    fields = ["name", "isbn", "author_cover", "source_guid_nom"]
    hits = [sure(has_substring(F.col(f), text)) for f in fields]
    return any_of([*hits, sure(F.exists("author_names", lambda a: has_substring(a, text)))])


def is_uncategorized(c: str = "category_id") -> Column:
    return F.col(c).isNull() | (F.col(c) == NO_ID)


def is_without_isbn(c: str = "isbn") -> Column:
    return F.col(c).isNull() | (trim_all(c) == "")


def is_stock_syncable(wanted: bool = True, c: str = "isbn") -> Column:
    return ~is_without_isbn(c) if wanted else is_without_isbn(c)


def is_info_complete(wanted: bool = True, c: str = "is_info_complete") -> Column:
    flag = F.coalesce(F.col(c), F.lit(False))
    return flag if wanted else ~flag


def is_primary_source(c: str = "source_guid_nom") -> Column:
    """A non-empty source id that is no URL; `client:` ids pass."""
    return sure((F.col(c) != "") & ~F.lower(F.col(c)).rlike("^https?://"))


def _bare_host(domain: str) -> str | None:
    host = domain.strip().lower().removeprefix("www.")
    return host if re.match(HOST_PATTERN, host) else None


def matches_domain(domain: str) -> Column | None:
    """Exact host in either source id; the cover counts only when no id names a site."""
    host = _bare_host(domain)
    if host is None:
        return None
    quoted = re.escape(host)
    pattern = rf"(?i)^client:(www\.)?{quoted}(:|$)|^(https?://)?(www\.)?{quoted}(:[0-9]+)?(/|$)"
    by_id = sure(F.col("source_guid_nom").rlike(pattern)) | sure(F.col("source_guid").rlike(pattern))
    no_site = ~sure(F.col("source_guid_nom").rlike(HAS_SITE)) & ~sure(F.col("source_guid").rlike(HAS_SITE))
    return by_id | (no_site & sure(F.col("cover_url").rlike(pattern)))


def _named_path() -> Column:
    return F.filter(
        F.array(F.coalesce("subject_name", F.lit("")), F.coalesce("niche_name", F.lit(""))), lambda p: p != ""
    )


def _stored_path() -> Column:
    return F.coalesce("category_path", F.array().cast("array<string>"))


def source_path() -> Column:
    """Subject and niche, else the stored path."""
    return F.when(F.size(_named_path()) > 0, _named_path()).otherwise(_stored_path())


def other_path() -> Column:
    """Stored path, else subject and niche, else the uncategorized label."""
    return (
        F.when(F.size(_stored_path()) > 0, _stored_path())
        .when(F.size(_named_path()) > 0, _named_path())
        .otherwise(F.array(F.lit(UNCATEGORIZED)))
    )


def _starts_with(path: Column, wanted: Sequence[str]) -> Column:
    return F.slice(path, 1, len(wanted)) == F.array(*[F.lit(w) for w in wanted])


def _cover_pattern(path: Sequence[str]) -> str | None:
    """Regex over the cover URL for a path whose head has a dot; other heads give none."""
    head = path[0].strip().lower()
    if "." not in head:
        return None
    site = rf"(?i)^https?://(www\.)?{re.escape(head.removeprefix('www.'))}(:[0-9]+)?"
    steps = [re.escape(p.lower()) for p in path[1:]]
    if not steps:
        return site + "(/|$)"
    hop = "([^/?#]+/)*"
    return site + "/" + "".join(f"{hop}{s}/" for s in steps[:-1]) + f"{hop}{steps[-1]}" + r"(/|\?|#|$)"


def _clean(path: Sequence[str]) -> list[str]:
    trimmed = [p.strip() for p in path]
    return [p for p in dict.fromkeys(trimmed) if p]


def _matches_path(path: Sequence[str], stored: Column) -> Column | None:
    parts = _clean(path)
    if not parts:
        return None
    if _bare_host(parts[0]) is not None and re.match(HOST_PATTERN, parts[0].lower()):
        domain = matches_domain(parts[0])
        return domain & _starts_with(stored, parts[1:]) if len(parts) > 1 else domain
    pattern = _cover_pattern(parts)
    if pattern is not None:
        return sure(F.col("cover_url").rlike(pattern))
    return _starts_with(stored, parts)


def matches_source_path(path: Sequence[str]) -> Column | None:
    return _matches_path(path, source_path())


def matches_other_path(path: Sequence[str]) -> Column | None:
    inner = _matches_path(path, other_path())
    return None if inner is None else is_uncategorized() & inner


@dataclass
class MainFilter:
    search: str = ""
    without_isbn: bool = False
    syncable: bool | None = None
    info_complete: bool | None = None
    exclude_ids: Sequence[object] = ()
    category_ids: Sequence[str] = ()
    without_category: bool = False
    primary_sources: bool = False
    domains: Sequence[str] = ()
    source_paths: Sequence[Sequence[str]] = ()
    other_paths: Sequence[Sequence[str]] = ()


def main_condition(f: MainFilter) -> Column:
    """Plain facets are ANDed; the category-like ones form one OR group."""
    narrow: list[Column] = []
    if f.search:
        narrow.append(search_any_field(f.search))
    if f.without_isbn:
        narrow.append(is_without_isbn())
    if f.syncable is not None:
        narrow.append(is_stock_syncable(f.syncable))
    if f.info_complete is not None:
        narrow.append(is_info_complete(f.info_complete))
    if f.exclude_ids:
        narrow.append(~sure(F.col("id").isin(*f.exclude_ids)))
    group: list[Column | None] = []
    if f.category_ids:
        group.append(sure(F.col("category_id").isin(*f.category_ids)))
    if f.without_category:
        group.append(is_uncategorized())
    if f.primary_sources:
        group.append(is_primary_source())
    group += [matches_domain(d) for d in f.domains]
    group += [matches_source_path(p) for p in f.source_paths]
    group += [matches_other_path(p) for p in f.other_paths]
    usable = [g for g in group if g is not None]
    if usable:
        narrow.append(any_of(usable))
    return all_of(narrow) if narrow else F.lit(True)


def filter_main_catalog(df: DataFrame, f: MainFilter) -> DataFrame:
    return df.where(main_condition(f))


@dataclass
class SourceFilter:
    """Facets of the publisher catalog; a list beats the single value of the same facet."""

    search: str = ""
    category_ids: Sequence[str] = ()
    author_guids: Sequence[str] = ()
    author_names: Sequence[str] = ()
    author_name: str = ""
    tag_guids: Sequence[str] = ()
    tag_name: str = ""
    genre_names: Sequence[str] = ()
    age_restrictions: Sequence[str] = ()
    subject_guids: Sequence[str] = ()
    niche_guids: Sequence[str] = ()
    equal: dict[str, str] = field(default_factory=dict)
    one_of: dict[str, Sequence[str]] = field(default_factory=dict)
    like: dict[str, str] = field(default_factory=dict)


def compiled(pattern: str) -> str:
    """User regex, any case; a malformed one fails here and not inside the tasks."""
    re.compile(pattern)
    return "(?i)" + pattern


def source_condition(f: SourceFilter) -> Column:
    clauses: list[Column] = []
    if f.search:
        pattern = compiled(f.search)
        hits = [sure(F.col(c).rlike(pattern)) for c in ("name", "author_cover", "isbn")]
        clauses.append(any_of([*hits, sure(F.exists("author_names", lambda a: a.rlike(pattern)))]))
    if f.category_ids:
        clauses.append(sure(F.arrays_overlap("category_ids", F.array(*map(F.lit, f.category_ids)))))
    if f.author_guids:
        clauses.append(sure(F.exists("author_refs", lambda r: r["guid"].isin(*f.author_guids))))
    names = [n.strip() for n in f.author_names if n.strip()]
    if names:
        clauses.append(any_of([sure(F.exists("author_names", lambda a, n=n: has_substring(a, n))) for n in names]))
    elif f.author_name and not f.author_names:
        clauses.append(sure(F.exists("author_names", lambda a: has_substring(a, f.author_name))))
    if f.tag_guids:
        clauses.append(sure(F.exists("tag_refs", lambda r: r["guid"].isin(*f.tag_guids))))
    if f.tag_name:
        clauses.append(sure(F.exists("tag_names", lambda t: has_substring(t, f.tag_name))))
    if f.genre_names:
        clauses.append(sure(F.arrays_overlap("genre_names", F.array(*map(F.lit, f.genre_names)))))
    if f.age_restrictions:
        clauses.append(sure(F.col("age_restriction").isin(*f.age_restrictions)))
    for column, value in f.equal.items():
        clauses.append(sure(F.col(column) == value))
    for column, values in f.one_of.items():
        if values:
            clauses.append(sure(F.col(column).isin(*values)))
    for column, text in f.like.items():
        if text and not f.one_of.get(column):
            clauses.append(sure(has_substring(F.col(column), text)))
    owners = []
    if f.subject_guids:
        owners.append(sure(F.col("subject_guid").isin(*f.subject_guids)))
    if f.niche_guids:
        owners.append(sure(F.col("niche_guid").isin(*f.niche_guids)))
    if owners:
        clauses.append(any_of(owners))
    return all_of(clauses) if clauses else F.lit(True)


def filter_source_catalog(df: DataFrame, f: SourceFilter) -> DataFrame:
    return df.where(source_condition(f))


def decode_filter_keys(c: Column | str) -> Column:
    """Comma list of filter keys to distinct array<struct<kind, path>>.

    Two bare words name the uncategorized and the primary-source groups; the
    rest is URL-safe base64 of path segments behind a `domain:`, `otherPath:`
    or `path:` tag (no tag means path). Malformed keys are left out.
    """
    keys = clean_array(F.split(F.col(c) if isinstance(c, str) else c, ","))
    none = F.array().cast("array<string>")

    def read(k: Column) -> Column:
        bare = k.isin(KEY_WITHOUT_CATEGORY, KEY_PRIMARY)
        tag = F.regexp_extract(k, KEY_TAG, 1)
        path = clean_array(decode_path_key(F.regexp_replace(k, KEY_TAG, "")))
        host = F.lower(F.get(path, F.lit(0)))
        kind = F.when(bare, k).when(path.isNull(), F.lit(None)).when(tag == "", F.lit("path")).otherwise(tag)
        parts = F.when(bare, none).when(tag == "domain", F.array(host)).otherwise(path)
        return F.struct(kind.alias("kind"), parts.alias("path"))

    return F.array_distinct(F.filter(F.transform(keys, read), lambda r: r.kind.isNotNull()))


def fetch_by_ids(df: DataFrame, ids: DataFrame, id_col: str = "id", drop: Sequence[str] = ()) -> DataFrame:
    """Rows whose id is listed. The list stays a table: the planner broadcasts it only when small."""
    return df.drop(*drop).join(ids.select(id_col).distinct(), id_col, "left_semi")


def list_entities(df: DataFrame, search: str = "", flag: str | None = None) -> DataFrame:
    """Reference entities by name pattern and an optional flag; order and page with `paginate`."""
    found = df.where(sure(F.col("name").rlike(compiled(search)))) if search else df
    return found.where(F.coalesce(F.col(flag), F.lit(False))) if flag else found


def list_active(df: DataFrame, flag: str = "is_active", equal: dict[str, object] | None = None) -> DataFrame:
    active = df.where(F.coalesce(F.col(flag), F.lit(False)))
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), (equal or {}).items(), active)
