"""Filters, search, facets, duplicates and ranking over the catalog shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import duplicates as D, facets as A, filters as P, search as S
from shelfspark.plans.registry import Tables, query
from shelfspark.plans.scalar_queries import clean_list_sql, domain_sql, trim_sql
from shelfspark.plans.shapes import main_catalog, records, source_catalog, with_shapes

NO_CATEGORY = "(category_id IS NULL OR category_id = '000000000000000000000000')"
NO_ISBN = f"(isbn IS NULL OR {trim_sql('isbn')} = '')"


def searched_sql(text: str) -> str:
    fields = ["name", "isbn", "author_cover", "source_guid_nom"]
    hits = [f"coalesce(contains(lower({f}), '{text}'), false)" for f in fields]
    return "(" + " OR ".join(hits) + f" OR list_bool_or(list_transform(author_names, lambda a: contains(lower(a), '{text}'))))"


def domain_hit_sql(host: str) -> str:
    quoted = host.replace(".", "\\.")
    pattern = f"'(?i)^client:(www\\.)?{quoted}(:|$)|^(https?://)?(www\\.)?{quoted}(:[0-9]+)?(/|$)'"
    site = (
        "'(?i)^(https?://|client:(www\\.)?[a-z0-9-]+(\\.[a-z0-9-]+)+(:|$)|(www\\.)?[a-z0-9-]+(\\.[a-z0-9-]+)+(:[0-9]+)?(/|$))'"
    )

    def m(c: str, p: str) -> str:
        return f"coalesce(regexp_matches({c}, {p}), false)"

    return (
        f"({m('source_guid_nom', pattern)} OR {m('source_guid', pattern)} OR (NOT {m('source_guid_nom', site)}"
        f" AND NOT {m('source_guid', site)} AND {m('cover_url', pattern)}))"
    )


NAMED = "list_filter([coalesce(subject_name, ''), coalesce(niche_name, '')], lambda p: p <> '')"
SOURCE_PATH = f"CASE WHEN len({NAMED}) > 0 THEN {NAMED} ELSE category_path END"
OTHER_PATH = f"CASE WHEN len(category_path) > 0 THEN category_path WHEN len({NAMED}) > 0 THEN {NAMED} ELSE ['Без категории'] END"


@query(
    "f1_filter_source_catalog",
    with_shapes(
        "SELECT id, name FROM source_catalog WHERE"
        " (coalesce(regexp_matches(name, '(?i)r[ei]d|bolt$'), false) OR coalesce(regexp_matches(author_cover, '(?i)r[ei]d|bolt$'), false)"
        " OR coalesce(regexp_matches(isbn, '(?i)r[ei]d|bolt$'), false)"
        " OR list_bool_or(list_transform(author_names, lambda a: regexp_matches(a, '(?i)r[ei]d|bolt$'))))"
        " AND age_restriction IN ('6+', '12+', '18+') AND contains(lower(publisher_name), 'publisher')"
        " AND list_has_any(genre_names, ['ECONOMY', 'SMALL', 'G1'])"
        " AND (subject_guid IN ('s1', 's2', 's3', 's4') OR niche_guid IN ('k0'))",
        "source_catalog",
    ),
)
def f1(t: Tables):
    wanted = P.SourceFilter(
        search="r[ei]d|bolt$",
        age_restrictions=["6+", "12+", "18+"],
        like={"publisher_name": "Publisher"},
        genre_names=["ECONOMY", "SMALL", "G1"],
        subject_guids=["s1", "s2", "s3", "s4"],
        niche_guids=["k0"],
    )
    return P.filter_source_catalog(source_catalog(t), wanted).select("id", "name")


@query(
    "f2_filter_main_catalog",
    with_shapes(
        f"SELECT id, name, category_id FROM main_catalog WHERE NOT {NO_ISBN} AND id NOT IN (5, 9)"
        f" AND (coalesce(category_id IN ('n3', 'n7'), false) OR {NO_CATEGORY} OR {domain_hit_sql('delta.example')} OR ({SOURCE_PATH})[1:1] = ['STANDARD'])",
        "main_catalog",
    ),
)
def f2(t: Tables):
    wanted = P.MainFilter(
        syncable=True,
        exclude_ids=[5, 9],
        category_ids=["n3", "n7"],
        without_category=True,
        domains=["www.Delta.example"],
        source_paths=[["STANDARD"]],
    )
    return P.filter_main_catalog(main_catalog(t), wanted).select("id", "name", "category_id")


@query("f3_search_any_field", with_shapes(f"SELECT id, name FROM main_catalog WHERE {searched_sql('ring')}", "main_catalog"))
def f3(t: Tables):
    return main_catalog(t).where(P.search_any_field("RING")).select("id", "name")


@query(
    "f4_flag_predicates",
    with_shapes(
        f"SELECT id, {NO_CATEGORY} AS uncategorized, {NO_ISBN} AS without_isbn, NOT {NO_ISBN} AS syncable,"
        " coalesce(is_info_complete, false) AS info_complete FROM main_catalog",
        "main_catalog",
    ),
)
def f4(t: Tables):
    return main_catalog(t).select(
        "id",
        P.is_uncategorized().alias("uncategorized"),
        P.is_without_isbn().alias("without_isbn"),
        P.is_stock_syncable(True).alias("syncable"),
        P.is_info_complete(True).alias("info_complete"),
    )


@query(
    "f5_is_primary_source",
    with_shapes(
        "SELECT id, coalesce(source_guid_nom <> '' AND NOT regexp_matches(lower(source_guid_nom), '^https?://'), false) AS primary_source FROM main_catalog",
        "main_catalog",
    ),
)
def f5(t: Tables):
    return main_catalog(t).select("id", P.is_primary_source().alias("primary_source"))


@query(
    "f6_matches_source_domain",
    with_shapes(
        f"SELECT id, {domain_hit_sql('alpha-books.example')} AS alpha, {domain_hit_sql('gamma.example')} AS gamma, {domain_hit_sql('img.toys.example')} AS toys_cdn FROM main_catalog",
        "main_catalog",
    ),
)
def f6(t: Tables):
    return main_catalog(t).select(
        "id",
        P.matches_domain("alpha-books.example").alias("alpha"),
        P.matches_domain("gamma.example").alias("gamma"),
        P.matches_domain("img.toys.example").alias("toys_cdn"),
    )


@query(
    "f7_matches_source_path",
    with_shapes(
        f"SELECT id, {domain_hit_sql('shop.gamma.example')} AND ({SOURCE_PATH})[1:1] = ['ECONOMY'] AS by_host, ({SOURCE_PATH})[1:2] = ['ECONOMY', 'Niche 1'] AS by_prefix,"
        " coalesce(regexp_matches(cover_url, '(?i)^https?://(www\\.)?img\\.toys_shop\\.example(:[0-9]+)?/'), false) AS by_cover FROM main_catalog",
        "main_catalog",
    ),
)
def f7(t: Tables):
    return main_catalog(t).select(
        "id",
        P.matches_source_path(["shop.gamma.example", "ECONOMY"]).alias("by_host"),
        P.matches_source_path([" ECONOMY ", "Niche 1"]).alias("by_prefix"),
        P.matches_source_path(["img.toys_shop.example", "small"]).alias("by_cover"),
    )


@query(
    "f8_matches_other_path",
    with_shapes(
        f"SELECT id, {NO_CATEGORY} AND {domain_hit_sql('toys.example')} AS by_host, {NO_CATEGORY} AND ({OTHER_PATH})[1:1] = ['Без категории'] AS by_default,"
        f" {NO_CATEGORY} AND ({OTHER_PATH})[1:1] = ['SMALL'] AS by_prefix FROM main_catalog",
        "main_catalog",
    ),
)
def f8(t: Tables):
    return main_catalog(t).select(
        "id",
        P.matches_other_path(["toys.example"]).alias("by_host"),
        P.matches_other_path([P.UNCATEGORIZED]).alias("by_default"),
        P.matches_other_path(["SMALL"]).alias("by_prefix"),
    )


@query(
    "f9_decode_filter_keys",
    "WITH x AS (SELECT *, rtrim(replace(replace(to_base64(encode(p_type || chr(31) || p_name)), '+', '-'), '/', '_'), '=') AS k FROM part)"
    " SELECT p_partkey AS id, kind, path FROM ("
    " SELECT p_partkey, 'other' AS kind, '' AS path FROM x UNION ALL SELECT p_partkey, 'otherPath', p_type || '|' || p_name FROM x"
    " UNION ALL SELECT p_partkey, 'path', p_type || '|' || p_name FROM x UNION ALL SELECT p_partkey, 'domain', lower(p_type) FROM x)",
)
def f9(t: Tables):
    from shelfspark.functions.text import path_key

    key = path_key(F.array("p_type", "p_name"))
    keys = F.concat_ws(",", F.lit("other"), F.concat(F.lit("otherPath:"), key), key, F.lit("path:%%%"), F.concat(F.lit("path:"), key), F.concat(F.lit("domain:"), key))
    decoded = t.spread("part").select(F.col("p_partkey").alias("id"), F.inline(P.decode_filter_keys(keys)))
    return decoded.select("id", "kind", F.array_join("path", "|").alias("path"))


@query(
    "f10_fetch_by_ids",
    with_shapes("SELECT id, name, price FROM main_catalog WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')", "main_catalog"),
)
def f10(t: Tables):
    wanted = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return P.fetch_by_ids(main_catalog(t), wanted, drop=["covers"]).select("id", "name", "price")


@query(
    "f11_list_entities",
    "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE regexp_matches(s_name, '(?i)supplier#0+[0-9]*[13]') AND s_acctbal > 0 ORDER BY name, id LIMIT 20 OFFSET 5",
)
def f11(t: Tables):
    entities = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_acctbal") > 0).alias("is_active"))
    found = P.list_entities(entities, "supplier#0+[0-9]*[13]", "is_active")
    return found.select("id", "name").orderBy("name", "id").offset(5).limit(20)


@query(
    "f12_list_active",
    "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS city FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'",
)
def f12(t: Tables):
    rows = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), (F.col("c_acctbal") > 0).alias("is_active")
    )
    return P.list_active(rows, equal={"city": "BUILDING"}).orderBy("name").select("id", "name", "city")


@query(
    "f13_paginate",
    with_shapes("SELECT id, name, updated_at FROM main_catalog ORDER BY updated_at DESC, id LIMIT 30 OFFSET 60", "main_catalog"),
)
def f13(t: Tables):
    rows = main_catalog(t).select("id", "name", "updated_at")
    return S.paginate(rows, [F.desc("updated_at"), F.asc("id")], page=3, limit=30)


@query(
    "f13_page_totals",
    with_shapes(f"SELECT count(*) AS total_items, CAST(ceil(count(*) / 30.0) AS BIGINT) AS total_pages FROM main_catalog WHERE {NO_CATEGORY}", "main_catalog"),
)
def f13_totals(t: Tables):
    return S.page_totals(main_catalog(t).where(P.is_uncategorized()), limit=30)


RANKED = (
    "SELECT id, name, CASE WHEN n = 'ring' THEN 4 WHEN starts_with(n, 'ring') THEN 3 WHEN regexp_matches(n, '(^|\\s)ring') THEN 2"
    " WHEN strpos(n, 'ring') > 0 THEN 1 ELSE 0 END AS search_rank, CASE WHEN strpos(n, 'ring') > 0 THEN CAST(strpos(n, 'ring') - 1 AS INTEGER) ELSE 2147483647 END AS name_position,"
    f" CAST(length(n) AS INTEGER) AS name_length, updated_at FROM (SELECT *, lower({trim_sql('name')}) AS n FROM main_catalog WHERE {searched_sql('ring')})"
)


@query(
    "w1_relevance_search",
    with_shapes(
        f"SELECT id, name, search_rank, name_position, name_length, updated_at FROM ({RANKED}) ORDER BY search_rank DESC, name_position, name_length, updated_at DESC, id LIMIT 50",
        "main_catalog",
    ),
)
def w1(t: Tables):
    page = S.relevance_search(main_catalog(t), " Ring ".strip(), page=1, limit=50)
    return page.select("id", "name", "search_rank", "name_position", "name_length", "updated_at")


CODES_SQL = (
    "list_distinct(list_filter(list_transform([{cols}], lambda c: replace(upper(replace(regexp_replace(c, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), 'ß', '_')), '_', 'ß')), lambda c: c <> ''))"
)
MAIN_PAIRS = "SELECT id, unnest(" + CODES_SQL.format(cols="isbn_normalized, isbn, barcode, code, source_nomcode") + ") AS code FROM main_catalog"
SOURCE_PAIRS = "SELECT id, unnest(" + CODES_SQL.format(cols="isbn, nomcode") + ") AS code FROM source_catalog"


@query(
    "a1_duplicate_products",
    with_shapes(
        f", pairs AS ({MAIN_PAIRS}) SELECT id, name, isbn, barcode, code FROM main_catalog WHERE id IN"
        " (SELECT id FROM pairs WHERE code IN (SELECT code FROM pairs GROUP BY code HAVING count(*) > 1))",
        "main_catalog",
    ),
)
def a1(t: Tables):
    return D.duplicate_products(main_catalog(t), D.MAIN_CODES).select("id", "name", "isbn", "barcode", "code")


@query(
    "a1_duplicate_source_products",
    with_shapes(
        f", pairs AS ({SOURCE_PAIRS}) SELECT id, isbn, nomcode FROM source_catalog WHERE id IN"
        " (SELECT id FROM pairs WHERE code IN (SELECT code FROM pairs GROUP BY code HAVING count(*) > 1))",
        "source_catalog",
    ),
)
def a1_source(t: Tables):
    return D.duplicate_products(source_catalog(t), D.SOURCE_CODES).select("id", "isbn", "nomcode")


@query(
    "a1_duplicate_summary",
    with_shapes(
        f", pairs AS ({MAIN_PAIRS}), shared AS (SELECT code FROM pairs GROUP BY code HAVING count(*) > 1)"
        " SELECT (SELECT count(*) FROM main_catalog) AS scanned, (SELECT count(*) FROM shared) AS duplicate_groups,"
        " (SELECT count(DISTINCT id) FROM pairs WHERE code IN (SELECT code FROM shared)) AS duplicate_products",
        "main_catalog",
    ),
)
def a1_summary(t: Tables):
    return D.duplicate_summary(main_catalog(t), D.MAIN_CODES)


def _nb(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({trim_sql(c)}, '')" for c in cols) + ")"


def _norm(expr: str) -> str:
    return f"upper(regexp_replace({expr}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g'))"


ENTRIES = " UNION ALL ".join(
    f"SELECT id, name, '{f}' AS field, {i} AS field_no, {_nb(*cols)} AS raw, {_norm(_nb(*cols))} AS code FROM main_catalog"
    for i, (f, cols) in enumerate(D.GROUP_FIELDS.items())
)
GROUPS = (
    f", entries AS (SELECT * FROM ({ENTRIES}) WHERE code <> ''),"
    " members AS (SELECT code, id, any_value(name) AS name, string_agg(field, ',' ORDER BY field) AS fields, arg_min(raw, field_no) AS raw FROM entries GROUP BY code, id),"
    " heads AS (SELECT code, count(*) AS group_size, arg_min(raw, id) AS raw_value FROM members GROUP BY code HAVING count(*) > 1),"
    " head_fields AS (SELECT code, string_agg(field, ',' ORDER BY field) AS group_fields FROM (SELECT DISTINCT code, field FROM entries) GROUP BY code),"
    " groups AS (SELECT m.code, m.id, m.name, m.fields, h.group_size, h.raw_value, f.group_fields FROM members m JOIN heads h ON m.code = h.code JOIN head_fields f ON m.code = f.code)"
)


@query("a2_duplicate_groups", with_shapes(GROUPS + " SELECT code, id, name, fields, group_size, raw_value, group_fields FROM groups", "main_catalog"))
def a2(t: Tables):
    return D.duplicate_groups(main_catalog(t)).orderBy(F.desc("group_size"), "code", "name", "id")


@query(
    "a3_max_duplicate_selection",
    with_shapes(
        GROUPS + " SELECT DISTINCT id FROM groups WHERE id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY code ORDER BY name, id) AS rn FROM groups) WHERE rn = 1)",
        "main_catalog",
    ),
)
def a3(t: Tables):
    return D.deletable_duplicates(D.duplicate_groups(main_catalog(t)))


# A review per (user, product): the smallest value of an event counts, bucketed to 1..5.
REVIEWS = "SELECT user_id, user_id * 7 % 40 AS product_id, 1 + CAST(floor(value) AS BIGINT) % 5 AS rating, ts, event_id FROM events"


def reviews(t: Tables):
    return t.events.selectExpr(
        "user_id", "user_id * 7 % 40 AS product_id", "1 + CAST(floor(value) AS BIGINT) % 5 AS rating", "ts", "event_id"
    )


@query(
    "a4_average_rating",
    f"WITH r AS ({REVIEWS}) SELECT p_partkey AS product_id, coalesce(a, 0.0)::DOUBLE AS average, coalesce(n, 0) AS review_count FROM part"
    " LEFT JOIN (SELECT product_id, CAST(sum(rating) AS DOUBLE) / count(*) AS a, count(*) AS n FROM r GROUP BY product_id) ON p_partkey = product_id",
)
def a4(t: Tables):
    return A.average_rating(reviews(t), t.part.select(F.col("p_partkey").alias("product_id")))


@query("a4_review_key_violations", f"WITH r AS ({REVIEWS}) SELECT user_id, product_id, count(*) AS rows FROM r GROUP BY ALL HAVING count(*) > 1")
def a4_keys(t: Tables):
    return A.duplicate_keys(reviews(t), ["user_id", "product_id"])


@query(
    "a5_distinct_values",
    with_shapes("SELECT trim(subject_name) AS value FROM (SELECT DISTINCT subject_name FROM source_catalog WHERE trim(subject_name) <> '') ORDER BY value", "source_catalog"),
)
def a5(t: Tables):
    return A.distinct_values(source_catalog(t), "subject_name")


@query(
    "a6_distinct_array_values",
    with_shapes("SELECT trim(v) AS value FROM (SELECT DISTINCT unnest(genre_names) AS v FROM source_catalog) WHERE trim(v) <> '' ORDER BY value", "source_catalog"),
)
def a6(t: Tables):
    return A.distinct_array_values(source_catalog(t), "genre_names")


FACETS = {"subject": "subject_name", "brand": "brand_name", "series": "serie_name", "publisher": "publisher_name"}
LISTS = {"tag": "tag_names", "genre": "genre_names", "author": "author_names"}


@query(
    "a7_facet_meta",
    with_shapes(
        " UNION ALL ".join(
            [f"SELECT '{k}' AS facet, trim(v) AS value FROM (SELECT DISTINCT {c} AS v FROM source_catalog) WHERE trim(v) <> ''" for k, c in FACETS.items()]
            + [f"SELECT '{k}' AS facet, trim(v) AS value FROM (SELECT DISTINCT unnest({c}) AS v FROM source_catalog) WHERE trim(v) <> ''" for k, c in LISTS.items()]
        ),
        "source_catalog",
    ),
)
def a7(t: Tables):
    return A.facet_meta(source_catalog(t), FACETS, LISTS)


@query(
    "a8_unique_authors",
    with_shapes(
        "SELECT guid, name FROM (SELECT r.guid AS guid, r.name AS name, row_number() OVER (PARTITION BY r.guid ORDER BY updated_at, id, r.name) AS rn"
        " FROM (SELECT id, updated_at, unnest(author_refs) AS r FROM source_catalog) WHERE r.guid <> '' AND r.name <> '') WHERE rn = 1 ORDER BY name, guid",
        "source_catalog",
    ),
)
def a8(t: Tables):
    return A.unique_authors(source_catalog(t))


DOMAINS = ", ".join(domain_sql(c) for c in ["source_guid_nom", "source_guid", "cover_url", "covers['a']", "covers['b']"])


@query("a9_source_domains", with_shapes(f"SELECT DISTINCT domain FROM (SELECT unnest([{DOMAINS}]) AS domain FROM main_catalog) WHERE domain <> ''", "main_catalog"))
def a9(t: Tables):
    return A.source_domains(main_catalog(t)).orderBy("domain")


FIRST_COVER = "coalesce(nullif(trim(cover_url), ''), nullif(trim(covers['a']), ''))"
DOMAIN = f"coalesce(nullif({domain_sql('source_guid_nom')}, ''), nullif({domain_sql('source_guid')}, ''), nullif({domain_sql(FIRST_COVER)}, ''), '')"
HINT = (
    f"CASE WHEN {DOMAIN} = '' THEN NULL ELSE concat_ws('|', {DOMAIN}, coalesce({clean_list_sql('[subject_name, niche_name]')}, {clean_list_sql('category_path')})) END"
)


@query("a10_source_category_paths", with_shapes(f"SELECT DISTINCT {HINT} AS path FROM main_catalog WHERE {DOMAIN} <> ''", "main_catalog"))
def a10(t: Tables):
    return A.source_paths(main_catalog(t)).orderBy("path_key").select(F.array_join("path", "|").alias("path"))


@query("a11_uncategorized_hints", with_shapes(f"SELECT DISTINCT coalesce({HINT}, 'Без категории') AS path FROM main_catalog WHERE {NO_CATEGORY}", "main_catalog"))
def a11(t: Tables):
    return A.uncategorized_hints(main_catalog(t)).orderBy("path_key").select(F.array_join("path", "|").alias("path"))


@query(
    "a12_extract_dimensions",
    with_shapes(
        "SELECT guid, name, owner_guid, kind FROM (SELECT subject_guid AS guid, subject_name AS name, niche_guid AS owner_guid, 'subject' AS kind,"
        " row_number() OVER (PARTITION BY subject_guid ORDER BY updated_at, id) AS rn FROM source_catalog UNION ALL"
        " SELECT niche_guid, niche_name, '', 'niche', row_number() OVER (PARTITION BY niche_guid ORDER BY updated_at, id) FROM source_catalog) WHERE rn = 1",
        "source_catalog",
    ),
)
def a12(t: Tables):
    df = source_catalog(t)
    subjects = A.extract_dimension(df, "subject_guid", "subject_name", ["updated_at", "id"], "niche_guid")
    niches = A.extract_dimension(df, "niche_guid", "niche_name", ["updated_at", "id"])
    return subjects.withColumn("kind", F.lit("subject")).unionByName(niches.withColumn("kind", F.lit("niche")))


@query(
    "a14_detected_fields",
    with_shapes(
        "SELECT DISTINCT unnest(json_keys(data)) AS field FROM records", "records"
    ),
)
def a14(t: Tables):
    maps = records(t).withColumn("data", F.from_json("data", "map<string,string>"))
    return A.detected_fields(maps)


@query(
    "a15_sync_counters",
    with_shapes(
        "SELECT run_id, json_extract_string(data, '$.title') AS target, count(*) FILTER (isbn = '') AS skipped, count(*) FILTER (isbn <> '' AND price < 10) AS upserted,"
        " count(*) FILTER (isbn <> '' AND price >= 10) AS modified, count(*) AS total FROM (SELECT *, json_extract_string(data, '$.isbn') AS isbn,"
        " CAST(json_extract_string(data, '$.price') AS BIGINT) AS price FROM records) GROUP BY ALL",
        "records",
    ),
)
def a15(t: Tables):
    fields = F.from_json("data", "title string, price bigint, isbn string")
    rows = records(t).select("run_id", fields.alias("d"))
    action = F.when(F.col("d.isbn") == "", "skipped").when(F.col("d.price") < 10, "upserted").otherwise("modified")
    actions = rows.select("run_id", F.col("d.title").alias("target"), action.alias("action"))
    return A.sync_summary(actions, ["skipped", "upserted", "modified"])


@query("a17_run_counts", with_shapes("SELECT run_id, count(*) AS records FROM records GROUP BY run_id", "records"))
def a17(t: Tables):
    return A.run_counts(records(t)).orderBy(F.desc("run_id"))


@query("a18_distinct_active_cities", "SELECT DISTINCT c_mktsegment AS city FROM customer WHERE c_acctbal > 0")
def a18(t: Tables):
    return A.distinct_active(t.customer.select(F.col("c_mktsegment").alias("city"), (F.col("c_acctbal") > 0).alias("is_active")), "city").orderBy("city")


@query(
    "a19_mapping_usage",
    "SELECT trim(p_type) AS source, count(*) AS targets FROM part GROUP BY 1",
)
def a19(t: Tables):
    """A rule per part: the target is the part, the source field its type."""
    return A.mapping_usage(t.part.select(F.col("p_partkey").alias("target"), F.concat(F.lit(" "), "p_type").alias("source")))
