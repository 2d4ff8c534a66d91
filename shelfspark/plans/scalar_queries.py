"""Scalar functions applied to whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import covers as C, numbers as N, text as X, urls as U, values as V
from shelfspark.plans.registry import Tables, query
from shelfspark.plans.shapes import main_catalog, source_catalog, with_shapes

WS = X.SPACE_CLASS


def trim_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


# The entities that occur in the given pages and in the texts of these queries; the ampersand goes last.
PAGE_ENTITIES = {
    "&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'", "&laquo;": "«", "&raquo;": "»",
    "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&copy;": "©", "&middot;": "·", "&amp;": "&",
}


def clean_sql(c: str) -> str:
    """Oracle form of clean_text."""
    out = c
    for entity, char in PAGE_ENTITIES.items():
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return trim_sql(f"regexp_replace({out}, '{WS}+', ' ', 'g')")




def clean_list_sql(expr: str) -> str:
    """Trim, drop blanks, keep the first of equals, joined by '|'; nothing left gives null."""
    t = f"list_filter(list_transform({expr}, lambda x: {trim_sql('x')}), lambda x: x <> '')"
    kept = f"list_filter({t}, lambda x, i: list_position({t}, x) = i)"
    return f"nullif(array_to_string({kept}, '|'), '')"


# Text with every separator and mark the functions look at, derived from whole columns.
MARKED = (
    "concat(' ', p_name, CASE p_partkey % 7 WHEN 0 THEN ' / ' WHEN 1 THEN '>' WHEN 2 THEN '|' WHEN 3 THEN ',' WHEN 4 THEN ';'"
    " WHEN 5 THEN '/' ELSE ' ' END, p_type, CASE p_partkey % 3 WHEN 0 THEN ' | ' WHEN 1 THEN ',, ' ELSE '>' END, p_brand, ' ')"
)
SIZED = "concat(CAST(p_size AS STRING), CASE p_partkey % 4 WHEN 0 THEN 'Х' WHEN 1 THEN ' х ' WHEN 2 THEN '*' ELSE 'X' END, CAST(p_partkey % 50 AS STRING), CASE p_partkey % 3 WHEN 0 THEN 'x3' ELSE '' END)"
LOCALE = (
    "CASE p_partkey % 8 WHEN 0 THEN concat(CAST(p_size AS STRING), ',500') WHEN 1 THEN concat(CAST(p_size AS STRING), ',5')"
    " WHEN 2 THEN concat('1.', lpad(CAST(p_size AS STRING), 3, '0'), ',25') WHEN 3 THEN concat('1,', lpad(CAST(p_size AS STRING), 3, '0'), '.25')"
    " WHEN 4 THEN concat(' ', CAST(p_retailprice AS STRING), ' ') WHEN 5 THEN p_name WHEN 6 THEN concat('1,2,', CAST(p_size AS STRING)) ELSE concat('-', CAST(p_size AS STRING)) END"
)
PRICE_TEXT = "concat('от ', CASE p_partkey % 4 WHEN 0 THEN '1 200,50' WHEN 1 THEN CAST(p_retailprice AS STRING) WHEN 2 THEN '1.234,5' ELSE concat('$', CAST(p_size AS STRING)) END, ' сум')"
LINKS = (
    "concat(p_brand, CASE p_partkey % 4 WHEN 0 THEN '; ' WHEN 1 THEN ', ' WHEN 2 THEN '|' ELSE ' ' END, 'HTTPS://cdn.example/',"
    " CAST(p_partkey AS STRING), CASE p_partkey % 2 WHEN 0 THEN ' http://b.example/2' ELSE '' END)"
)
FLAG = "CASE p_partkey % 6 WHEN 0 THEN ' Да ' WHEN 1 THEN 'YES' WHEN 2 THEN '0' WHEN 3 THEN 'истина' WHEN 4 THEN p_name ELSE 'on' END"
ISBN_TEXT = "concat('&nbsp;ISBN: 978-5-', lpad(CAST(p_partkey % 1000 AS STRING), 4, '0'), CASE p_partkey % 3 WHEN 0 THEN '-1' WHEN 1 THEN '-00x' ELSE '' END, ' ', p_name)"
CODE = "CASE p_partkey % 5 WHEN 0 THEN lpad(CAST(p_partkey AS STRING), 13, '0') WHEN 1 THEN concat(lpad(CAST(p_partkey AS STRING), 9, '1'), 'x') WHEN 2 THEN ' 12345678 ' WHEN 3 THEN concat('x', lpad(CAST(p_partkey AS STRING), 9, '1')) ELSE p_name END"


def on_part(name: str, expr: str, fn, sql_value: str):
    """value = fn(expr) for every part."""

    @query(name, f"SELECT p_partkey AS id, {sql_value.replace('{c}', 'v')} AS value FROM (SELECT p_partkey, {expr} AS v FROM part)")
    def run(t: Tables):
        return t.part.selectExpr("p_partkey AS id", f"{expr} AS v").select("id", fn("v").alias("value"))

    return run


@query("c1_norm_code_ascii", "SELECT doc_id AS id, upper(regexp_replace(source || '/' || text, '[^0-9A-Za-z]', '', 'g')) AS value FROM documents")
def c1(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), X.norm_code_ascii(F.concat("source", F.lit("/"), "text")).alias("value"))


@query("c2_norm_code_unicode", r"SELECT doc_id AS id, replace(upper(replace(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g'), 'ß', '_')), '_', 'ß') AS value FROM documents")
def c2(t: Tables):
    return t.documents.select(F.col("doc_id").alias("id"), X.norm_code_unicode("text").alias("value"))


on_part(
    "c3_norm_isbn_page",
    ISBN_TEXT,
    X.norm_isbn_page,
    "CASE WHEN length(regexp_replace(regexp_extract(upper("
    + clean_sql("{c}")
    + r"), '[0-9X][0-9X\\-]{8,20}'), '[^0-9]', '', 'g')) >= 9 THEN regexp_replace(regexp_extract(upper("
    + clean_sql("{c}")
    + r"), '[0-9X][0-9X\\-]{8,20}'), '^[ -]+|[ -]+$', '', 'g') ELSE '' END",
)
on_part(
    "c4_looks_like_isbn_ean",
    CODE,
    X.looks_like_isbn_ean,
    f"regexp_full_match(upper({trim_sql('{c}')}), '[0-9]{{8}}|[0-9]{{9}}[0-9X]|[0-9]{{13,14}}')",
)
on_part(
    "c5_norm_size",
    SIZED,
    X.norm_size,
    f"array_to_string(list_slice(list_filter(list_transform(string_split(translate({trim_sql('{c}')}, 'XХх*', 'xxxx'), 'x'), lambda p: {trim_sql('p')}), lambda p: p <> ''), 1, 2), 'x')",
)


@query("c6_go_trim", f"SELECT conv_id, turn, {trim_sql('chr(160) || chr(8195) || text || chr(12288) || chr(10)')} AS value FROM conversations")
def c6(t: Tables):
    padded = F.concat(F.lit("  "), "text", F.lit("　\n"))
    return t.conversations.select("conv_id", "turn", X.trim_all(padded).alias("value"))


@query(
    "c7_first_non_empty",
    with_shapes(f"SELECT id, coalesce(nullif({trim_sql('isbn')}, ''), nullif({trim_sql('source_guid_nom')}, ''), nullif({trim_sql('name')}, '')) AS value FROM main_catalog", "main_catalog"),
)
def c7(t: Tables):
    return main_catalog(t).select("id", X.first_non_empty("isbn", "source_guid_nom", "name").alias("value"))


on_part(
    "c8_clean_string_array",
    "split(concat(p_name, ' ', p_name, '  x'), ' ')",
    lambda c: F.array_join(X.clean_array(c), "|"),
    clean_list_sql("{c}"),
)


@query(
    "c9_sanitize_covers",
    with_shapes(
        "SELECT id, array_to_string(list_transform(urls, lambda u, i: concat('manual_', i, '=', u)), ',') AS value FROM ("
        " SELECT id, CASE WHEN cover_url IS NULL OR list_contains(base, cover_url) THEN base ELSE list_append(base, cover_url) END AS urls FROM ("
        " SELECT id, cover_url, [trim(covers['a']), trim(covers['b'])] AS base FROM main_catalog))",
        "main_catalog",
    ),
)
def c9(t: Tables):
    entries = F.map_entries(C.sanitize_covers("covers", "cover_url"))
    return main_catalog(t).select(
        "id", F.array_join(F.transform(entries, lambda e: F.concat(e.key, F.lit("="), e.value)), ",").alias("value")
    )


@query(
    "c10_sanitize_refs",
    with_shapes(
        "SELECT id, array_to_string(list_transform(list_filter(author_refs, lambda r: trim(r.guid) || trim(r.name) <> ''),"
        " lambda r: trim(r.guid) || ':' || trim(r.name)), '|') AS value FROM source_catalog",
        "source_catalog",
    ),
)
def c10(t: Tables):
    refs = C.sanitize_refs("author_refs", ["guid", "name"])
    return source_catalog(t).select(
        "id", F.array_join(F.transform(refs, lambda r: F.concat(r.guid, F.lit(":"), r["name"])), "|").alias("value")
    )


@query(
    "c11_names_and_refs",
    with_shapes(
        "SELECT id, array_to_string(list_transform(tag_refs, lambda r: r.name), '|') AS names,"
        " array_to_string(list_transform(list_filter(list_transform(author_names, lambda a: trim(a)), lambda a: a <> ''), lambda a: ':' || a), '|') AS refs,"
        " 'manual_1' AS cover_keys FROM source_catalog",
        "source_catalog",
    ),
)
def c11(t: Tables):
    none = F.array().cast("array<string>")
    no_refs = F.array().cast("array<struct<guid:string,name:string>>")
    df = source_catalog(t).withColumns({"no_names": none, "no_refs": no_refs})
    refs = C.refs_from_names("no_refs", "author_names")
    return df.select(
        "id",
        F.array_join(C.names_from_refs("no_names", "tag_refs"), "|").alias("names"),
        F.array_join(F.transform(refs, lambda r: F.concat(r["guid"], F.lit(":"), r["name"])), "|").alias("refs"),
        F.array_join(F.map_keys(C.covers_from_links(F.array(F.concat(F.lit("https://x.example/"), "id")))), ",").alias("cover_keys"),
    )


@query(
    "c12_description_mirror",
    with_shapes(
        "SELECT id, coalesce(nullif(trim(annotation), ''), nullif(trim(author_cover), '')) AS description,"
        " coalesce(nullif(trim(author_cover), ''), nullif(trim(annotation), '')) AS annotation FROM source_catalog",
        "source_catalog",
    ),
)
def c12(t: Tables):
    description, annotation = X.mirror("annotation", "author_cover")
    return source_catalog(t).select("id", description.alias("description"), annotation.alias("annotation"))


@query(
    "c13_source_price",
    with_shapes(
        "SELECT id, coalesce(CASE WHEN c > 0 THEN c END, CASE WHEN b > 0 THEN b END) AS price FROM (SELECT id,"
        " TRY_CAST(replace(json_extract_string(raw, '$.COST'), ',', '.') AS DOUBLE) AS c,"
        " TRY_CAST(json_extract_string(raw, '$.PRICES.TYPES[1].baseprice') AS DOUBLE) AS b FROM source_catalog)",
        "source_catalog",
    ),
)
def c13(t: Tables):
    return source_catalog(t).select("id", V.source_price(V.parse("raw")).alias("price"))


NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$'"
_L = "replace(trim({c}), ' ', '')"
on_part(
    "c14_parse_locale_float",
    LOCALE,
    N.parse_locale_float,
    "(SELECT CASE WHEN regexp_matches(p, " + NUM + ") THEN CAST(p AS DOUBLE) ELSE 0.0::DOUBLE END FROM (SELECT CASE"
    f" WHEN contains({_L}, ',') AND contains({_L}, '.') THEN CASE WHEN strpos(reverse({_L}), ',') < strpos(reverse({_L}), '.')"
    f" THEN replace(replace({_L}, '.', ''), ',', '.') ELSE replace({_L}, ',', '') END"
    f" WHEN regexp_matches({_L}, '^[^,]+,[^,]{{3}}$') OR regexp_matches({_L}, ',.*,') THEN replace({_L}, ',', '')"
    f" ELSE replace({_L}, ',', '.') END AS p))",
)
_P = "regexp_replace({c}, '[^0-9.,]', '', 'g')"
on_part(
    "c15_parse_price_text",
    PRICE_TEXT,
    N.parse_price_text,
    f"CAST(CASE WHEN contains({_P}, ',') AND contains({_P}, '.') THEN replace(replace({_P}, '.', ''), ',', '.') ELSE replace({_P}, ',', '.') END AS DOUBLE)",
)
on_part(
    "c16_parse_int_bool",
    FLAG,
    lambda c: N.parse_bool(c),
    "lower(trim({c})) IN ('1', 'true', 'yes', 'y', 'on', 'да', 'истина')",
)


@query("c16_parse_int", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) ELSE 0 END AS value FROM lineitem")
def c16(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", N.parse_int(F.col("l_extendedprice").cast("string")).alias("value"))


@query("c17_digits_to_int", "SELECT c_custkey AS id, TRY_CAST(regexp_replace(c_name || c_nationkey, '[^0-9]', '', 'g') AS BIGINT) AS value FROM customer")
def c17(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("id"), N.digits_to_int(F.concat("c_name", F.col("c_nationkey").cast("string"))).alias("value"))


@query(
    "c18_to_text",
    "SELECT event_id AS id, concat(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), ', ', event_type, ', true') AS list_text, event_type AS object_text,"
    " json_extract_string(props, '$.k') AS number_text FROM events",
)
def c18(t: Tables):
    made = F.concat(
        F.lit('{"list": ['), F.floor("value").cast("string"), F.lit('.0, {"name": " '), "event_type", F.lit(' "}, "", true], "obj": {"@id": "'), "event_type", F.lit('"}}')
    )
    v = V.parse(made)
    return t.events.select(
        F.col("event_id").alias("id"),
        V.to_text(V.at(v, "list")).alias("list_text"),
        V.to_text(V.at(v, "obj")).alias("object_text"),
        V.to_text(V.at(V.parse("props"), "k")).alias("number_text"),
    )


on_part("c19_split_list", MARKED, lambda c: F.array_join(X.split_list(c), "|"), clean_list_sql("string_split_regex({c}, '[|;,]')"))
on_part(
    "c19_split_path",
    MARKED,
    lambda c: F.array_join(X.split_path(c), "|"),
    "CASE WHEN contains({c}, ' / ') THEN " + clean_list_sql("string_split({c}, ' / ')") + " ELSE " + clean_list_sql("string_split_regex({c}, '[|,]')") + " END",
)
on_part("c19_split_links", MARKED, lambda c: F.array_join(X.split_links(c), "|"), clean_list_sql(r"string_split_regex({c}, '[\n\r|;,]')"))


def _first_sep_sql(seps: list[str], body) -> str:
    return "CASE " + " ".join(f"WHEN contains({{c}}, '{s}') THEN {body(s)}" for s in seps)


on_part(
    "c20_primary_link",
    LINKS,
    X.primary_link,
    "coalesce("
    + ", ".join(
        f"CASE WHEN contains({{c}}, '{s}') THEN list_filter(list_transform(string_split({{c}}, '{s}'), lambda x: trim(x)), lambda x: regexp_matches(lower(x), '^https?://'))[1] END"
        for s in [";", ",", "|", " "]
    )
    + ", {c})",
)
on_part(
    "c21_split_author_title",
    "concat(p_brand, CASE p_partkey % 3 WHEN 0 THEN ' | ' WHEN 1 THEN '|' ELSE ' ' END, CASE p_partkey % 2 WHEN 0 THEN p_name ELSE '' END)",
    lambda c: F.concat_ws("~", X.split_author_title(c).author, X.split_author_title(c).title),
    "CASE WHEN contains({c}, '|') AND trim(split_part({c}, '|', 2)) <> '' THEN trim(split_part({c}, '|', 1)) || '~' || trim(split_part({c}, '|', 2)) ELSE '~' || trim({c}) END",
)


def _names_sql(s: str) -> str:
    return f"array_to_string(list_filter(list_transform(string_split({{c}}, '{s}'), lambda x: trim(x)), lambda x: x <> ''), '~')"


on_part(
    "c22_split_names",
    MARKED,
    lambda c: F.array_join(X.split_names(c), "~"),
    _first_sep_sql([",", ";", "|", "/"], _names_sql) + " ELSE trim({c}) END",
)
on_part(
    "c23_slug_label",
    "concat(' ', p_name, ' (Формат) ', p_brand, CASE p_partkey % 5 WHEN 0 THEN '!' ELSE '' END)",
    X.slug_label,
    "coalesce(nullif(trim(regexp_replace(lower(trim({c})), '[^a-z0-9а-яё]+', '_', 'g'), '_'), ''), 'field')",
)


@query("c24_clean_text", f"SELECT page_id AS id, {clean_sql('html')} AS value FROM pages")
def c24(t: Tables):
    return t.pages.select(F.col("page_id").alias("id"), X.clean_text("html").alias("value"))


@query(
    "c24_entities",
    "SELECT p_partkey AS id, p_name || '— é ’ © « » & &lt; &nosuch; a&b 😀 € �' AS value FROM part",
)
def c24_entities(t: Tables):
    """Named and numeric entities of all forms, once decoded, next to text that only looks like one."""
    text = F.concat("p_name", F.lit("&#8212; &eacute; &rsquo; &copy; &#171; &#xBB; &amp; &amp;lt; &nosuch; a&b &#x1F600; &#128; &#xD800;"))
    return t.spread("part").select(F.col("p_partkey").alias("id"), X.clean_text(text).alias("value"))


HOST_RE = "'[a-z0-9-]+(\\.[a-z0-9-]+)+'"


def domain_sql(c: str) -> str:
    """Host of a client id, URL or bare host, for the id forms of the shapes."""
    v = f"lower(trim({c}))"
    host = (
        f"regexp_replace(CASE WHEN {v} LIKE 'client:%' THEN split_part({v}, ':', 2) WHEN regexp_matches({v}, '^(https?:)?//')"
        f" THEN regexp_extract({v}, '^(https?:)?//([^/?#:]*)', 2) WHEN regexp_full_match({v}, {HOST_RE}) THEN {v} ELSE '' END, '^www\\.', '')"
    )
    return f"coalesce(CASE WHEN regexp_full_match({host}, {HOST_RE}) THEN {host} END, '')"


@query(
    "c25_extract_domain",
    with_shapes(
        f"SELECT id, {domain_sql('source_guid_nom')} AS nom_domain, {domain_sql('source_guid')} AS guid_domain, {domain_sql('cover_url')} AS cover_domain FROM main_catalog",
        "main_catalog",
    ),
)
def c25(t: Tables):
    return main_catalog(t).select(
        "id",
        U.extract_domain("source_guid_nom").alias("nom_domain"),
        U.extract_domain("source_guid").alias("guid_domain"),
        U.extract_domain("cover_url").alias("cover_domain"),
    )


_IGNORED = ", ".join(f"'{s}'" for s in U.IGNORED_SEGMENTS)


def path_sql(c: str) -> str:
    segs = f"string_split(trim(lower(regexp_extract({c}, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/'), '/')"
    walked = f"CASE WHEN regexp_matches({segs}[-1], '{U.IMAGE_FILE}') THEN {segs}[:-2] ELSE {segs} END"
    kept = f"list_slice(list_filter({walked}, lambda s: s <> '' AND s NOT IN ({_IGNORED})), 1, 5)"
    host = f"regexp_replace(lower(regexp_extract({c}, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
    return f"CASE WHEN {c} IS NOT NULL THEN array_to_string(list_prepend({host}, {kept}), '|') END"


@query(
    "c26_url_category_path",
    with_shapes(
        f"SELECT id, {path_sql('cover_url')} AS value FROM main_catalog UNION ALL SELECT -1 - page_id AS id, {path_sql('url')} AS value FROM pages",
        "main_catalog",
    ),
)
def c26(t: Tables):
    covers = main_catalog(t).select("id", F.array_join(U.url_category_path("cover_url"), "|").alias("value"))
    return covers.unionByName(
        t.pages.select((F.lit(-1) - F.col("page_id")).alias("id"), F.array_join(U.url_category_path("url"), "|").alias("value"))
    )


def normal_url_sql(c: str) -> str:
    base = f"regexp_extract({c}, '^([^?#]*)', 1)"
    frag = f"regexp_extract({c}, '(#.*)$', 1)"
    pairs = f"list_filter(string_split(regexp_extract({c}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '')"
    kept = f"list_sort(list_filter({pairs}, lambda p: NOT regexp_matches(p, '^(utm_[^=]*|srsltid|gclid|fbclid|_ga|_gl|ymclid)(=|$)')))"
    joined = f"array_to_string({kept}, '&')"
    return f"{base} || CASE WHEN {joined} <> '' THEN '?' || {joined} ELSE '' END || {frag}"


@query("c27_normalize_url", f"SELECT page_id AS id, {normal_url_sql('url')} AS value FROM pages")
def c27(t: Tables):
    return t.pages.select(F.col("page_id").alias("id"), U.normalize_url("url").alias("value"))


@query(
    "c28_host_and_resolve",
    "SELECT page_id AS id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') AS host,"
    " regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b?x=1' AS rooted,"
    " regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '[^/]*$', '') || 'next.html' AS relative,"
    " regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example/i.png' AS schemeless FROM pages",
)
def c28(t: Tables):
    return t.pages.select(
        F.col("page_id").alias("id"),
        U.normalize_host(U.url_host("url")).alias("host"),
        U.resolve_url(F.lit("/a/b?x=1"), "url").alias("rooted"),
        U.resolve_url(F.lit("next.html"), "url").alias("relative"),
        U.resolve_url(F.lit("//cdn.example/i.png"), "url").alias("schemeless"),
    )


@query("c29_short_hash", "SELECT page_id AS id, substr(sha1(url), 1, 16) AS url_hash, substr(sha1(html), 1, 16) AS html_hash FROM pages")
def c29(t: Tables):
    return t.pages.select(F.col("page_id").alias("id"), X.short_hash("url").alias("url_hash"), X.short_hash("html").alias("html_hash"))


on_part(
    "c30_header_key",
    "concat(' ', p_name, '-', p_brand, ' (1/2).: \\\\;_', p_type)",
    X.header_key,
    "regexp_replace(lower(trim({c})), '[-\\\\ ./:;()_]', '', 'g')",
)


@query(
    "c31_array_prefix_eq",
    with_shapes("SELECT id, category_path[1:1] = ['Books'] AS one, category_path[1:2] = ['Books', 'ECONOMY'] AS two FROM main_catalog", "main_catalog"),
)
def c31(t: Tables):
    return main_catalog(t).select(
        "id",
        X.prefix_equals("category_path", ["Books"]).alias("one"),
        X.prefix_equals("category_path", ["Books", "ECONOMY"]).alias("two"),
    )


@query(
    "c32_path_key",
    "SELECT p_partkey AS id, k AS path_key, 'Книги|' || p_type || '|' || p_name AS decoded FROM (SELECT *, rtrim(replace(replace(to_base64(encode('Книги' || chr(31) || p_type || chr(31) || p_name)), '+', '-'), '/', '_'), '=') AS k FROM part)",
)
def c32(t: Tables):
    path = F.array(F.lit("Книги"), "p_type", "p_name")
    return t.part.select(F.col("p_partkey").alias("id"), X.path_key(path).alias("path_key")).withColumn(
        "decoded", F.array_join(X.decode_path_key("path_key"), "|")
    )


@query(
    "c33_float_eq",
    "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - l_quantity * floor(l_extendedprice / l_quantity)) < 1e-6 AS whole_unit,"
    " abs(l_discount - l_tax) < 1e-6 AS same_rate FROM lineitem",
)
def c33(t: Tables):
    whole = F.col("l_quantity") * F.floor(F.col("l_extendedprice") / F.col("l_quantity"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.float_eq(F.col("l_extendedprice"), whole).alias("whole_unit"),
        N.float_eq("l_discount", "l_tax").alias("same_rate"),
    )
