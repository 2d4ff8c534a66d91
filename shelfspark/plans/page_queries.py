"""Page tables: the given pages, and product pages built from every part."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.values import merge_missing
from shelfspark.operators import commerce as K, pages as P
from shelfspark.functions import urls as U
from shelfspark.functions.urls import discovery_score
from shelfspark.plans.registry import Tables, query
from shelfspark.plans.scalar_queries import clean_sql

KEY = "CAST(p_partkey AS STRING)"
ISBN = "concat('978', lpad(CAST(p_partkey AS STRING), 10, '0'))"

# One page per part; the template goes by the part's number.
JSON_LD = (
    "concat('<html><head><script type=\"application/ld+json\">{\"@graph\": [{\"@type\": \"WebSite\", \"name\": \"Shop\"}, {\"@type\": \"Product\", \"name\": \"', p_name, '\"},"
    " {\"@type\": [\"Thing\", \"Book\"], \"name\": \"', p_name, '\", \"isbn\": \"', " + ISBN + ", '\", \"brand\": {\"name\": \"', p_brand, '\"}, \"image\": [{\"url\": \"/i.png\"}],"
    " \"size\": {\"value\": ', CAST(p_size AS STRING), '}, \"offers\": [{\"price\": \"', CAST(p_size AS STRING), ',50\", \"priceCurrency\": \"UZS\"}]}]}</script></head><body><h1>x</h1></body></html>')"
)
NEXT = (
    "concat('<html><script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\": {\"pageProps\": {\"data\": {\"data\": {\"name\": \"', p_name, '\", \"barcode\": \"', " + ISBN + ", '\", \"bookPrice\": null, \"amount\": ',"
    " CAST(p_size AS STRING), ', \"_id\": \"id', " + KEY + ", '\", \"authors\": [{\"name\": \"', p_brand, '\"}, \"', p_brand, '\", \"B\"], \"imgUrl\": \"img/', " + KEY + ", '.png\", \"year\": 2020}}}}}</script></html>')"
)
MARKUP = (
    "concat('<html><body><div class=\"product-page\"><h1 class=\"product-title\">', p_brand, ' | ', p_name, '</h1><img src=\"/pic.png\"><div class=\"description-block\">Long &amp; <b>rich</b> text on ', p_name,"
    " '</div><table><tr><th>ISBN</th><td>', " + ISBN + ", '</td></tr><tr><td>Кол-во страниц</td><td>', CAST(p_size AS STRING), ' стр.</td></tr></table><ul><li>Формат: ', p_type, '</li></ul>"
    "<span class=\"stock\">В наличии</span></div></body></html>')"
)
GRAPH = (
    "concat('<html><head><meta property=\"og:title\" content=\"', p_name, '\"><meta name=\"description\" content=\"On ', p_name, '\"><meta property=\"og:type\" content=\"product\"/>"
    "<meta property=\"product:price:amount\" content=\"', CAST(p_size AS STRING), ',25\"><meta property=\"og:image\" content=\"/og.png\"></head><body></body></html>')"
)
WAITING = (
    "concat('<html><script>let waitingList = [{\"name\": \"\", \"url\": \"/a\"}, {\"name\": \"', p_name, '\", \"url\": \"\\\\/item\\\\/', " + KEY + ", '\", \"price\": ', CAST(p_size AS STRING), ', \"code\": \"c', " + KEY + ", '\", \"inStock\": false}];</script></html>')"
)
PLAIN = "concat('<html><body><p>Nothing about ', p_name, '</p></body></html>')"
PAGE_URL = "concat('https://shop.example/product/', CAST(p_partkey AS STRING))"


def product_pages(t: Tables):
    html = f"CASE p_partkey % 6 WHEN 0 THEN {JSON_LD} WHEN 1 THEN {NEXT} WHEN 2 THEN {MARKUP} WHEN 3 THEN {GRAPH} WHEN 4 THEN {WAITING} ELSE {PLAIN} END"
    return t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{html} AS html", "p_partkey", "p_name", "p_brand", "p_size", "p_type")


def shown(record, *keys):
    return [F.nullif(P.get(record, k), F.lit("")).alias(k) for k in keys]


@query(
    "p1_extract_products",
    "SELECT p_partkey AS page_id, CASE p_partkey % 6 WHEN 0 THEN 'jsonld' WHEN 1 THEN 'next_data' WHEN 2 THEN 'html_product' WHEN 3 THEN 'html_product' ELSE 'waiting_list_json' END AS extraction,"
    f" p_name AS title, CASE WHEN p_partkey % 6 < 3 THEN {ISBN} END AS isbn, CASE p_partkey % 6 WHEN 0 THEN p_size || '.5' WHEN 1 THEN '' || p_size WHEN 3 THEN p_size || '.25' WHEN 4 THEN '' || p_size END AS price"
    " FROM part WHERE p_partkey % 6 < 5",
)
def p1(t: Tables):
    """Every template goes through the whole ladder; the plain page gives no record."""
    out = P.extract_products(product_pages(t))
    return out.select("page_id", "extraction", *shown(F.col("record"), "title", "isbn", "price"))


@query("p1_given_pages_products", "SELECT page_id, url, '' AS extraction, '' AS title, '' AS source_url FROM pages WHERE contains(lower(html), 'schema.org/product') OR contains(lower(html), '\"@type\"')")
def p1_given(t: Tables):
    return P.extract_products(t.pages).select("page_id", "url", "extraction", *shown(F.col("record"), "title", "source_url"))


@query(
    "p2_jsonld_fields",
    f"SELECT p_partkey AS page_id, p_name AS title, {ISBN} AS isbn, p_brand AS brand, p_size || '.5' AS price, 'UZS' AS currency, '/i.png' AS image, '' || p_size AS \"size.value\", CAST(3 AS INTEGER) AS position FROM part",
)
def p2(t: Tables):
    """JSON-LD page of every part; the candidate with price and identifier wins over the bare one."""
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{JSON_LD} AS html")
    best = P.best_candidate(P.json_ld_candidates(pages))
    return best.select("page_id", *shown(F.col("record"), "title", "isbn", "brand", "price", "currency", "image", "size.value"), (F.col("position") + 1).alias("position"))


# Untyped objects: strong marks by the size, one soft mark by the part, and a page type that refuses them.
MARKS = (
    "concat('<script type=\"application/ld+json\">[{\"name\": \"', p_name, '\"', CASE WHEN p_size % 2 = 0 THEN ', \"SKU\": \"s\"' ELSE '' END, CASE WHEN p_size % 3 = 0 THEN ', \"offers\": {\"price\": 1}' ELSE '' END,"
    " CASE WHEN p_partkey % 2 = 0 THEN ', \"author\": \"A\"' ELSE '' END, '}, {\"@type\": \"Thing\", \"name\": \"n\", \"sku\": \"s\", \"price\": 1}, {\"@type\": [\"Thing\", \"AudioBook\"], \"name\": \"', p_name, '\"}, {\"sku\": \"s\", \"price\": 1}]</script>')"
)


@query(
    "p2_key_markers",
    "SELECT p_partkey AS page_id, CAST(0 AS INTEGER) AS position, p_name AS title FROM part WHERE p_size % 6 = 0 OR (p_partkey % 2 = 0 AND (p_size % 2 = 0 OR p_size % 3 = 0)) UNION ALL SELECT p_partkey, 2, p_name FROM part",
)
def p2_marks(t: Tables):
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{MARKS} AS html")
    found = P.json_ld_candidates(pages, by_marks=True)
    return found.select("page_id", "position", P.get(F.col("record"), "title").alias("title"))


@query(
    "w8_best_structured_candidate",
    "SELECT p_partkey AS page_id, CAST(4 + CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS score, CAST(2 AS BIGINT) AS candidates FROM part",
)
def w8(t: Tables):
    """Titles alone against a candidate whose price and image come and go with the size."""
    varied = f"replace(replace({JSON_LD}, CASE WHEN p_size % 2 = 0 THEN '~' ELSE '\"price\"' END, '\"was\"'), CASE WHEN p_size % 3 = 0 THEN '~' ELSE '\"image\"' END, '\"was\"')"
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{varied} AS html")
    return P.best_candidate(P.json_ld_candidates(pages)).select("page_id", "score", "candidates")


@query(
    "p3_next_data_fields",
    f"SELECT p_partkey AS page_id, p_name AS title, {ISBN} AS isbn, {ISBN} AS barcode, '' || p_size AS price, 'id' || p_partkey AS sku, p_brand || ', B' AS author_names,"
    " 'https://shop.example/product/img/' || p_partkey || '.png' AS image, CASE WHEN p_size > 0 THEN 'in_stock' ELSE 'out_of_stock' END AS availability, '2020' AS year FROM part",
)
def p3(t: Tables):
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{NEXT} AS html")
    record = pages.select("page_id", P.next_data_record("html", F.col("url")).alias("record"))
    return record.select("page_id", *shown(F.col("record"), "title", "isbn", "barcode", "price", "sku", "author_names", "image", "availability", "year"))


# A page whose parts disagree: application state, then an untyped and a typed JSON-LD object, then meta tags.
MIXED = f"concat(CASE WHEN p_partkey % 2 = 0 THEN {NEXT} ELSE '' END, CASE WHEN p_partkey % 3 < 2 THEN {MARKS} ELSE '' END, CASE WHEN p_partkey % 5 < 3 THEN {GRAPH} ELSE '' END)"


@query(
    "p3_first_value_kept",
    f"SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 < 2 THEN 'jsonld' WHEN p_partkey % 2 = 0 THEN 'next_data' ELSE 'opengraph' END AS extraction, p_name AS title,"
    f" CASE WHEN p_partkey % 2 = 0 THEN {ISBN} END AS isbn, CASE WHEN p_partkey % 2 = 0 THEN 'id' || p_partkey END AS sku,"
    " CASE WHEN p_partkey % 2 = 0 THEN '' || p_size WHEN p_partkey % 3 < 2 AND p_size % 6 = 0 THEN '1' WHEN p_partkey % 5 < 3 THEN p_size || '.25' END AS price,"
    " CASE WHEN p_partkey % 2 = 0 THEN 'https://shop.example/product/img/' || p_partkey || '.png' WHEN p_partkey % 5 < 3 THEN '/og.png' END AS image,"
    " CASE WHEN p_partkey % 5 < 3 THEN 'On ' || p_name END AS description FROM part"
    " WHERE p_partkey % 2 = 0 OR p_partkey % 3 < 2 OR p_partkey % 5 < 3",
)
def p3_first(t: Tables):
    """Each field comes from the first part that has it, application state before JSON-LD before meta tags."""
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{MIXED} AS html")
    found = P.first_value_products(pages)
    return found.select("page_id", "extraction", *shown(F.col("record"), "title", "isbn", "sku", "price", "image", "description"))


@query(
    "p4_html_fields",
    f"SELECT p_partkey AS page_id, p_name AS title, p_brand AS author_names, 'Long & rich text on ' || p_name AS description, '/pic.png' AS image, {ISBN} AS isbn, '' || p_size AS pages, p_type AS format, 'in_stock' AS availability FROM part",
)
def p4(t: Tables):
    pages = P.scan_pages(t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{MARKUP} AS html"))
    record = pages.withColumn("meta", P.meta_map("html")).select("page_id", P.html_record(F.col("meta"), "html", F.col("url")).alias("record"))
    return record.select("page_id", *shown(F.col("record"), "title", "author_names", "description", "image", "isbn", "pages", "format", "availability"))


@query("p4_given_page_titles", f"SELECT page_id, {clean_sql(chr(34) + 'h' + chr(34))} AS title FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS h FROM pages)")
def p4_given(t: Tables):
    """Visible title of every given page."""
    scanned = P.scan_pages(t.pages)
    first = F.get(F.filter("elements", lambda e: e["tag"] == "h1"), F.lit(0))["text"]
    return scanned.select("page_id", first.alias("title"))


@query(
    "p5_opengraph_fields",
    "SELECT p_partkey AS page_id, p_name AS title, 'On ' || p_name AS description, '/og.png' AS image, p_size || '.25' AS price, 'product' AS \"meta.og:type\" FROM part",
)
def p5(t: Tables):
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{GRAPH} AS html").withColumn("meta", P.meta_map("html"))
    record = pages.select("page_id", P.with_meta(P.open_graph_record(F.col("meta"), F.col("url")), F.col("meta")).alias("record"))
    return record.select("page_id", *shown(F.col("record"), "title", "description", "image", "price", "meta.og:type"))


@query(
    "p6_embedded_list_fields",
    "SELECT p_partkey AS page_id, p_name AS title, 'https://shop.example/item/' || p_partkey AS source_url, '' || p_size AS price, 'c' || p_partkey AS sku, 'out_of_stock' AS availability FROM part",
)
def p6(t: Tables):
    pages = t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{WAITING} AS html")
    record = pages.select("page_id", P.embedded_list_record("html", F.col("url")).alias("record"))
    return record.select("page_id", *shown(F.col("record"), "title", "source_url", "price", "sku", "availability"))


MICRO = (
    "concat('<div itemscope itemtype=\"https://schema.org/Book\"><span itemprop=\"name\">', p_name, '</span><meta itemprop=\"price\" content=\"', CAST(p_size AS STRING), '\"><b class=\"product-author\">', p_brand,"
    " '</b><i class=\"product-title\">Other</i><a data-sku=\"s', " + KEY + ", '\">Buy</a></div>')"
)


@query("p7_microdata_fields", "SELECT p_partkey AS page_id, p_name AS title, '' || p_size AS price, p_brand AS author_names, 's' || p_partkey AS sku FROM part")
def p7(t: Tables):
    pages = P.scan_pages(t.spread("part").selectExpr("p_partkey AS page_id", f"{PAGE_URL} AS url", f"{MICRO} AS html"))
    return pages.select("page_id", P.microdata_record(F.col("url")).alias("record")).select("page_id", *shown(F.col("record"), "title", "price", "author_names", "sku"))


@query(
    "p8_attribute_rows",
    f"SELECT p_partkey AS page_id, 'ISBN' AS name, {ISBN} AS value, 'isbn' AS field FROM part UNION ALL SELECT p_partkey, 'Кол-во страниц', p_size || ' стр.', 'pages' FROM part"
    " UNION ALL SELECT p_partkey, 'Формат', p_type, 'format' FROM part",
)
def p8(t: Tables):
    pages = P.scan_pages(t.spread("part").selectExpr("p_partkey AS page_id", f"{MARKUP} AS html"))
    return P.attribute_rows(pages).select("page_id", "name", "value", "field")


# Several labels in one text, and rows, cells and list items whose end tags are left out.
INLINE = (
    "concat('<div class=\"product-data\"><p>Автор: ', p_brand, ' Формат: ', p_type, ' Страниц: ', CAST(p_size AS STRING), '<p>ISBN: ', " + ISBN + ", '</div>')"
)
OPEN_TAGS = (
    "concat('<div class=\"attributes\"><table><tr><td>ISBN<td>', " + ISBN + ", '<tr><th>Страниц<td>', CAST(p_size AS STRING), '</table><ul><li>Формат: ', p_type, '<li>Автор: ', p_brand, '</ul></div>')"
)


@query(
    "p8_inline_rows",
    "SELECT p_partkey AS page_id, unnest(['Автор', 'Формат', 'Страниц', 'ISBN']) AS name, unnest([p_brand, p_type, '' || p_size, " + ISBN + "]) AS value, unnest(['author_names', 'format', 'pages', 'isbn']) AS field FROM part",
)
def p8_inline(t: Tables):
    pages = P.scan_pages(t.spread("part").selectExpr("p_partkey AS page_id", f"{INLINE} AS html"))
    return P.attribute_rows(pages).select("page_id", "name", "value", "field")


@query(
    "p8_rows_without_end_tags",
    "SELECT p_partkey AS page_id, unnest(['ISBN', 'Страниц', 'Формат', 'Автор']) AS name, unnest([" + ISBN + ", '' || p_size, p_type, p_brand]) AS value, unnest(['isbn', 'pages', 'format', 'author_names']) AS field FROM part",
)
def p8_open(t: Tables):
    pages = P.scan_pages(t.spread("part").selectExpr("p_partkey AS page_id", f"{OPEN_TAGS} AS html"))
    return P.attribute_rows(pages).select("page_id", "name", "value", "field")


@query(
    "p9_product_gate",
    "SELECT p_partkey AS page_id, p_size % 2 = 0 OR p_size % 3 = 0 AS jsonld, true AS html_product, p_size % 2 = 0 OR p_size % 3 = 0 AS opengraph FROM part",
)
def p9(t: Tables):
    """Records with an ISBN on even sizes and a price on sizes that three divides, all on product URLs."""
    record = P._record(
        ("title", F.col("p_name")),
        ("isbn", F.when(F.col("p_size") % 2 == 0, F.lit("9780000000000"))),
        ("price", F.when(F.col("p_size") % 3 == 0, F.lit("10"))),
        ("image", F.lit("/i.png")),
    )
    signals = P.page_signals(F.expr(PAGE_URL), F.create_map().cast("map<string,string>"), F.lit(""))
    rows = t.spread("part").select(F.col("p_partkey").alias("page_id"), record.alias("record"), signals.alias("page"))
    return rows.select("page_id", *[P.product_gate(F.col("record"), s, F.col("page")).alias(s) for s in ("jsonld", "html_product", "opengraph")])


@query(
    "p10_merge_missing",
    "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN p_brand ELSE p_name END AS a, p_type AS b, '' || p_size AS c FROM part",
)
def p10(t: Tables):
    left = F.create_map(F.lit("a"), F.when(F.col("p_partkey") % 3 == 0, F.lit(" ")).otherwise(F.col("p_name")), F.lit("b"), F.col("p_type"))
    right = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.lit("unused"), F.lit("c"), F.col("p_size").cast("string"))
    merged = merge_missing(left, right)
    return t.part.select(F.col("p_partkey").alias("id"), *[F.element_at(merged, F.lit(k)).alias(k) for k in "abc"])


LINKS_SQL = (
    "SELECT DISTINCT url AS src, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS dst FROM (SELECT url, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"(/[^\"]*)\"', 1)) AS href FROM pages)"
    " WHERE NOT regexp_matches(lower(href), '\\.(jpg|jpeg|png|gif|svg|webp|css|js|json|xml|pdf|zip|mp4|mp3)$')"
)


@query("p11_page_links", LINKS_SQL)
def p11(t: Tables):
    return P.page_links(t.pages)


@query("p12_embedded_product_urls", "SELECT 'https://shop.example/product/' || p_partkey AS src, 'https://shop.example/item/' || p_partkey AS dst FROM part")
def p12(t: Tables):
    pages = t.spread("part").selectExpr(f"{PAGE_URL} AS url", f"{WAITING} AS html")
    return P.embedded_urls(pages)


# Addresses of the given pages: the path decides, no token of the score lists occurs in it but the slash count and the query mark.
@query(
    "p13_url_scores",
    "SELECT page_id, CASE WHEN contains(url, '?') THEN -1 ELSE 0 END + CASE WHEN length(url) - length(replace(url, '/', '')) >= 4 THEN 2 ELSE 0 END AS product_score, false AS likely FROM pages",
)
def p13(t: Tables):
    scored = P.score_urls(t.pages.select("page_id", "url"))
    return scored.select("page_id", "product_score", "likely")


def _any(text: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in tokens) + ")"


def _worth(*rules: tuple[str, int]) -> str:
    return " + ".join(f"CASE WHEN {condition} THEN {points} ELSE 0 END" for condition, points in rules)


def _re(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def scores_sql(source: str, depth: str) -> str:
    """product_score, likely, parse_score and discovery_score of the urls of a statement, its other columns kept."""
    books = lambda c: f"NOT contains({c}, '/catalog/books/') AND NOT contains({c}, '/catalogue/books/')"
    roots = ", ".join(f"'{x}'" for x in U.ROOT_PAGES)
    likely = (
        f"CASE WHEN trim(url) = '' THEN false WHEN contains(path, '/catalog/product/') OR {_re('path', U.P_BOOK_DETAILS)} OR {_re('path', U.P_CATALOG_SLUG)} THEN true"
        f" WHEN ({_re('path', U.P_BOOK_DEEP)} OR {_re('path', U.P_BOOK_SINGLE)}) AND {books('path')} THEN true"
        f" WHEN {_re('path', U.P_CATALOG_DEEP)} AND NOT contains(path, '/filter/') AND NOT contains(path, '/search/') THEN true WHEN {_any('path', U.LISTING_PATHS)} THEN false"
        f" WHEN {_any('low', ['route=product/product', 'product_id='])} OR {_any('path', U.ITEM_PATHS)} THEN true"
        f" WHEN (contains(path, '/book/') OR contains(path, '/p/')) AND {_re('path', U.P_TRAILING_ID)} THEN true ELSE slug END"
    )
    product = _worth(
        (_re("low", U.P_PRODUCT_WORD), 3), ("contains(low, '/catalog/product/')", 18), (_re("path", U.P_BOOK_DETAILS), 14), (_re("low", U.P_CATALOG_SLUG), 18),
        (f"{_re('low', U.P_BOOK_DEEP)} AND {books('low')}", 7), (f"{_re('path', U.P_BOOK_SINGLE)} AND {books('path')}", 4), (_re("low", U.P_CATALOG_DEEP), 8),
        (_any("low", ["/product/", "/products/"]), 16), (_any("low", ["route=product/product", "product_id="]), 16), (f"{_any('low', ['/book/', '/books/'])} AND {books('low')}", 3),
        (_any("low", ["/item/", "/dp/"]), 8), ("contains(low, 'isbn')", 5), *[(f"contains(low, '{x}')", -8) for x in U.DEMOTED_TOKENS],
        (f"contains(low, '/catalog/') AND NOT contains(low, '/catalog/product/') AND NOT {_re('low', U.P_CATALOG_SLUG)} AND NOT {_re('low', U.P_CATALOG_DEEP)}", -8),
        ("slug", 9), ("blocked", -10), ("contains(low, '?')", -1), (_re("low", r"\.(jpg|png)$"), -10), ("length(low) - length(replace(low, '/', '')) >= 4", 2),
    )
    shaped = f"contains(low, '/catalog/product/') OR {_re('low', U.P_CATALOG_SLUG)} OR {_re('low', U.P_BOOK_DEEP)} OR {_re('low', U.P_CATALOG_DEEP)} OR {_any('low', U.PRODUCT_URL_TOKENS)}"
    listing = f"CASE WHEN likely THEN false WHEN {_re('low', U.P_PAGINATION)} THEN true WHEN {_any('low', U.NON_PRODUCT_TOKENS)} THEN NOT {_any('low', ['/product/', '/book/'])} ELSE false END"
    parse = "product_score + " + _worth(("likely", 20), (shaped, 6), (listing, -30), (_any("low", U.EDITORIAL_TOKENS), -25))
    found = "product_score + " + _worth(
        *[(f"contains(low, '{x}')", 2) for x in U.DISCOVERY_GOOD], *[(f"contains(low, '{x}')", -6) for x in U.DISCOVERY_BAD], *[(f"contains(low, '{x}')", -10) for x in U.DISCOVERY_WORSE], ("likely", 8)
    )
    return (
        f"(SELECT *, CAST({parse} AS INTEGER) AS parse_score, CAST({found} + CASE WHEN {depth} <= 1 THEN 2 ELSE -{depth} END AS INTEGER) AS discovery_score FROM (SELECT *, CAST({product} AS INTEGER) AS product_score, {likely} AS likely FROM ("
        f"SELECT *, {_re('path', U.P_ROOT_SLUG)} AND NOT blocked AS slug FROM (SELECT *, trim(path, '/') = '' OR trim(path, '/') IN ({roots}) AS blocked FROM ("
        f"SELECT *, lower(url) AS low, lower(coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), url)) AS path FROM ({source}))))))"
    )


SHAPED_URLS = (
    "CASE p_partkey % 8 WHEN 0 THEN 'https://a.example/catalog/product/' WHEN 1 THEN 'https://a.example/books/details/' WHEN 2 THEN 'http://a.example/category/' WHEN 3 THEN 'https://a.example/blog/'"
    " WHEN 4 THEN 'https://a.example/index.php?route=product/product&product_id=' WHEN 5 THEN 'https://a.example/some-long-slug-' WHEN 6 THEN 'https://a.example/page/' ELSE 'https://a.example/book/' END"
)


@query(
    "p13_catalog_url_scores",
    "SELECT id, url, product_score, parse_score, likely, discovery_score FROM " + scores_sql(f"SELECT p_partkey AS id, concat({SHAPED_URLS}, CAST(p_partkey AS VARCHAR)) AS url FROM part", "2"),
)
def p13_catalog(t: Tables):
    """All three scores over addresses of many shapes, one per part."""
    urls = t.spread("part").selectExpr("p_partkey AS id", f"concat({SHAPED_URLS}, CAST(p_partkey AS STRING)) AS url")
    return P.score_urls(urls).withColumn("discovery_score", discovery_score("url", F.lit(2)))


@query(
    "w5_rank_candidate_urls",
    "SELECT url FROM (SELECT DISTINCT url, CASE WHEN contains(url, '?') THEN -1 ELSE 0 END + CASE WHEN length(url) - length(replace(url, '/', '')) >= 4 THEN 2 ELSE 0 END AS s FROM pages) ORDER BY s DESC, url",
)
def w5(t: Tables):
    return P.rank_urls(t.pages).select("url")


@query(
    "w5_per_host",
    "SELECT url, CAST(host_rank AS INTEGER) AS host_rank FROM (SELECT url, row_number() OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') ORDER BY s DESC, url) AS host_rank"
    " FROM (SELECT DISTINCT url, CASE WHEN contains(url, '?') THEN -1 ELSE 0 END + CASE WHEN length(url) - length(replace(url, '/', '')) >= 4 THEN 2 ELSE 0 END AS s FROM pages)) WHERE host_rank <= 2",
)
def w5_hosts(t: Tables):
    return P.rank_urls(t.pages, per_host=2).select("url", "host_rank")


@query(
    "w6_merge_crawl_candidates",
    "WITH c AS (SELECT url, page_id % 7 AS score, 0 AS tier FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, page_id % 5 + 9, 1 FROM pages)"
    " SELECT url, CAST(tier AS INTEGER) AS tier, score FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY tier, score DESC) AS r FROM c) WHERE r = 1 ORDER BY tier, score DESC, url LIMIT 40",
)
def w6(t: Tables):
    confirmed = t.pages.where("page_id % 2 = 0").selectExpr("url", "page_id % 7 AS score")
    likely = t.pages.selectExpr("url", "page_id % 5 + 9 AS score")
    return K.merge_candidates(confirmed, likely, 40)


@query("b1_union_candidates", f"SELECT url FROM pages UNION SELECT dst FROM ({LINKS_SQL}) UNION SELECT 'https://shop.example/product/' || p_partkey FROM part")
def b1(t: Tables):
    crawled = P.page_links(t.pages).select(F.col("dst").alias("url"))
    return P.union_candidates(t.pages, crawled, t.part.selectExpr(f"{PAGE_URL} AS url"))


FETCHES = (
    "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 429 ELSE 503 END AS status, CASE doc_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' ELSE '' END AS content_type,"
    " concat(text, CASE doc_id % 7 WHEN 0 THEN ' CloudFlare' WHEN 1 THEN ' captcha: verify you are human' WHEN 2 THEN ' Rate limit exceeded' ELSE '' END) AS body FROM documents"
)
_B = "lower(body)"


@query(
    "p14_classify_fetch",
    "SELECT id, CASE "
    + " ".join(f"WHEN contains({_B}, '{token}') THEN '{reason}'" for token, reason in P.BLOCK_MARKS)
    + f" WHEN contains({_B}, 'captcha') AND contains({_B}, 'verify you are human') THEN 'captcha challenge' WHEN status IN (403, 429, 503) AND content_type = 'text/html' THEN 'http ' || status ELSE '' END AS block_reason,"
    f" status = 429 OR (content_type IN ('', 'text/html') AND (contains({_B}, 'rate limit exceeded') OR contains({_B}, 'too many requests'))) AS rate_limited FROM ({FETCHES})",
)
def p14(t: Tables):
    log = t.documents.selectExpr(
        "doc_id AS id",
        "CASE doc_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 429 ELSE 503 END AS status",
        "CASE doc_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' ELSE '' END AS content_type",
        "concat(text, CASE doc_id % 7 WHEN 0 THEN ' CloudFlare' WHEN 1 THEN ' captcha: verify you are human' WHEN 2 THEN ' Rate limit exceeded' ELSE '' END) AS body",
    )
    return P.classify_fetch(log).select("id", "block_reason", "rate_limited")


@query(
    "p15_crawl_frontier",
    "SELECT url, discovery_score AS score, CAST(2 AS INTEGER) AS depth FROM " + scores_sql(f"SELECT DISTINCT dst AS url FROM ({LINKS_SQL}) WHERE dst NOT IN (SELECT url FROM pages)", "2")
    + " WHERE discovery_score >= -2 ORDER BY score DESC, url LIMIT 200",
)
def p15(t: Tables):
    """Links of the given pages not fetched yet, best discovery score first."""
    links = P.page_links(t.pages).select(F.col("dst").alias("url"), F.lit(2).alias("depth"))
    return P.frontier(links, t.pages, 200, max_depth=4, min_score=-2)
