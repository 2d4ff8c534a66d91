"""Product records, links and scores out of a table of fetched pages (page_id, url, html)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfspark.functions.html_scan import SCAN_SCHEMA, scan_batches
from shelfspark.functions.numbers import number_text
from shelfspark.functions.text import (
    clean_text,
    first_non_empty,
    non_blank,
    norm_isbn_page,
    or_empty,
    slug_label,
    split_author_title,
    split_names,
    trim_all,
)
from shelfspark.functions.urls import (
    NON_PRODUCT_TITLES,
    any_token,
    crawl_url,
    discovery_score,
    is_likely_product,
    looks_like_product_url,
    non_product_url,
    parse_score,
    points,
    product_score,
    resolve_url,
    normalize_host,
    total,
    url_host,
    url_path,
)
from shelfspark.functions.values import (
    as_list,
    at,
    first_of_equals,
    flatten,
    kind,
    let,
    map_of,
    merge_missing,
    parse,
    texts,
    to_number,
)

NO_FIELDS = "map<string,string>"

# Marks of a product page in its source.
BODY_MARKS = [
    '"@type":"product"', '"@type": "product"', "schema.org/product", "product:price:amount", 'itemprop="sku"',
    'itemprop="isbn"', 'itemprop="gtin"', "product-detail-page__title", "product-detail__title", 'class="product-info"',
    'id="tab-attribute"', "route=product/product", "product_id=",
]
META_MARKS = ["product:price:amount", "product:price:currency", "product:availability", "product:retailer_item_id"]

# Label tokens of attribute rows and the field they fill, first hit wins.
ATTRIBUTE_FIELDS = [
    ("isbn", ["isbn"]),
    ("sku", ["артикул", "sku", "код"]),
    ("author_names", ["автор", "author"]),
    ("pages", ["страниц", "pages"]),
    ("format", ["формат", "format"]),
    ("binding_type", ["облож", "binding"]),
    ("age_restriction", ["возраст", "age"]),
    ("original_title", ["оригиналь", "original"]),
    ("translator", ["переводчик", "translator"]),
    ("editor", ["редактор", "editor"]),
    ("painter", ["художник", "illustrator", "painter"]),
    ("publication_date", ["дата выхода", "издания", "publish"]),
    ("price", ["цена", "price"]),
]

# First body token that explains a refused fetch.
BLOCK_MARKS = [
    ("ddos-guard", "ddos-guard"),
    ("js-challenge", "ddos-guard challenge"),
    ("checking your browser", "anti-bot browser challenge"),
    ("cloudflare", "cloudflare challenge"),
    ("cf-chl", "cloudflare challenge"),
    ("g-recaptcha", "captcha challenge"),
    ("hcaptcha", "captcha challenge"),
    ("captcha challenge", "captcha challenge"),
    ("access denied", "access denied"),
    ("forbidden", "forbidden"),
]
HUMAN_CHECKS = ["verify you are human", "подтвердите, что вы человек", "i'm not a robot"]
RATE_PHRASES = ["too many requests", "you've made too many requests", "rate limit exceeded", "429 too many requests"]

# Product addresses inside page source.
EMBEDDED_PATTERNS = [
    r"(?i)https?://[^\"'\s<>]+/(?:product|products|item|dp|book|books)/[^\"'\s<>]+",
    r"(?i)/(?:product|products|item|dp|book|books)/[a-z0-9%._~\-/]+",
    r"(?i)(?:product|products|item|dp|book|books)/[a-z0-9%._~\-/]+",
    r"(?i)/catalog/[0-9]{2,}/[0-9]{3,}[a-z0-9%._~\-/]*",
    r"(?i)\\/(?:product|products|item|dp|book|books)\\/[a-z0-9%._~\\\-/]+",
    r"(?i)(?:product|products|item|dp|book|books)\\/[a-z0-9%._~\\\-/]+",
    r"(?i)\\/catalog\\/[0-9]{2,}\\/[0-9]{3,}[a-z0-9%._~\\\-/]*",
]


def _entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def _record(*entries: tuple[str, Column]) -> Column:
    """Map of the non-blank fields; a later entry of the same key is dropped."""
    listed = F.filter(F.array(*[_entry(k, v) for k, v in entries]), lambda e: e["value"].isNotNull() & (trim_all(e["value"]) != ""))
    return map_of(listed)


def get(record: Column, key: str) -> Column:
    return or_empty(F.element_at(record, F.lit(key)))


def in_place(value: Column) -> Column:
    """The value itself, kept where it is computed.

    A null filter above a projection is pushed below it, and a costly
    expression is then written out again for the filter, step by step down the
    plan. A value that names the task cannot be moved; the task number itself
    changes nothing.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _attr(tag: Column, name: str) -> Column:
    raw = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return trim_all(F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def meta_map(html: Column | str) -> Column:
    """Meta tags as map: property, else name, in lower case, to content; the last of equals counts."""
    source = F.col(html) if isinstance(html, str) else html
    tags = F.reverse(F.regexp_extract_all(source, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)))
    pairs = F.transform(
        tags,
        lambda t: F.struct(
            F.lower(F.coalesce(non_blank(_attr(t, "property")), _attr(t, "name"))).alias("key"),
            clean_text(_attr(t, "content")).alias("value"),
        ),
    )
    return map_of(F.filter(pairs, lambda p: (p["key"] != "") & (p["value"] != "")))


def json_ld_items(html: Column | str) -> Column:
    """All JSON-LD objects of a page in order, members of @graph before their holder."""
    source = F.col(html) if isinstance(html, str) else html
    scripts = F.regexp_extract_all(source, F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    empty = F.array().cast("array<variant>")

    def members(v: Column) -> Column:
        return F.coalesce(F.when(kind(v) == "ARRAY", as_list(v)).when(kind(v) == "OBJECT", F.array(v)), empty)

    def graph(v: Column) -> Column:
        return F.coalesce(F.when(kind(at(v, "@graph")) == "ARRAY", as_list(at(v, "@graph"))), empty)

    docs = F.transform(scripts, lambda s: parse(trim_all(s)))
    top = F.flatten(F.transform(docs, members))
    return F.flatten(F.transform(top, lambda v: F.concat(F.flatten(F.transform(graph(v), lambda g: F.concat(graph(g), F.array(g)))), F.array(v))))


def is_product_type(v: Column) -> Column:
    """`Product` or `Book`, alone or in a list of types."""
    kinds = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))
    return F.coalesce(F.exists(kinds, lambda k: F.lower(trim_all(k)).isin("product", "book")), F.lit(False))


# Types that are no product, and keys that mark one, by weight.
PAGE_TYPES = ["website", "webpage", "organization", "localbusiness", "store", "breadcrumblist", "itemlist", "searchaction", "thing"]
STRONG_KEYS = ["offers", "price", "sku", "isbn", "gtin", "gtin13", "gtin14", "productid", "availability"]
SOFT_KEYS = ["aggregaterating", "review", "author", "publisher", "brand", "numberofpages", "bookformat", "description", "image"]


def is_product_like(v: Column) -> Column:
    """A product by its type, or a named object with two strong marks, or a strong and a soft one, unless its types are all of pages."""

    def count(keys: Column, marks: list[str]) -> Column:
        return F.size(F.array_intersect(keys, F.array(*map(F.lit, marks))))

    def body(item: Column) -> Column:
        kinds = F.transform(F.coalesce(F.try_variant_get(item, "$.@type", "array<string>"), F.array(F.try_variant_get(item, "$.@type", "string"))), lambda k: F.lower(k))
        kinds = F.filter(kinds, lambda k: or_empty(k) != "")
        keys = F.transform(F.map_keys(F.try_variant_get(item, "$", "map<string,variant>")), lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", ""))
        typed = F.exists(kinds, lambda k: k.rlike("product|book"))
        refused = (F.size(kinds) > 0) & (F.size(F.array_except(kinds, F.array(*map(F.lit, PAGE_TYPES)))) == 0)
        named = F.arrays_overlap(keys, F.array(F.lit("name"), F.lit("title")))
        marked = (count(keys, STRONG_KEYS) >= 2) | ((count(keys, STRONG_KEYS) >= 1) & (count(keys, SOFT_KEYS) >= 1))
        return F.coalesce(typed | (~refused & named & marked), F.lit(False))

    return let(v, body)


def _image(v: Column) -> Column:
    def one(x: Column) -> Column:
        link = F.when(kind(x) == "OBJECT", F.try_variant_get(x, "$.url", "string")).when(kind(x) == "STRING", F.try_variant_get(x, "$", "string"))
        return trim_all(link)

    def body(x: Column) -> Column:
        first = F.get(F.filter(F.transform(as_list(x), one), lambda t: t != ""), F.lit(0))
        return F.coalesce(first, one(x))

    return let(v, body)


def json_ld_record(item: Column, url: Column) -> Column:
    """Fields of one JSON-LD product with the rest flattened to depth 3; no name gives null."""

    def first_offer(v: Column) -> Column:
        return F.coalesce(F.get(as_list(v), F.lit(0)), v)

    def body(t: Column) -> Column:
        named = _record(
            ("title", get(t, "name")),
            ("source_url", F.coalesce(non_blank(get(t, "url")), url)),
            ("extraction", F.lit("jsonld")),
            ("description", get(t, "description")),
            ("image", _image(at(item, "image"))),
            ("sku", get(t, "sku")),
            ("isbn", first_non_empty(get(t, "isbn"), get(t, "isbn13"))),
            ("gtin", first_non_empty(*[get(t, k) for k in ("gtin", "gtin13", "gtin14", "gtin12")])),
            ("brand", get(t, "brand")),
            ("price", let(to_number(at(offer, "price")), number_text)),
            ("currency", F.try_variant_get(offer, "$.priceCurrency", "string")),
            ("availability", F.try_variant_get(offer, "$.availability", "string")),
            ("rating", let(to_number(at(at(item, "aggregateRating"), "ratingValue")), number_text)),
            ("review_count", F.regexp_replace(F.try_variant_get(item, "$.aggregateRating.reviewCount", "string"), "[^0-9]", "")),
        )
        whole = F.map_zip_with(named, flatten(item, 3), lambda _, x, y: F.coalesce(x, y))
        return F.when(get(t, "name") != "", whole)

    offer = let(at(item, "offers"), first_offer)
    return let(texts(item), body)


def record_score(record: Column) -> Column:
    """Weight of a structured candidate: title, price and an identifier count double."""
    has_id = F.concat(get(record, "gtin"), get(record, "isbn"), get(record, "sku")) != ""
    return total(
        points(get(record, "title") != "", 2),
        points(get(record, "price") != "", 2),
        points(get(record, "description") != "", 1),
        points(get(record, "image") != "", 1),
        points(has_id, 2),
    )


def json_ld_candidates(pages: DataFrame, by_marks: bool = False) -> DataFrame:
    """(page_id, url, position, record, score) for every product object of every page; with by_marks also untyped ones that look like one."""
    items = pages.select("page_id", "url", F.posexplode(json_ld_items("html")).alias("position", "item"))
    products = items.where(is_product_like(F.col("item")) if by_marks else is_product_type(at(F.col("item"), "@type")))
    records = products.select("page_id", "url", "position", in_place(json_ld_record(F.col("item"), F.col("url"))).alias("record"))
    named = records.where(F.col("record").isNotNull())
    return named.withColumn("score", record_score(F.col("record")))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Per page the highest score, the first among equals, and the number of `candidates` it was picked from.

    One pass, reduced on the map side: a record is far dearer to read out of its page than to carry along.
    """
    held = F.struct(*[c for c in candidates.columns if c != "page_id"])
    rank = F.struct((-F.col("score")).alias("rank"), "position")
    best = candidates.groupBy("page_id").agg(F.min_by(held, rank).alias("best"), F.count(F.lit(1)).alias("candidates"))
    return best.select("page_id", "best.*", "candidates")


def best_json_ld(html: Column | str, url: Column) -> Column:
    """The same pick inside the row, with no exchange: a page's own objects are few."""
    records = F.filter(
        F.transform(F.filter(json_ld_items(html), lambda v: is_product_type(at(v, "@type"))), lambda v: json_ld_record(v, url)),
        lambda r: r.isNotNull(),
    )

    def pick(rs: Column) -> Column:
        ranked = F.transform(rs, lambda r, i: F.struct((-record_score(r)).alias("rank"), i.alias("at")))
        return F.get(rs, F.array_min(ranked)["at"])

    return let(records, pick)


NEXT_KEEP = [
    "link", "year", "numberOfPage", "paperFormat", "language", "cover", "state", "rating", "rateCount", "viewsCount",
    "stockCount", "availableCount", "bookPrice", "ebookPrice", "audioPrice", "potcastPrice",
]
NEXT_PRICES = ["bookPrice", "price", "amount", "ebookPrice", "audioPrice"]


def _fold_names(v: Column) -> Column:
    """Names out of a text, an object or a list of either; repeats in any case drop."""

    def one(x: Column) -> Column:
        named = first_non_empty(*[F.try_variant_get(x, f"$.{n}", "string") for n in ("name", "fullName", "title")])
        return clean_text(F.when(kind(x) == "OBJECT", named).when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")))

    def body(x: Column) -> Column:
        listed = F.when(kind(x) == "ARRAY", as_list(x)).when(kind(x) != "VOID", F.array(x))
        return F.filter(F.transform(listed, one), lambda n: or_empty(n) != "")

    return F.array_join(first_of_equals(let(v, body), lambda n: F.lower(n)), ", ")


def next_data_record(html: Column | str, url: Column) -> Column:
    """Product of a page's embedded application state; none gives null."""
    source = F.col(html) if isinstance(html, str) else html
    text = F.regexp_extract(source, r"(?is)<script[^>]*id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    props = at(at(parse(F.nullif(trim_all(text), F.lit(""))), "props"), "pageProps")
    return let(props, lambda pp: let(_next_product(pp), lambda p: F.when(p.isNotNull(), _next_record(p, pp, url))))


def _next_product(props: Column) -> Column:
    """First of the usual places that holds a named, marked product."""
    spots = F.array(at(props, "data"), at(at(props, "data"), "data"), at(props, "product"), at(props, "book"), at(props, "item"))

    def usable(p: Column) -> Column:
        def some(*names: str) -> Column:
            held = [F.coalesce(F.try_variant_get(p, f"$.{n}", "string"), F.lit("")) for n in names]
            return trim_all(F.concat(*held)) != ""

        marked = some("bookPrice", "price", "barcode", "isbn", "link", "_id", "id")
        return F.coalesce((kind(p) == "OBJECT") & some("name", "title") & marked, F.lit(False))

    return F.get(F.filter(spots, usable), F.lit(0))


def _next_record(p: Column, props: Column, url: Column) -> Column:
    def said(x: Column) -> Column:
        inner = first_non_empty(F.try_variant_get(x, "$.value", "string"), F.try_variant_get(x, "$.text", "string"))
        return clean_text(F.when(kind(x) == "OBJECT", inner).otherwise(F.try_variant_get(x, "$", "string")))

    def told(x: Column) -> Column:
        many = F.array_join(F.filter(F.transform(as_list(x), said), lambda s: or_empty(s) != ""), " ")
        return F.coalesce(many, said(x))

    def stocked(digits: Column) -> Column:
        return F.when(digits != "", F.when(digits.try_cast("bigint") > 0, "in_stock").otherwise("out_of_stock"))

    def house(x: Column) -> Column:
        inner = first_non_empty(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.title", "string"))
        return clean_text(F.when(kind(x) == "OBJECT", inner).otherwise(F.try_variant_get(x, "$", "string")))

    def pictured(link: Column) -> Column:
        return F.when(F.lower(link).rlike("^(https?:|data:)"), link).when(link != "", resolve_url(link, url))

    def body(t: Column) -> Column:
        def v(name: str) -> Column:
            return get(t, name)

        stock = F.when(
            kind(at(p, "isAvailable")) == "BOOLEAN", F.when(v("isAvailable") == "true", "in_stock").otherwise("out_of_stock")
        ).otherwise(let(F.regexp_replace(v("amount"), "[^0-9]", ""), stocked))
        number = clean_text(first_non_empty(v("_id"), v("id")))
        page = let(F.try_variant_get(props, "$.currentUrl", "string"), lambda link: F.when(link != "", resolve_url(link, url)))
        return _record(
            ("title", clean_text(first_non_empty(v("name"), v("title")))),
            ("source_url", F.coalesce(page, url)),
            ("extraction", F.lit("next_data")),
            ("description", let(at(p, "description"), told)),
            ("price", let(F.coalesce(*[to_number(at(p, k)) for k in NEXT_PRICES]), number_text)),
            ("isbn", let(first_non_empty(v("isbn"), v("barcode")), norm_isbn_page)),
            ("barcode", clean_text(v("barcode"))),
            ("product_id", number),
            ("sku", F.coalesce(non_blank(clean_text(v("sku"))), number)),
            ("publisher", let(at(p, "publisher"), house)),
            ("author_names", F.coalesce(non_blank(_fold_names(at(p, "authors"))), _fold_names(at(p, "author")))),
            ("genres", _fold_names(at(p, "genres"))),
            ("tags", _fold_names(at(p, "tags"))),
            ("image", let(first_non_empty(v("imgUrl"), v("image"), F.try_variant_get(props, "$.seoImage", "string")), pictured)),
            ("availability", stock),
            *[(k, v(k)) for k in NEXT_KEEP],
        )

    return let(texts(p), body)


def open_graph_record(meta: Column, url: Column) -> Column:
    def m(*names: str) -> Column:
        return first_non_empty(*[get(meta, n) for n in names])

    record = _record(
        ("title", m("og:title", "title")),
        ("source_url", url),
        ("extraction", F.lit("opengraph")),
        ("description", m("og:description", "description")),
        ("image", m("og:image")),
        ("price", let(F.replace(trim_all(get(meta, "product:price:amount")), F.lit(","), F.lit(".")).try_cast("double"), number_text)),
        ("currency", m("product:price:currency")),
        ("availability", m("product:availability")),
    )
    return F.when(m("og:title", "title").isNotNull(), record)


def with_meta(record: Column, meta: Column) -> Column:
    """Record plus meta.* fields."""
    tagged = F.transform_keys(F.map_filter(meta, lambda _, v: v != ""), lambda k, _: F.concat(F.lit("meta."), k))
    return F.map_zip_with(record, tagged, lambda _, a, b: F.coalesce(a, b))


def embedded_list_record(html: Column | str, url: Column) -> Column:
    """Product of a `waitingList` array: the one of the page's category, else one chosen by the URL."""
    source = F.col(html) if isinstance(html, str) else html
    text = F.regexp_extract(source, r"(?is)let\s+waitingList\s*=\s*(\[.*?\]);", 1)
    category = F.regexp_extract(url_path(url), "^/+catalog/([^/]+)", 1)
    letters = F.filter(F.split(url, ""), lambda ch: ch != "")
    start = F.aggregate(letters, F.lit(0).cast("bigint"), lambda a, ch: a + F.ascii(ch))

    def build(item: Column) -> Column:
        name, link = clean_text(F.try_variant_get(item, "$.name", "string")), F.try_variant_get(item, "$.url", "string")
        stock = at(item, "inStock")
        picture = F.try_variant_get(item, "$.image", "string")
        record = _record(
            ("title", name),
            ("source_url", let(F.replace(link, F.lit("\\/"), F.lit("/")), lambda u: resolve_url(u, url))),
            ("extraction", F.lit("waiting_list_json")),
            ("price", let(to_number(at(item, "price")), number_text)),
            ("image", let(picture, lambda u: F.when(u != "", resolve_url(u, url)))),
            ("sku", first_non_empty(*[F.try_variant_get(item, f"$.{k}", "string") for k in ("vendorCode", "code", "productId")])),
            ("availability", F.when(kind(stock) == "BOOLEAN", F.when(F.try_variant_get(stock, "$", "boolean"), "in_stock").otherwise("out_of_stock"))),
        )
        return F.when((name != "") & (link != ""), record)

    def usable(item: Column) -> Column:
        return (or_empty(F.try_variant_get(item, "$.name", "string")) != "") & (or_empty(F.try_variant_get(item, "$.url", "string")) != "")

    def choose(items: Column) -> Column:
        turn = F.pmod(start, F.size(items)).cast("int")
        turned = F.concat(F.slice(items, turn + 1, F.size(items)), F.slice(items, F.lit(1), turn))
        same = F.filter(items, lambda i: usable(i) & F.try_variant_get(i, "$.url", "string").contains(F.concat(F.lit("/"), category, F.lit("/"))))
        picked = F.coalesce(F.when(category != "", F.get(same, F.lit(0))), F.get(F.filter(turned, usable), F.lit(0)))
        return F.when(F.size(items) > 0, let(picked, build))

    return let(as_list(parse(F.nullif(text, F.lit("")))), choose)


def scan_pages(pages: DataFrame) -> DataFrame:
    """Pages with their element lists; the only Python step of the page job.

    A page costs far more to scan than to move: where the input has fewer partitions than there are cores, as a single
    file has, the pages are dealt out first. A large input stays where it is.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() < cores:
        pages = pages.repartition(cores)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields)
    return pages.mapInPandas(scan_batches, f"{schema}, {SCAN_SCHEMA}")


def attribute_pairs() -> Column:
    """Distinct (name, value) attribute rows of a scanned page, table rows first."""
    pair = "array<struct<name:string,value:string>>"
    items = F.filter("lines", lambda e: e["tag"] == "li")
    listed = F.transform(
        items,
        lambda e: F.struct(
            trim_all(F.substring_index(e["text"], ":", 1)).alias("name"),
            trim_all(F.regexp_replace(e["text"], "^[^:]*:", "")).alias("value"),
        ),
    )
    label = r"[A-Za-zА-Яа-яЁё0-9()\\\-]{2,}:"
    inline = F.flatten(
        F.transform(
            F.filter("lines", lambda e: e["tag"] != "li"),
            lambda e: F.transform(
                # a mark in front of every label turns the text into "label: value" pieces
                F.filter(F.split(F.regexp_replace(e["text"], f"({label})", "\u001e$1"), "\u001e"), lambda p: p.rlike(f"^{label}")),
                lambda p: F.struct(
                    trim_all(F.substring_index(p, ":", 1)).alias("name"),
                    F.regexp_replace(F.regexp_replace(p, "^[^:]*:", ""), r"^[ ;,.\-]+|[ ;,.\-]+$", "").alias("value"),
                ),
            ),
        )
    )
    tabled = F.transform("rows", lambda r: F.struct(clean_text(r["name"]).alias("name"), clean_text(r["value"]).alias("value")))
    all_rows = F.concat(tabled.cast(pair), listed.cast(pair), inline.cast(pair))
    kept = F.filter(all_rows, lambda r: (r["name"] != "") & (r["value"] != ""))
    return first_of_equals(kept, lambda r: F.lower(F.concat(r["name"], F.lit("::"), r["value"])))


def attribute_field(label: Column) -> Column:
    """Field an attribute label fills, by Russian or English token."""
    low = F.lower(trim_all(label))
    return reduce(
        lambda rest, rule: F.when(any_token(low, rule[1]), F.lit(rule[0])).otherwise(rest),
        reversed(ATTRIBUTE_FIELDS),
        F.lit(None).cast("string"),
    )


def attribute_rows(scanned: DataFrame) -> DataFrame:
    """(page_id, position, name, value, field) for every attribute row."""
    rows = scanned.select("page_id", F.posexplode(attribute_pairs()).alias("position", "row"))
    return rows.select("page_id", "position", "row.name", "row.value", attribute_field(F.col("row.name")).alias("field"))


def _attribute_map(pairs: Column) -> Column:
    """Routed attribute fields; the last row of a field counts."""

    def shaped(field: Column, value: Column) -> Column:
        return (
            F.when(field == "isbn", F.coalesce(F.nullif(norm_isbn_page(value), F.lit("")), value))
            .when(field == "sku", F.when(~F.lower(value).contains("copy"), value))
            .when(field == "author_names", F.array_join(split_names(value), ", "))
            .when(field == "pages", F.regexp_replace(value, "[^0-9]", ""))
            .when(field == "price", let(F.replace(value, F.lit(","), F.lit(".")).try_cast("double"), number_text))
            .otherwise(value)
        )

    def routed(r: Column) -> Column:
        return let(
            attribute_field(r["name"]),
            lambda field: F.struct(field.alias("key"), shaped(field, r["value"]).alias("value")),
        )

    def both(rows: Column) -> Column:
        entries = F.filter(F.transform(rows, routed), lambda e: e["key"].isNotNull() & (or_empty(e["value"]) != ""))
        labels = F.transform(rows, lambda r: F.struct(F.concat(F.lit("attr."), slug_label(r["name"])).alias("key"), r["value"].alias("value")))
        return map_of(F.concat(entries, labels))

    return let(F.reverse(pairs), both)


def ecommerce_record(html: Column | str) -> Column:
    """Fields of an analytics call that carries the product as JSON."""
    source = F.col(html) if isinstance(html, str) else html
    text = F.regexp_extract(source, r"(?is)wpym\.ec\.addData\(\s*(\{.*?\})\s*\)\s*;?", 1)
    def body(doc: Column) -> Column:
        listed = F.map_values(F.try_variant_get(at(doc, "products"), "$", "map<string,variant>"))
        item = F.get(listed, F.lit(0))
        number = F.try_variant_get(item, "$.id", "string")
        return _record(
            ("currency", F.try_variant_get(doc, "$.currency", "string")),
            ("isbn", let(number, lambda n: F.when(n.contains("-"), n))),
            ("sku", number),
            ("title", F.try_variant_get(item, "$.name", "string")),
            ("category", F.try_variant_get(item, "$.category", "string")),
            ("price", let(to_number(at(item, "price")), number_text)),
        )

    return let(parse(F.nullif(text, F.lit(""))), body)


def html_record(meta: Column, html: Column | str, url: Column) -> Column:
    """Fields of a scanned page's visible markup; nothing product-like gives null."""

    def elements(test) -> Column:
        return F.filter("elements", test)

    titles = F.filter(
        F.concat(
            F.reverse(elements(lambda e: e["cls"].contains("product-title") | ((e["tag"] == "h1") & e["cls"].rlike("book-title|product_title|entry-title")))),
            elements(lambda e: (e["tag"] == "h1") & ~e["cls"].rlike("product-title|book-title|product_title|entry-title")),
        ),
        lambda e: e["text"] != "",
    )
    heading = let(F.get(titles, F.lit(0))["text"], split_author_title)
    described = elements(
        lambda e: (e["cls"].rlike("description|entry-content|annotation|about|page-text|product-tab") | e["ident"].rlike("description|annotation")) & (e["text"] != "")
    )
    weighed = F.transform(
        described,
        lambda e, i: F.struct(
            (F.length(e["text"]) + points(e["cls"].contains("description-block"), 120) + points(e["cls"].contains("tab-content"), 20)).alias("score"),
            (-i).alias("place"),
            e["text"].alias("text"),
        ),
    )
    longest = F.array_max(weighed)["text"]
    images = elements(lambda e: (e["tag"] == "img") & (e["value"] != ""))
    marked = F.filter(images, lambda e: trim_all(e["prop"]) == "image")
    picture = trim_all(F.coalesce(F.try_element_at(F.filter(marked, lambda e: e["value"] != ""), F.lit(-1))["value"], F.get(images, F.lit(0))["value"]))
    crumbs = F.filter(elements(lambda e: (e["tag"] == "li") & F.lower(e["kind"]).contains("listitem")), lambda e: e["text"] != "")
    ages = F.filter(elements(lambda e: e["ident"].isin("age", "age_dopusk")), lambda e: e["text"] != "")

    def data_value(key: str) -> Column:
        held = elements(lambda e: F.map_contains_key(e["data"], F.lit(key)))
        return or_empty(F.element_at(F.get(held, F.lit(0))["data"], F.lit(key)))

    def body(attrs: Column) -> Column:
        own = _record(
            ("source_url", url),
            ("extraction", F.lit("html_product")),
            ("title", F.coalesce(non_blank(heading["title"]), first_non_empty(get(meta, "og:title"), get(meta, "twitter:title"), get(meta, "title")))),
            ("author_names", F.coalesce(non_blank(get(attrs, "author_names")), heading["author"])),
            ("description", F.coalesce(non_blank(longest), first_non_empty(get(meta, "og:description"), get(meta, "description"), get(meta, "twitter:description")))),
            ("image", F.coalesce(let(picture, lambda i: F.when(~i.startswith("data:image/"), non_blank(i))), first_non_empty(get(meta, "og:image"), get(meta, "twitter:image")))),
            ("isbn", F.coalesce(non_blank(get(attrs, "isbn")), let(data_value("data-product-isbn"), norm_isbn_page))),
            ("sku", F.coalesce(non_blank(get(attrs, "sku")), F.nullif(F.regexp_extract(trim_all(data_value("data-product-id")), "^([0-9]{3,})$", 1), F.lit("")))),
            ("availability", F.col("stock")),
            ("age_restriction", F.coalesce(non_blank(get(attrs, "age_restriction")), F.try_element_at(ages, F.lit(-1))["text"])),
            ("category", F.when(F.size(crumbs) >= 2, F.try_element_at(crumbs, F.lit(-2))["text"])),
        )
        paid = _record(
            ("price", let(F.replace(get(meta, "product:price:amount"), F.lit(","), F.lit(".")).try_cast("double"), number_text)),
            ("currency", get(meta, "product:price:currency")),
        )
        return merge_missing(merge_missing(merge_missing(own, attrs), ecommerce_record(html)), paid)

    def kept(full: Column) -> Column:
        signals = F.concat(*[get(full, k) for k in ("title", "isbn", "sku", "price", "pages", "author_names", "format", "binding_type", "age_restriction")])
        return F.when(signals != "", full)

    return let(let(_attribute_map(attribute_pairs()), body), kept)


MICRODATA_FIELDS = {
    "name": "title", "description": "description", "image": "image", "sku": "sku", "isbn": "isbn", "gtin": "gtin",
    "gtin13": "gtin", "price": "price", "priceCurrency": "currency", "availability": "availability", "author": "author_names",
    "publisher": "publisher", "brand": "brand", "ratingValue": "rating", "reviewCount": "review_count",
}
CLASS_FIELDS = {
    "product-title": "title", "product-price": "price", "product-description": "description", "product-author": "author_names",
    "product-publisher": "publisher", "product-isbn": "isbn", "product-sku": "sku", "product-brand": "brand",
}


def microdata_record(url: Column) -> Column:
    """Fields of itemprop elements, then of product-* classes, then data-* attributes; first value wins."""

    def routed(table: dict[str, str], key: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)

    props = F.transform(
        F.filter("elements", lambda e: e["prop"] != ""),
        lambda e: F.struct(routed(MICRODATA_FIELDS, e["prop"]).alias("key"), F.coalesce(non_blank(e["value"]), e["text"]).alias("value")),
    )
    classed = F.transform(
        F.filter("elements", lambda e: e["cls"].rlike("product-(title|price|description|author|publisher|isbn|sku|brand)")),
        lambda e: F.struct(
            routed(CLASS_FIELDS, F.regexp_extract(e["cls"], "(product-(?:title|price|description|author|publisher|isbn|sku|brand))", 1)).alias("key"),
            e["text"].alias("value"),
        ),
    )
    data = F.flatten(
        F.transform(
            "elements",
            lambda e: F.transform(
                F.map_entries(e["data"]),
                lambda d: F.struct(
                    F.when(d["key"].isin("data-product-id", "data-sku"), "sku")
                    .when(d["key"].isin("data-product-isbn", "data-isbn"), "isbn")
                    .when(d["key"] == "data-price", "price")
                    .when(d["key"] == "data-product-name", "title")
                    .alias("key"),
                    d["value"].alias("value"),
                ),
            ),
        )
    )
    entries = F.filter(F.concat(props, classed, data), lambda e: e["key"].isNotNull() & (trim_all(e["value"]) != ""))
    record = map_of(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), trim_all(e["value"]).alias("value"))))
    own = _record(("source_url", url), ("extraction", F.lit("microdata")))
    return let(record, lambda r: F.when(get(r, "title") != "", merge_missing(r, own)))


def has_product_meta(meta: Column) -> Column:
    return (F.concat(*[get(meta, k) for k in META_MARKS]) != "") | F.lower(get(meta, "og:type")).rlike("product|book")


def page_signals(url: Column, meta: Column, html: Column) -> Column:
    """What address, meta tags and source of a page say, apart from any record."""
    return let(
        F.lower(trim_all(url)),
        lambda link: F.struct(
            is_likely_product(link).alias("likely"),
            looks_like_product_url(link).alias("shaped"),
            non_product_url(link).alias("listing"),
            has_product_meta(meta).alias("meta"),
            any_token(F.lower(html), BODY_MARKS).alias("body"),
        ),
    )


def product_gate(record: Column, source: str, page: Column) -> Column:
    """Whether a record is believed to be a product, by its fields, its source and the page signals."""
    title = F.lower(trim_all(get(record, "title")))
    strong = F.concat(get(record, "gtin"), get(record, "isbn"), get(record, "sku")) != ""
    priced = get(record, "price") != ""
    stocked = get(record, "availability") != ""
    described = F.length(trim_all(get(record, "description"))) >= 60
    pictured = get(record, "image") != ""
    refused = F.coalesce(page["listing"], any_token(title, NON_PRODUCT_TITLES))
    score = total(
        points(strong, 4), points(priced, 3), points(stocked, 1), points(described, 1), points(pictured, 1), points(page["shaped"], 2),
        points(page["meta"], 2), points(page["body"], 2),
    )
    sure = strong | priced | page["meta"]
    if source == "jsonld":
        verdict = priced | page["meta"] | (strong & (page["shaped"] | stocked)) | (score >= 6)
    elif source == "html_product":
        verdict = (
            F.when(refused, sure)
            .when(sure | page["body"], score >= 4)
            .otherwise((title != "") & (described | pictured) & page["likely"])
        )
    else:
        verdict = (sure | page["body"]) & (score >= 6)
    return F.coalesce(F.when(refused & ~(sure | page["body"]), F.lit(False)).otherwise(verdict), F.lit(False)) & record.isNotNull()


def clean_record(record: Column) -> Column:
    """Control characters out, line breaks to blanks, runs of blanks to one."""
    return F.transform_values(
        record,
        lambda _, v: trim_all(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"[\n\r\t\x{A0}]", " "), r"[\x00-\x1F\x7F]", ""), " +", " ")),
    )


def extract_products(pages: DataFrame) -> DataFrame:
    """One record per product page: (page_id, url, extraction, record).

    Structured data first, then application state, visible markup, OpenGraph
    and embedded lists; each has to pass the gate. Only the element scan runs
    in Python; no exchange is needed, a page is decided inside its row.
    """
    url = F.col("url")
    scanned = scan_pages(pages.select("page_id", "url", "html"))
    parsed = scanned.withColumn("meta", meta_map("html")).withColumns(
        {
            "page": page_signals(url, F.col("meta"), F.col("html")),
            "ld": best_json_ld("html", url),
            "next": next_data_record("html", url),
            "visible": html_record(F.col("meta"), "html", url),
            "graph": open_graph_record(F.col("meta"), url),
            "embedded": embedded_list_record("html", url),
        }
    )
    meta = F.col("meta")
    filled = parsed.select(
        "page_id", "url", "meta", "page", "graph", "embedded",
        with_meta(merge_missing(F.col("ld"), F.col("visible")), meta).alias("ld"),
        with_meta(merge_missing(F.col("next"), F.col("visible")), meta).alias("next"),
        with_meta(F.col("visible"), meta).alias("visible"),
    )

    def passed(column: str, source: str) -> Column:
        return F.when(product_gate(F.col(column), source, F.col("page")), F.col(column))

    chosen = F.coalesce(
        passed("ld", "jsonld"),
        passed("next", "next_data"),
        passed("visible", "html_product"),
        with_meta(passed("graph", "opengraph"), meta),
        with_meta(passed("embedded", "embedded_json"), meta),
    )
    decided = filled.select("page_id", "url", in_place(let(chosen, clean_record)).alias("record"))
    picked = decided.where(F.col("record").isNotNull())
    return picked.select("page_id", "url", get(F.col("record"), "extraction").alias("extraction"), "record")


# Address tokens of product pages in the second order of extraction, and what is no product.
ADDRESS_TOKENS = ["/product/", "/products/", "/item/", "/book/", "/books/details/", "/isbn/", "/dp/", "/p/", "/goods/"]
NUMBERED_SLUG = "/[a-z0-9][a-z0-9-]{3,}-[0-9]{4,}/?$"
NUMBERED_SECTION = "/catalog/(books|knigi)-[0-9]+/?$"


def product_address(url: Column) -> Column:
    return let(F.lower(url), lambda u: ~u.rlike(NUMBERED_SECTION) & (any_token(u, ADDRESS_TOKENS) | u.rlike(NUMBERED_SLUG)))


def all_json_ld(html: Column | str, url: Column) -> Column:
    """Fields of all objects that look like products, the first value of each kept; none gives null."""
    found = F.filter(F.transform(F.filter(json_ld_items(html), is_product_like), lambda v: json_ld_record(v, url)), lambda r: r.isNotNull())
    none = F.create_map().cast("map<string,string>")
    return let(found, lambda rs: F.when(F.size(rs) > 0, F.aggregate(rs, none, lambda kept, r: _kept(kept, r))))


def _kept(first: Column, then: Column) -> Column:
    """Fields of both; of two values the first that is not blank."""
    return F.map_zip_with(first, F.coalesce(then, F.create_map().cast("map<string,string>")), lambda _, x, y: F.coalesce(non_blank(x), y))


def first_value_gate(record: Column, url: Column) -> Column:
    """Whether a record of the second order is a product: two of type, price, identifier, availability and address, or a full page."""

    def body(address: Column) -> Column:
        price = get(record, "price").try_cast("double") > 0
        priced = F.coalesce(price, F.lit(False))
        known = F.concat(*[get(record, k) for k in ("isbn", "gtin", "sku", "product_id")]) != ""
        stocked, pictured = get(record, "availability") != "", get(record, "image") != ""
        typed = F.lower(F.concat_ws(" ", get(record, "meta.og:type"), get(record, "@type"))).rlike("product|book")
        told = F.length(get(record, "description")) >= 40
        sure = (
            (typed & (priced | known | stocked | address))
            | (priced & (known | stocked | address))
            | (known & (priced | stocked | address | pictured))
            | (address & pictured & told)
        )
        return sure & (F.length(get(record, "title")) >= 2)

    return let(product_address(url), body)


def first_value_products(pages: DataFrame) -> DataFrame:
    """One record per product page in the second order of extraction: (page_id, url, extraction, record).

    Application state comes before JSON-LD, meta tags, microdata and visible markup, and the first value of each field is
    kept, so a record can mix them. `extraction` names the best kind of source that gave anything, JSON-LD first. A
    projection for each step of the ladder; no exchange.
    """
    url = F.col("url")
    staged = scan_pages(pages.select("page_id", "url", "html")).withColumn("meta", meta_map("html"))
    staged = staged.select(
        "page_id", "url", "meta",
        in_place(next_data_record("html", url)).alias("next"),
        in_place(all_json_ld("html", url)).alias("ld"),
        in_place(open_graph_record(F.col("meta"), url)).alias("graph"),
        in_place(microdata_record(url)).alias("micro"),
        in_place(html_record(F.col("meta"), "html", url)).alias("visible"),
    )
    none = F.create_map().cast("map<string,string>")
    whole = F.coalesce("next", none)
    for step in ("ld", "graph", "micro", "visible"):
        whole = _kept(whole, F.col(step))
    named = F.array(*(F.when(F.col(c).isNotNull() & (F.size(c) > 0), F.lit(n)) for c, n in (("ld", "jsonld"), ("next", "next_data"), ("graph", "opengraph"), ("micro", "microdata"), ("meta", "meta"))))
    merged = staged.select("page_id", "url", "meta", in_place(whole).alias("record"), F.coalesce(F.get(F.array_compact(named), F.lit(0)), F.lit("html")).alias("extraction"))
    own = F.create_map(F.lit("source_url"), url, F.lit("extraction"), F.col("extraction"))
    rest = F.map_filter(with_meta(F.col("record"), F.col("meta")), lambda k, _: ~k.isin("source_url", "extraction"))
    decided = merged.select("page_id", "url", "extraction", in_place(F.map_concat(rest, own)).alias("record"))
    return decided.where(first_value_gate(F.col("record"), url)).withColumn("record", clean_record(F.col("record")))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) links of a page to its own host."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    hrefs = F.array_distinct(F.transform(tags, lambda t: clean_text(_attr(t, "href"))))
    links = pages.select("url", F.explode(hrefs).alias("href")).select(F.col("url").alias("src"), in_place(crawl_url("href", "url")).alias("dst"))
    return links.where(F.col("dst").isNotNull()).distinct()


def embedded_urls(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) product addresses found anywhere in the page source."""
    found = F.flatten(F.array(*[F.regexp_extract_all("html", F.lit(p), F.lit(0)) for p in EMBEDDED_PATTERNS]))
    plain = F.array_distinct(F.transform(found, lambda u: F.replace(trim_all(F.btrim(u, F.lit("\"'"))), F.lit("\\/"), F.lit("/"))))
    bare = "(?i)^(product|products|item|dp|book|books)/"
    rows = pages.select("url", F.explode(plain).alias("raw")).withColumn("raw", F.when(F.col("raw").rlike(bare), F.concat(F.lit("/"), "raw")).otherwise(F.col("raw")))
    links = rows.select(F.col("url").alias("src"), in_place(crawl_url("raw", "url")).alias("dst"))
    return links.where(F.col("dst").isNotNull() & is_likely_product("dst")).distinct()


def score_urls(urls: DataFrame, c: str = "url") -> DataFrame:
    """URLs with product score, parse score and likeliness."""
    return urls.withColumns(
        {"product_score": product_score(c), "parse_score": parse_score(c), "likely": is_likely_product(c)}
    )


def rank_urls(urls: DataFrame, n: int | None = None, c: str = "url", per_host: int | None = None) -> DataFrame:
    """Distinct URLs, likely products first, then parse score, then the URL: all, the first n, or the first of each host."""
    scored = score_urls(urls.select(c).distinct(), c)
    first = F.col("likely") | (F.col("product_score") >= 18)
    order = [F.desc("first"), F.desc("parse_score"), F.asc(c)]
    scored = scored.withColumn("first", first)
    if per_host is not None:
        # the rank limit is applied in the map tasks
        place = Window.partitionBy("host").orderBy(*order)
        scored = scored.withColumn("host", normalize_host(url_host(c))).withColumn("host_rank", F.row_number().over(place)).where(F.col("host_rank") <= per_host)
    ranked = scored.orderBy(*order)
    return ranked if n is None else ranked.limit(n)


def union_candidates(*tables: DataFrame) -> DataFrame:
    """Distinct URLs of several sources."""
    return reduce(lambda a, b: a.unionByName(b), [t.select("url") for t in tables]).distinct()


def classify_fetch(log: DataFrame) -> DataFrame:
    """Fetch log (status, content_type, body) with block_reason and rate_limited."""
    body, ctype = F.lower(or_empty("body")), F.lower(trim_all(or_empty("content_type")))
    textual = any_token(ctype, ["text/html", "text/plain"])
    reason = reduce(lambda rest, m: F.when(body.contains(m[0]), F.lit(m[1])).otherwise(rest), reversed(BLOCK_MARKS), F.lit(None).cast("string"))
    reason = F.coalesce(
        reason,
        F.when(body.contains("captcha") & any_token(body, HUMAN_CHECKS), F.lit("captcha challenge")),
        F.when(F.col("status").isin(403, 429, 503) & textual, F.concat(F.lit("http "), F.col("status").cast("string"))),
        F.lit(""),
    )
    limited = (F.col("status") == 429) | (((ctype == "") | textual) & any_token(body, RATE_PHRASES))
    return log.withColumns({"block_reason": reason, "rate_limited": limited})


def frontier(links: DataFrame, visited: DataFrame, n: int, max_depth: int, min_score: int) -> DataFrame:
    """Next URLs to fetch: unseen, scored, within depth and from a score on; best score first, then the nearest."""
    open_links = links.where(F.col("depth") <= max_depth).withColumn("score", in_place(discovery_score("url", "depth"))).where(F.col("score") >= min_score)
    unseen = open_links.join(visited.select("url").distinct(), "url", "left_anti")
    best = unseen.groupBy("url").agg(F.max("score").alias("score"), F.min("depth").alias("depth"))
    return best.orderBy(F.desc("score"), "depth", "url").limit(n)
