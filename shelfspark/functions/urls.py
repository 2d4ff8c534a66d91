"""URL hosts, paths, cleanup and product-likeness scores as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from shelfspark.functions.text import col, trim_all

HOST_PATTERN = r"^[a-z0-9-]+(\.[a-z0-9-]+)+$"

# Path segments that carry no category meaning.
IGNORED_SEGMENTS = [
    "image", "images", "img", "upload", "uploads", "media", "static", "assets", "files", "file",
    "cache", "resized", "resize", "thumbnail", "thumbnails", "thumb", "thumbs", "goods", "products", "product",
]
IMAGE_FILE = r"\.(jpg|jpeg|png|webp|gif|bmp|svg|avif|jfif)$"
# Query keys that only track visits.
TRACKING_KEYS = ["srsltid", "gclid", "fbclid", "_ga", "_gl", "ymclid"]
BLOCKED_FILES = r"\.(jpg|jpeg|png|gif|svg|webp|css|js|json|xml|pdf|zip|mp4|mp3)$"

# URL patterns of product pages.
P_PRODUCT_WORD = r"(book|books|product|catalog|item|isbn|product_id=|route=product/product|/dp/|/p/)"
P_TRAILING_ID = r"(-|/)[0-9]{4,}(/|$)"
P_PAGINATION = r"/page/[0-9]+/?($|\?)"
P_CATALOG_SLUG = r"/catalog/(book-|item-|product-|kniga-|isbn-|sku-)"
P_BOOK_DETAILS = r"/books/details/[^/?#]+/?$"
P_BOOK_DEEP = r"/books/[^/?#]+/[^/?#]+/?$"
P_BOOK_SINGLE = r"/(book|books)/[^/?#]{3,}/?$"
P_CATALOG_DEEP = r"/catalog/[^/?#]+/[^/?#]+/?$"
P_ROOT_SLUG = r"^/[a-z0-9][a-z0-9-]{4,}/?$"

# Path tokens by meaning.
LISTING_PATHS = [
    "/catalog/", "/catalogue/", "/category/", "/categories/", "/collection/", "/collections/", "/articles/", "/article/",
    "/news/", "/blog/", "/author/", "/authors/", "/brand/", "/brands/", "/publisher/", "/publishers/",
]
ITEM_PATHS = ["/product/", "/products/", "/item/", "/dp/", "/sku/", "/isbn/", "/gtin/"]
DEMOTED_TOKENS = [
    "/catalogue/", "/catalog/books/", "/catalogue/books/", "/category/", "/categories/", "/collection/", "/collections/",
    "/articles/", "/article/", "/bestseller", "/novinki", "/new/", "/authors/", "/gallery/", "/galleries/", "/blog/",
    "/news/", "/search",
]
EDITORIAL_TOKENS = [
    "/articles/", "/article/", "/blog/", "/news/", "/author/", "/authors/", "/category/", "/categories/", "/collection/",
    "/collections/",
]
PRODUCT_URL_TOKENS = [
    "/product/", "/products/", "/book/", "/books/", "/item/", "/isbn/", "/p/", "/dp/", "sku", "isbn", "gtin",
    "route=product/product", "product_id=",
]
NON_PRODUCT_TOKENS = [
    "/catalog/", "/catalogue/", "catalog?", "catalog/", "catalogue?", "catalogue/", "/category/", "/categories/",
    "/collections/", "/collection/", "/bestseller", "/novinki", "/new/", "/news/", "/authors/", "/author/", "/gallery/",
    "/galleries/", "/blog/", "/articles/", "/article/", "/search", "/refund", "/delivery", "/payment", "/contacts",
    "/about", "/subscription", "/certificates", "/audiobookcatalog", "/ebookcatalog", "/cart", "/basket", "/wishlist",
]
NON_PRODUCT_TITLES = ["каталог", "бестселлер", "новинки", "книги -", "catalog", "category", "categories", "collection"]
ROOT_PAGES = [
    "about", "contacts", "contact", "blog", "news", "catalog", "catalogue", "categories", "category", "collection",
    "collections", "search", "shop", "cart", "checkout", "profile", "login", "account", "privacy", "terms", "authors",
    "author", "company", "press", "faq", "delivery", "payment", "posters", "discount", "favorites", "orders",
]
# Tokens of the discovery score.
DISCOVERY_GOOD = ["catalog", "books", "book", "product", "shop", "store"]
DISCOVERY_BAD = ["login", "account", "basket", "cart", "wishlist", "compare", "faq", "help", "privacy", "terms"]
DISCOVERY_WORSE = ["article", "articles", "/news/", "/blog/", "/author/", "/authors/"]


def any_token(c: Column, tokens: list[str]) -> Column:
    """One pass over the text for any of the literal tokens."""
    return c.rlike("|".join(re.escape(t) for t in tokens))


def points(condition: Column, value: int) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0))


def total(*parts: Column) -> Column:
    return reduce(lambda a, b: a + b, parts)


def looks_like_host(c: Column | str) -> Column:
    return F.coalesce(F.lower(trim_all(c)).rlike(HOST_PATTERN), F.lit(False))


def normalize_host(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(trim_all(c)), r"^www\.", "")


def url_host(c: Column | str) -> Column:
    """Host of an absolute URL, lower case, no port, no user part."""
    return F.lower(F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def score_path(c: Column | str) -> Column:
    """Lower-case path of a URL; text without a scheme or path stands for itself."""
    raw = col(c)
    path = F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), url_path(raw)).otherwise(F.regexp_extract(raw, r"^([^?#]*)", 1))
    return F.lower(F.when(path != "", path).otherwise(raw))


def extract_domain(c: Column | str) -> Column:
    """Host behind a `client:` id, an http(s) URL or a bare host; no host gives ''.

    One pass per step and no repeated sub-expression, since this runs over
    every identifier and cover link of a catalog.
    """
    raw = F.lower(trim_all(c))
    tagged = F.regexp_extract(raw, r"^(?:client:|https?://(?:[^/?#@]*@)?)([^:/?#]*)", 1)
    head = F.when(raw.rlike("^(client:|https?://)"), tagged).otherwise(raw)
    bare = F.regexp_replace(trim_all(head), r"^www\.", "")
    return F.coalesce(F.regexp_extract(bare, r"^([a-z0-9-]+(?:\.[a-z0-9-]+)+)$", 1), F.lit(""))


def url_category_path(c: Column | str) -> Column:
    """Host and up to five meaningful path segments; not an http(s) URL gives null."""
    raw = trim_all(c)
    host = normalize_host(url_host(raw))
    segments = F.transform(F.split(F.btrim(F.lower(url_path(raw)), F.lit("/")), "/"), trim_all)
    last_is_image = F.coalesce(F.element_at(segments, -1).rlike(IMAGE_FILE), F.lit(False))
    walked = F.when(last_is_image, F.slice(segments, F.lit(1), F.size(segments) - 1)).otherwise(segments)
    kept = F.filter(walked, lambda s: (s != "") & ~s.isin(*IGNORED_SEGMENTS))
    return F.when(F.lower(raw).rlike("^https?://") & (host != ""), F.concat(F.array(host), F.slice(kept, 1, 5)))


def normalize_url(c: Column | str) -> Column:
    """Default scheme, tracking keys gone, query sorted by key; blank or hostless gives null."""
    raw = trim_all(c)
    full = F.when(raw.rlike("^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    base = F.regexp_extract(full, r"^([^?#]*)", 1)
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(full, r"(#.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    named = F.transform(
        pairs,
        lambda p: F.struct(
            F.regexp_extract(p, "^([^=]*)", 1).alias("key"),
            F.regexp_replace(p, "^[^=]*=?", "").alias("value"),
        ),
    )
    indexed = F.transform(named, lambda p, i: F.struct(p.key.alias("key"), i.alias("at"), p.value.alias("value")))
    wanted = F.filter(
        indexed,
        lambda p: ~F.lower(trim_all(p.key)).startswith("utm_") & ~F.lower(trim_all(p.key)).isin(*TRACKING_KEYS),
    )
    encoded = F.array_join(F.transform(F.array_sort(wanted), lambda p: F.concat(p.key, F.lit("="), p.value)), "&")
    rebuilt = F.concat(base, F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(F.lit("")), fragment)
    return F.when((raw != "") & (url_host(full) != ""), rebuilt)


def _squeeze_dots(path: Column) -> Column:
    """Resolve . and .. segments of an absolute path."""
    segments = F.split(path, "/")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    closing = F.when(path.rlike(r"/\.{1,2}$"), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.array_join(closing, "/")


def resolve_url(link: Column | str, base: Column | str) -> Column:
    """Absolute form of a link found on a page."""
    ref, page = trim_all(link), col(base)
    scheme = F.regexp_extract(page, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(url_path(page), r"^(.*/)", 1)
    page_path = F.when(url_path(page) == "", F.lit("/")).otherwise(url_path(page))
    ref_path = F.regexp_extract(ref, r"^([^?#]*)", 1)
    ref_rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    absolute = F.when(ref_path.startswith("/"), ref_path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), ref_path)
    )
    squeezed = F.when(absolute.rlike(r"/\.{1,2}(/|$)"), _squeeze_dots(absolute)).otherwise(absolute)
    page_query = F.regexp_extract(page, r"^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("?"), F.concat(origin, page_path, ref))
        .when((ref == "") | ref.startswith("#"), F.concat(origin, page_path, page_query, ref))
        .otherwise(F.concat(origin, squeezed, ref_rest))
    )


def crawl_url(link: Column | str, base: Column | str) -> Column:
    """Link worth following: same host, no fragment, no blocked scheme or file; else null."""
    ref = trim_all(link)
    resolved = F.regexp_replace(resolve_url(ref, base), "#.*$", "")
    usable = (
        (ref != "")
        & ~F.lower(ref).rlike("^(#|mailto:|tel:|javascript:)")
        & F.lower(resolved).rlike("^https?://")
        & (normalize_host(url_host(resolved)) == normalize_host(url_host(base)))
        & ~F.lower(url_path(resolved)).rlike(BLOCKED_FILES)
    )
    return F.when(usable, resolved)


def is_blocked_root(path: Column) -> Column:
    trimmed = F.btrim(F.lower(trim_all(path)), F.lit("/"))
    return (trimmed == "") | trimmed.isin(*ROOT_PAGES)


def is_root_slug(path: Column) -> Column:
    return F.lower(trim_all(path)).rlike(P_ROOT_SLUG) & ~is_blocked_root(path)


def _outside_book_listing(c: Column) -> Column:
    return ~c.contains("/catalog/books/") & ~c.contains("/catalogue/books/")


def is_likely_product(c: Column | str) -> Column:
    """Ordered path rules: sure product shapes, then listings, then item tokens, then a bare slug."""
    raw = trim_all(c)
    lowered, path = F.lower(raw), score_path(raw)
    return (
        F.when(raw == "", F.lit(False))
        .when(path.contains("/catalog/product/") | path.rlike(P_BOOK_DETAILS) | path.rlike(P_CATALOG_SLUG), F.lit(True))
        .when((path.rlike(P_BOOK_DEEP) | path.rlike(P_BOOK_SINGLE)) & _outside_book_listing(path), F.lit(True))
        .when(path.rlike(P_CATALOG_DEEP) & ~path.contains("/filter/") & ~path.contains("/search/"), F.lit(True))
        .when(any_token(path, LISTING_PATHS), F.lit(False))
        .when(any_token(lowered, ["route=product/product", "product_id="]) | any_token(path, ITEM_PATHS), F.lit(True))
        .when((path.contains("/book/") | path.contains("/p/")) & path.rlike(P_TRAILING_ID), F.lit(True))
        .otherwise(is_root_slug(path))
    )


def product_score(c: Column | str) -> Column:
    url, path = F.lower(col(c)), score_path(c)
    # The weight of each mark.
    return total(
        points(url.rlike(P_PRODUCT_WORD), 3),
        points(url.contains("/catalog/product/"), 18),
        points(path.rlike(P_BOOK_DETAILS), 14),
        points(url.rlike(P_CATALOG_SLUG), 18),
        points(url.rlike(P_BOOK_DEEP) & _outside_book_listing(url), 7),
        points(path.rlike(P_BOOK_SINGLE) & _outside_book_listing(path), 4),
        points(url.rlike(P_CATALOG_DEEP), 8),
        points(any_token(url, ["/product/", "/products/"]), 16),
        points(any_token(url, ["route=product/product", "product_id="]), 16),
        points(any_token(url, ["/book/", "/books/"]) & _outside_book_listing(url), 3),
        points(any_token(url, ["/item/", "/dp/"]), 8),
        points(url.contains("isbn"), 5),
        *[points(url.contains(t), -8) for t in DEMOTED_TOKENS],
        points(
            url.contains("/catalog/")
            & ~url.contains("/catalog/product/")
            & ~url.rlike(P_CATALOG_SLUG)
            & ~url.rlike(P_CATALOG_DEEP),
            -8,
        ),
        points(is_root_slug(path), 9),
        points(is_blocked_root(path), -10),
        points(url.contains("?"), -1),
        points(url.rlike(r"\.(jpg|png)$"), -10),
        points(F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit(""))) >= 4, 2),
    )


def looks_like_product_url(url: Column) -> Column:
    return (
        url.contains("/catalog/product/")
        | url.rlike(P_CATALOG_SLUG)
        | url.rlike(P_BOOK_DEEP)
        | url.rlike(P_CATALOG_DEEP)
        | any_token(url, PRODUCT_URL_TOKENS)
    )


def non_product_url(url: Column) -> Column:
    """True or false where the address alone decides, else null."""
    return (
        F.when(is_likely_product(url), F.lit(False))
        .when(url.rlike(P_PAGINATION), F.lit(True))
        .when(any_token(url, NON_PRODUCT_TOKENS), ~any_token(url, ["/product/", "/book/"]))
    )


def is_non_product_page(url: Column, title: Column) -> Column:
    return F.coalesce(non_product_url(url), any_token(F.coalesce(title, F.lit("")), NON_PRODUCT_TITLES))


def parse_score(c: Column | str) -> Column:
    url = F.lower(trim_all(c))
    # The weight of each mark.
    return total(
        product_score(c),
        points(is_likely_product(c), 20),
        points(looks_like_product_url(url), 6),
        points(is_non_product_page(url, F.lit("")), -30),
        points(any_token(url, EDITORIAL_TOKENS), -25),
    )


def discovery_score(c: Column | str, depth: Column | str) -> Column:
    url, hops = F.lower(col(c)), col(depth)
    # The weight of each mark.
    return total(
        product_score(c),
        *[points(url.contains(t), 2) for t in DISCOVERY_GOOD],
        *[points(url.contains(t), -6) for t in DISCOVERY_BAD],
        *[points(url.contains(t), -10) for t in DISCOVERY_WORSE],
        points(is_likely_product(c), 8),
        F.when(hops <= 1, F.lit(2)).otherwise(-hops),
    )
