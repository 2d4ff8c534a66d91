"""Text normalization as Column expressions: no Python runs per row."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, functions as F

# The characters Unicode calls white space.
WHITESPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Spellings read as true.
TRUE_WORDS = ["1", "true", "yes", "y", "on", "да", "истина"]

# Every named entity of the HTML standard, as the standard library lists them.
NAMED_ENTITIES = json.dumps({name.rstrip(";"): text for name, text in html5.items() if name.endswith(";")})
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# What the standard reads for the numbers 128 to 159.
LOW_CONTROLS = bytes(range(128, 160)).decode("cp1252", "replace")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Trim every Unicode white space; the built-in trim knows only the plain space."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def non_blank(c: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    trimmed = trim_all(c)
    return F.nullif(trimmed, F.lit(""))


def first_non_empty(*cs: Column | str) -> Column:
    return F.coalesce(*[non_blank(c) for c in cs]) if len(cs) > 1 else non_blank(cs[0])


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def norm_code_ascii(c: Column | str) -> Column:
    return F.upper(F.regexp_replace(col(c), "[^0-9A-Za-z]", ""))


def norm_code_unicode(c: Column | str) -> Column:
    """Upper-case letters and digits of any script; the sharp s has no capital and stays."""
    kept = F.regexp_replace(col(c), r"[^\p{L}\p{Nd}]", "")
    return F.translate(F.upper(F.translate(kept, "ß", "_")), "_", "ß")


def header_key(c: Column | str) -> Column:
    """Column heading reduced to its letters: lower, no BOM, no blanks or punctuation."""
    bare = F.regexp_replace(F.lower(trim_all(c)), r"^\x{FEFF}", "")
    return F.regexp_replace(bare, r"[-\\ ./:;()_]", "")


def norm_isbn_page(c: Column | str) -> Column:
    """First ISBN-like run of free text, hyphens kept; under nine digits gives ''."""
    run = F.regexp_replace(F.regexp_extract(F.upper(clean_text(c)), r"[0-9X][0-9X\\-]{8,20}", 0), "^[ -]+|[ -]+$", "")
    digits = F.length(F.regexp_replace(run, "[^0-9]", ""))
    return F.when(digits >= 9, run).otherwise(F.lit(""))


def looks_like_isbn_ean(c: Column | str) -> Column:
    value = F.upper(trim_all(c))
    return F.coalesce(value.rlike("^([0-9]{8}|[0-9]{9}[0-9X]|[0-9]{13,14})$"), F.lit(False))


def norm_size(c: Column | str) -> Column:
    """Latin, Cyrillic and star multiplication marks become x; two non-empty parts stay."""
    unified = F.translate(trim_all(c), "XХх*", "xxxx")
    parts = F.filter(F.transform(F.split(unified, "x"), trim_all), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, 2), "x")


def clean_array(c: Column | str) -> Column:
    """Trim, drop blanks, keep the first of equals; nothing left gives null."""
    kept = F.array_distinct(F.filter(F.transform(col(c), trim_all), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(kept) > 0, kept)


def slug_label(c: Column | str) -> Column:
    lowered = F.lower(trim_all(c))
    slug = F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9а-яё]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", F.lit("field")).otherwise(slug)


def unescape(c: Column | str) -> Column:
    """Named and numeric entities to characters, each once; what is none stays as it is."""
    text = col(c)
    named = F.from_json(F.lit(NAMED_ENTITIES), "map<string,string>")

    def number(body: Column) -> Column:
        code = F.when(F.lower(body).startswith("#x"), F.conv(F.substring(body, 3, 6), 16, 10)).otherwise(F.substring(body, 2, 7)).cast("int")
        known = (code < 0xD800) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return (
            F.when((code == 0) | ~known, F.lit("\ufffd"))
            .when(code.between(128, 159), F.substring(F.lit(LOW_CONTROLS), code - 127, F.lit(1)))
            .otherwise(char)
        )

    def decoded(piece: Column) -> Column:
        body = F.regexp_extract(piece, ENTITY, 1)
        value = F.when(body.startswith("#"), number(body)).when(body != "", F.element_at(named, body))
        return F.coalesce(F.concat(value, F.substring(piece, F.length(body) + 2, F.length(piece))), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    whole = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def clean_text(c: Column | str) -> Column:
    return trim_all(F.regexp_replace(unescape(c), SPACE_CLASS + "+", " "))


def split_clean(c: Column | str, pattern: str) -> Column:
    """Split on a pattern, then trimmed distinct non-blank parts; none gives null."""
    return clean_array(F.split(col(c), pattern))


def split_list(c: Column | str) -> Column:
    return split_clean(c, "[|;,]")


def split_path(c: Column | str) -> Column:
    value = col(c)
    return F.when(value.contains(" / "), split_clean(value, " / ")).otherwise(split_clean(value, "[|,]"))


def split_links(c: Column | str) -> Column:
    return split_clean(c, r"[\n\r|;,]")


def _first_separator_split(c: Column, separators: list[str]) -> Column:
    """Parts after the first separator of the list that occurs at all."""
    branches = F.lit(None).cast("array<string>")
    for sep in reversed(separators):
        branches = F.when(c.contains(sep), F.split(c, F.lit(_quote(sep)))).otherwise(branches)
    return F.coalesce(branches, F.array(c))


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def split_names(c: Column | str) -> Column:
    """Names by the first separator kind that leaves any; repeats stay."""
    value = clean_text(c)
    picks = []
    for sep in [",", ";", "|", "/"]:
        parts = F.filter(F.transform(F.split(value, F.lit(_quote(sep))), trim_all), lambda p: p != "")
        picks.append(F.when(value.contains(sep) & (F.size(parts) > 0), parts))
    return F.when(value != "", F.coalesce(*picks, F.array(value)))


def split_category(c: Column | str) -> Column:
    """Feed category text to path parts, by the first separator kind present."""
    value = trim_all(F.replace(col(c), F.lit("\u00a0"), F.lit(" ")))
    return clean_array(_first_separator_split(value, [" / ", ">", "»", "->", "|", "/"]))


def split_author_title(c: Column | str) -> Column:
    """`author | title`; one side missing leaves the whole text as the title."""
    value = clean_text(c)
    parts = F.split(value, r"\|", 2)
    author, title = trim_all(F.get(parts, F.lit(0))), trim_all(F.get(parts, F.lit(1)))
    both = F.coalesce((author != "") & (title != ""), F.lit(False))
    return F.struct(
        F.when(both, author).otherwise(F.lit("")).alias("author"),
        F.when(both, title).otherwise(value).alias("title"),
    )


def primary_link(c: Column | str) -> Column:
    """First http(s) token of the first separator kind that yields one, else the text."""
    value = trim_all(F.replace(col(c), F.lit("\u00a0"), F.lit(" ")))
    picks = []
    for sep in [";", ",", "|", " "]:
        tokens = F.transform(F.split(value, F.lit(_quote(sep))), trim_all)
        links = F.filter(tokens, lambda t: F.lower(t).rlike("^https?://"))
        picks.append(F.when(value.contains(sep), F.get(links, F.lit(0))))
    return F.coalesce(*picks, value)


def short_hash(c: Column | str) -> Column:
    """Hex of the first eight bytes of SHA-1."""
    return F.substring(F.sha1(col(c).cast("binary")), 1, 16)


def prefix_equals(c: Column | str, wanted: list[str]) -> Column:
    return F.coalesce(F.slice(col(c), 1, len(wanted)) == F.array(*[F.lit(w) for w in wanted]), F.lit(False))


def base64url(c: Column | str) -> Column:
    raw = F.base64(col(c).cast("binary"))
    return F.translate(F.rtrim(raw, F.lit("=")), "+/", "-_")


def path_key(parts: Column | str) -> Column:
    """Key of a path: parts joined by the unit separator, URL-safe base64 without padding."""
    return base64url(F.array_join(col(parts), "\u001f"))


def decode_path_key(c: Column | str) -> Column:
    """Inverse of path_key; malformed input gives null."""
    standard = F.translate(col(c), "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-F.length(standard), F.lit(4)).cast("int")))
    well_formed = standard.rlike("^[A-Za-z0-9+/]+$") & (F.pmod(F.length(standard), F.lit(4)) != 1)
    text = F.try_to_binary(F.when(well_formed, padded), F.lit("base64")).cast("string")
    return F.split(text, "\u001f")


def mirror(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Two texts that stand in for each other when one is blank."""
    left, right = non_blank(a), non_blank(b)
    return F.coalesce(left, right), F.coalesce(right, left)
