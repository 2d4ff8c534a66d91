"""Personal data: an Aho-Corasick pass finds anchors, local parsers expand each one and check what they found.

Anchors are at-signs, spelled-out at-signs, plus signs, digits, address schemes and identifier cues. A parser looks only
around its anchor, never overlaps its kind's previous span, and takes time in proportion to the text.

Kinds, in the order that breaks ties of the start: email, ip, card, phone (the base), then login (an address with a user
name and password), masked (an email with a spelled-out at-sign) and account (a number behind a cue).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from shelfspark.llm.common import prepare, table

KINDS = ("email", "ip", "card", "phone", "login", "masked", "account")
BASE = 4

# The schemes, spelled-out signs and cues that are anchors.
SCHEMES = ("http://", "https://", "ftp://")
AT_SIGNS = ("(at)", "[at]", "(AT)", "[AT]")
DOTS = ("(dot)", "[dot]", "(DOT)", "[DOT]")
CUES = ("account", "acct", "compte", "cuenta", "iban", "konto", "passport", "ssn")

_DIGITS = frozenset("0123456789")
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LABEL = _DIGITS | _UPPER | frozenset("abcdefghijklmnopqrstuvwxyz-")
_LOCAL = _LABEL | frozenset("._%+")
_HOST = _LABEL | frozenset(".")
_DIAL = _DIGITS | frozenset(" ().-")
_STOP = frozenset("/?#@") | frozenset(map(chr, range(33)))
_BEHIND_CUE = frozenset(" :#=.")

_automata: list[ahocorasick.Automaton] = []


def _automaton() -> ahocorasick.Automaton:
    """Built once per process; the value of a hit is (what, length)."""
    if not _automata:
        a = ahocorasick.Automaton()
        cues = [form for c in CUES for form in (c, c.capitalize(), c.upper())]
        for what, forms in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("scheme", SCHEMES), ("masked", AT_SIGNS), ("cue", cues)):
            for form in forms:
                a.add_word(form, (what, len(form)))
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def _run(text: str, at: int, chars: frozenset) -> int:
    """End of the run of `chars` that starts at `at`."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _run_back(text: str, at: int, chars: frozenset, floor: int) -> int:
    """Start of the run of `chars` that ends at `at`."""
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = _run_back(text, at, _LOCAL, floor)
    end, found = _run(text, at + 1, _LABEL), 0
    if start == at or end == at + 1:
        return None
    while text[end : end + 1] == "." and (after := _run(text, end + 1, _LABEL)) > end + 1:
        end = found = after
    return (start, end) if found else None


def _masked(text: str, at: int, size: int, floor: int) -> tuple[int, int] | None:
    name = at - 1 if at > floor and text[at - 1] == " " else at
    start = _run_back(text, name, _LOCAL, floor)
    here = at + size
    here += text[here : here + 1] == " "
    end = _run(text, here, _LABEL)
    if start == name or end == here:
        return None
    found = 0
    while True:
        if text[end : end + 1] == ".":
            here = end + 1
        else:
            here = end + (text[end : end + 1] == " ")
            if not (dot := next((d for d in DOTS if text.startswith(d, here)), "")):
                break
            here += len(dot)
            here += text[here : here + 1] == " "
        if (after := _run(text, here, _LABEL)) == here:
            break
        end = found = after
    return (start, end) if found else None


def _login(text: str, at: int, size: int) -> tuple[int, int] | None:
    here, n = at + size, len(text)
    user = here
    while here < n and text[here] not in _STOP and text[here] != ":":
        here += 1
    if here == user or text[here : here + 1] != ":":
        return None
    while here < n and text[here] not in _STOP:
        here += 1
    if text[here : here + 1] != "@":
        return None
    end = _run(text, here + 1, _HOST)
    return (at, end) if end > here + 1 else None


def _account(text: str, at: int, size: int) -> tuple[int, int, bool] | None:
    """The number behind a cue: up to two letters, two digits, maybe four letters, more digits in groups."""
    start = at + size
    end = _run(text, start, _BEHIND_CUE)
    if not 1 <= end - start <= 3:
        return None
    start = end
    end = _run(text, start, _UPPER)
    country = end - start
    if country > 2 or not (text[end : end + 1] in _DIGITS and text[end + 1 : end + 2] in _DIGITS):
        return None
    end += 2
    bank = end + (text[end : end + 1] == " ")
    if all(text[i : i + 1] in _UPPER for i in range(bank, bank + 4)):
        end = bank + 4
    more = _groups(text, end)
    if more == end:
        return None
    plain = "".join(c for c in text[start:more] if c not in " -")
    digits = sum(c in _DIGITS for c in plain)
    valid = 6 <= digits <= 30 and (country < 2 or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    return start, more, valid


def _groups(text: str, at: int) -> int:
    """End of the digits from `at` on, each with at most one space or hyphen before it."""
    while True:
        if text[at : at + 1] in _DIGITS and at < len(text):
            at += 1
        elif text[at : at + 1] in (" ", "-") and at + 1 < len(text) and text[at + 1] in _DIGITS:
            at += 2
        else:
            return at


def find(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span in code points, by start, then kind."""
    text, spans = text or "", []
    floors = [0] * len(KINDS)
    n = len(text)

    def take(kind: int, start: int, end: int, valid: bool) -> None:
        floors[kind] = end  # what fails a check is used up as well
        if valid:
            spans.append((start, kind, end))

    for last, (what, size) in _automaton().iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= floors[1]:
                end, parts = _run(text, at, _DIGITS), [at]
                while len(parts) < 4 and text[end : end + 1] == "." and (after := _run(text, end + 1, _DIGITS)) > end + 1:
                    parts.append(end + 1)
                    end = after
                if len(parts) == 4:
                    values = [text[a:b].lstrip("0") or "0" for a, b in zip(parts, [p - 1 for p in parts[1:]] + [end])]
                    take(1, at, end, all(len(v) <= 3 and int(v) <= 255 for v in values))
                else:
                    floors[1] = _run(text, at, _DIGITS)
            if at >= floors[2]:
                end = _groups(text, at)
                digits = [c for c in text[at:end] if c in _DIGITS]
                take(2, at, end, 14 <= len(digits) <= 19 and _luhn("".join(digits)))
        elif what == "at" and at >= floors[0]:
            if found := _email(text, at, floors[0]):
                take(0, *found, True)
        elif what == "plus":
            if at + 1 < n and text[at + 1] in _DIGITS:
                end = _run(text, at + 2, _DIAL)
                while end > at + 3 and text[end - 1] not in _DIGITS:
                    end -= 1
                if end > at + 3:
                    take(3, at, end, 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15)
        elif what == "scheme" and at >= floors[4]:
            if found := _login(text, at, size):
                take(4, *found, True)
        elif what == "masked" and at >= floors[5]:
            if found := _masked(text, at, size, floors[5]):
                take(5, *found, True)
        elif what == "cue" and at >= floors[6]:
            if found := _account(text, at, size):
                take(6, *found)
    return sorted(spans)


_SPAN = StructType([StructField(x, IntegerType()) for x in ("start", "kind", "end")])
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[{"start": a, "kind": k, "end": b} for a, k, b in find(t)] for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _ARROW_SPANS)], names=[*batch.schema.names[:-1], "spans"])


def with_spans(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` and `spans`, an array of (start, kind number, end) per row; a null text has none."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    return kept.mapInArrow(_scan, StructType([*kept.schema.fields[:-1], StructField("spans", ArrayType(_SPAN))]))


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, and all spans as text.

    Null and empty texts have no span and the digest of the empty string. Repeated rows stay; null ids stay null.
    """
    prepare(docs.sparkSession)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    base, counts = F.filter("spans", lambda s: s["kind"] < BASE), map(count, range(BASE))
    return with_spans(docs, ["doc_id"]).select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def _hide(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or several that overlap, as the upper-case name of the first one's kind in square brackets."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        texts = [t and _hide(t, find(t)) for t in batch.column(k).to_pylist()]
        yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced; n_chars, where there is one, follows the new text. Rows and columns stay."""
    prepare(docs.sparkSession)
    out = docs.mapInArrow(_redact, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op7_pii(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"))


_CUE = "|".join(form for c in CUES for form in (c, c.capitalize(), c.upper()))
_AT, _DOT = ("(?:" + "|".join(f"\\{s[0]}{s[1:-1]}\\{s[-1]}" for s in signs) + ")" for signs in (AT_SIGNS, DOTS))

#: The same spans as regular expressions; the last one's span is its group.
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    r"[0-9](?:[\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
    r"(?:https?|ftp)://[^\x00-\x20/?#@:]+:[^\x00-\x20/?#@]*@[A-Za-z0-9.-]+",
    rf"[A-Za-z0-9._%+-]+ ?{_AT} ?[A-Za-z0-9-]+(?:(?:\.| ?{_DOT} ?)[A-Za-z0-9-]+)+",
    rf"(?:{_CUE})[ :#=.]{{1,3}}([A-Z]{{0,2}}[0-9]{{2}}(?: ?[A-Z]{{4}})?(?:[ -]?[0-9])+)",
)


def _found_sql(kind: int, pattern: str) -> str:
    """(rid, kind, start, m) of one kind: matches and the gaps between them give the places."""
    group = 1 if kind == len(KINDS) - 1 else 0
    return (
        f"SELECT rid, {kind} AS kind, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'start': list_sum(list_transform(gaps[1:i], lambda g: length(g)))"
        " + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) + length(ms[i]) - length(own[i]), 'm': own[i]})) AS s"
        f" FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS own, string_split_regex(t, '{pattern}') AS gaps FROM d)"
    )


_DIGITS_SQL = "regexp_replace(s.m, '[^0-9]', '', 'g')"
_PLAIN_SQL = "regexp_replace(s.m, '[ -]', '', 'g')"
_LUHN_SQL = (
    f"list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda i: CAST(substr({_DIGITS_SQL}, -i, 1) AS INTEGER) * (1 + (i - 1) % 2)"
    f" - CASE WHEN CAST(substr({_DIGITS_SQL}, -i, 1) AS INTEGER) * (1 + (i - 1) % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"
)
_IBAN_SQL = (
    f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(substr({_PLAIN_SQL}, 5) || substr({_PLAIN_SQL}, 1, 4), ''), lambda c: CAST(CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT))),"
    " lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97) = 1"
)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_found_sql(k, p) for k, p in enumerate(PATTERNS))}),
valid AS (
  SELECT rid, kind, concat_ws(':', [{", ".join(f"'{k}'" for k in KINDS)}][kind + 1], s.start, s.start + length(s.m)) AS span, s.start AS start FROM found
  WHERE CASE kind
    WHEN 1 THEN len(list_filter(string_split(s.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INTEGER), 0) > 255)) = 0
    WHEN 2 THEN length({_DIGITS_SQL}) BETWEEN 14 AND 19 AND {_LUHN_SQL}
    WHEN 3 THEN length({_DIGITS_SQL}) BETWEEN 10 AND 15
    WHEN 6 THEN length({_DIGITS_SQL}) BETWEEN 6 AND 30 AND (NOT regexp_matches({_PLAIN_SQL}, '^[A-Z]{{2}}') OR {_IBAN_SQL})
    ELSE true END
), each AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k]}" for k in range(BASE))},
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < {BASE}) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM valid GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k]}, 0) AS n_{KINDS[k]}" for k in range(BASE))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN each USING (rid)
"""
