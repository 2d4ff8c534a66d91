import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import pii as op

CUES = "|".join(form for c in op.CUES for form in (c, c.capitalize(), c.upper()))
AT, DOT = r"(?:\(at\)|\[at\]|\(AT\)|\[AT\])", r"(?:\(dot\)|\[dot\]|\(DOT\)|\[DOT\])"
PATTERNS = [
    re.compile(p)
    for p in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"(?:https?|ftp)://[^\x00-\x20/?#@:]+:[^\x00-\x20/?#@]*@[A-Za-z0-9.-]+",
        rf"[A-Za-z0-9._%+-]+ ?{AT} ?[A-Za-z0-9-]+(?:(?:\.| ?{DOT} ?)[A-Za-z0-9-]+)+",
        rf"(?:{CUES})[ :#=.]{{1,3}}([A-Z]{{0,2}}[0-9]{{2}}(?: ?[A-Z]{{4}})?(?:[ -]?[0-9])+)",
    )
]
PARTS = (
    ["a", "b.", "@", "1", "2", "12", "+", "+1", " ", "-", ".", "(", ")", "255", "256", "4111 1111 1111 1111", "1.2.3.4", "x@y.z"]
    + ["http://", "https://u:p@h", "ftp://", ":", "/", "(at)", " [at] ", " [dot] ", "account ", "IBAN: ", "DE89 3704 0044 0532 0130 00"]
    + ["GB82 WEST 1234 5698 7654 32", "ssn", "é", "İ", "%", "\n", "AB12", "4111111111111111", "\U0001f600"]
)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match[0])
    if kind == 1:
        return all(int(p) <= 255 for p in match[0].split("."))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15
    if kind == 6:
        plain = re.sub("[ -]", "", match[1])
        iban = plain[:2].isalpha()
        return 6 <= len(re.sub("[^0-9]", "", plain)) <= 30 and (not iban or int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)
    return True


def plain_spans(text):
    found = ((m.start(1) if k == 6 else m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text or "") if valid(k, m))
    return sorted(found)


def written(spans):
    return ",".join(f"{op.KINDS[k]}:{a}:{b}" for a, k, b in spans)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_parsers_equal_the_patterns(text):
    assert op.find(text) == plain_spans(text)


def test_rows(docs_of):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(20)) for _ in range(60)] + [None, "", "1 " * 100_000, "a@" * 50_000 + "a@b.c", "mail x@y.zz and x@y.zz"]
    docs = docs_of([(None if i == 3 else i % 50, t) for i, t in enumerate(texts)])
    got = sorted(map(tuple, op.personal_data(docs).collect()), key=repr)
    want = []
    for i, t in enumerate(texts):
        spans = plain_spans(t)
        base = [s for s in spans if s[1] < 4]
        counts = [sum(s[1] == k for s in spans) for k in range(4)]
        want.append((None if i == 3 else i % 50, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
    assert got == sorted(want, key=repr)
    assert op.personal_data(docs_of([])).collect() == []


def test_redaction_hides_spans_and_keeps_rows(docs_of):
    docs = docs_of([(1, "write to ann@site.org, call +1 (212) 555-0101 now"), (2, None), (3, ""), (4, "nothing here"), (5, "account: 12345678")])
    got = {r.doc_id: r for r in op.redacted(docs).collect()}
    assert op.redacted(docs).columns == docs.columns
    assert got[1].text == "write to [EMAIL], call [PHONE] now" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "" and got[4].text == "nothing here" and got[5].text == "account: [ACCOUNT]"


def test_the_statement_finds_the_same(tmp_path):
    import duckdb

    r = random.Random(11)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [None, "IBAN: DE89 3704 0044 0532 0130 00", "account 1234567", "9" * 40, "1.2.3.256"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = {row[0]: row[1:] for row in con.execute(op.ORACLE_SQL).fetchall()}
    for i, t in enumerate(texts):
        spans = op.find(t)
        counts = tuple(sum(s[1] == k for s in spans) for k in range(4))
        base = hashlib.sha256(written([s for s in spans if s[1] < 4]).encode()).hexdigest()
        assert got[i] == (*counts, base, written(spans)), t
