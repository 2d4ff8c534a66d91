import random

import numpy as np

from shelfspark.llm import jaccard
from shelfspark.llm import paragraph_dedup as op
from shelfspark.llm.queries import QUERIES
from tests.llm.conftest import rows


def plain_units(text):
    """[(from_word, words)] of a text, from its definition."""
    hashes, lines, blocks = op.word_hashes(text)
    if not len(hashes):
        return []
    words = (text or "").lower().split()
    starts, lengths = op.spans(hashes, np.array([len(words)]), np.array(lines), np.array(blocks))
    return [(s, tuple(words[s : s + n])) for s, n in zip(starts.tolist(), lengths.tolist())]


def plain_rows(docs):
    """Brute force: all pairs of units that share a shingle, exact Jaccard, components."""
    units = [(row, doc, at, words) for row, (doc, text) in enumerate(docs) for at, words in plain_units(text)]
    group, holders, sets = list(range(len(units))), {}, {}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (*_, words) in enumerate(units):
        if words in sets:
            group[i] = root(sets[words][0])
            continue
        own = {words[k : k + 5] for k in range(len(words) - 4)}
        sets[words] = (i, own)
        for j in {j for x in own for j in holders.get(x, ())}:
            other = sets[units[j][3]][1]
            both = len(own & other)
            if both >= 0.8 * (len(own) + len(other) - both):
                group[root(i)] = root(j)
        for x in own:
            holders.setdefault(x, []).append(i)
    classes = {}
    for i in range(len(units)):
        classes.setdefault(root(i), []).append(i)
    out = []
    for members in classes.values():
        if len({units[i][0] for i in members}) > 1:
            first = min(members, key=lambda i: (units[i][1] is None, units[i][1] or 0, units[i][0], units[i][2], len(units[i][3])))
            out += [(units[i][1], units[i][2], len(units[i][3]), units[first][1], i != first) for i in members]
    return sorted(out, key=repr)


def text(r, n, vocabulary=300):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def sample(seed=6):
    r = random.Random(seed)
    passages = [text(r, n) for n in (30, 55, 70, 120)]
    docs = []
    for i in range(50):
        parts = [text(r, r.choice([0, 5, 25, 90])) for _ in range(3)]
        if i % 2:
            passage = r.choice(passages).split()
            if i % 6 == 1:
                passage[-1] = "other"
            parts[1] += " " + " ".join(passage) + " " * (i % 3) + text(r, 4)
        docs.append((i, "\n".join(parts)))
    docs += [(60, None), (61, ""), (62, "a short line\n" * 40), (None, docs[3][1]), (63, docs[5][1].upper()), (64, docs[5][1]), (64, docs[5][1])]
    docs += [(70, "again and " * 300), (71, "start " + "again and " * 200)]
    return docs


def test_matches_brute_force(docs_of):
    docs = sample()
    want = plain_rows(docs)
    assert len(want) > 30
    assert rows(op.repeated_passages(docs_of(docs))) == want


def test_hot_buckets_lose_no_link(docs_of, monkeypatch):
    """One line in hundreds of versions that differ at their ends."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    r = random.Random(3)
    base = text(r, 40).split()
    docs = [(i, " ".join([f"a{r.randrange(40)}", *base[1:-1], f"b{r.randrange(40)}"])) for i in range(200)]
    assert rows(op.repeated_passages(docs_of(docs))) == plain_rows(docs)


def test_passages_inside_other_lines_are_found(docs_of):
    r = random.Random(9)
    docs, planted = [], set()
    for k in range(40):
        passage = text(r, r.randint(60, 90), 5000)
        for j in range(2):
            docs.append((2 * k + j, f"{text(r, r.randint(20, 90), 5000)} {passage} {text(r, r.randint(20, 90), 5000)}"))
            planted.add(2 * k + j)
    clean = [(1000 + k, text(r, 300, 5000)) for k in range(40)]
    found = {r.doc_id for r in op.repeated_passages(docs_of(docs + clean)).collect()}
    assert len(planted & found) >= 0.95 * len(planted) and found <= planted


def test_bands_reach_the_recall():
    assert 1 - (1 - op.SIMILARITY**op.ROWS) ** op.BANDS >= op.RECALL
    r = random.Random(4)
    caught = 0
    for _ in range(300):
        base = [r.getrandbits(32) for _ in range(20)]
        other = base[:-2] + [r.getrandbits(32) for _ in range(2)]  # 18 of 22
        keys = op.band_keys(np.array(base + other, np.uint32), np.array([0, 20]), op.BANDS, op.ROWS)
        caught += bool((keys[0] == keys[1]).any())
    assert caught >= 0.97 * 300


def test_registered_query_reaches_the_recall_on_whole_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {r[:3] for r in plain_rows(docs)}
    got = {(r.doc_id, r.from_word, r.words) for r in QUERIES["op10_paragraph_dedup"](spark, folder).collect()}
    assert len(want) > 500 and got <= want and len(got) >= 0.98 * len(want)


def test_long_texts_in_pieces_give_the_same(docs_of, monkeypatch):
    docs = sample()
    whole = rows(op.repeated_passages(docs_of(docs)))
    monkeypatch.setattr(op, "PIECE_WORDS", 50)
    assert rows(op.repeated_passages(docs_of(docs))) == whole


def test_a_very_long_text(docs_of):
    r = random.Random(10)
    base = text(r, 150_000, 60_000)
    docs = [(1, base), (2, text(r, 40, 60_000) + "\n" + base + "\n" + text(r, 40, 60_000)), (3, text(r, 400, 60_000))]
    found = [x for x in op.repeated_passages(docs_of(docs)).collect() if x.removed]
    assert {x.doc_id for x in found} == {2}
    assert len({w for x in found for w in range(x.from_word, x.from_word + x.words)}) >= 149_000


def test_empty_table(docs_of):
    assert op.repeated_passages(docs_of([])).collect() == []
    assert op.repeated_passages(docs_of([(1, "only one " * 30)])).collect() == []


def wrapped(words, width):
    return "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_passages_meet_however_they_are_wrapped(spark, docs_of, folder_of):
    r = random.Random(4)
    docs, alone, inside = [], {}, {}
    for k in range(20):
        passage, other = text(r, 60, 5000).split(), text(r, 60, 5000).split()
        for j, width in enumerate((8, 13, 30, 60)):
            before, after = text(r, r.randint(20, 60), 5000).split(), text(r, r.randint(20, 60), 5000).split()
            i = 10 * k + j
            # once as a paragraph of its own, once in the middle of wrapped text
            docs.append((i, "\n\n".join([wrapped(before, width), wrapped(passage, width), wrapped(after, width)])))
            docs.append((1000 + i, wrapped(before[::-1] + other + after[::-1], width)))
            alone[i] = set(range(len(before), len(before) + 60))
            inside[1000 + i] = set(range(len(before), len(before) + 60))
    docs += [(5000 + k, wrapped(text(r, 300, 5000).split(), 13)) for k in range(20)]
    docs += [(6000, None), (6001, ""), (6002, "\n\n")]
    got = {}
    for row in QUERIES["op10_paragraph_dedup"](spark, folder_of(documents=docs_of(docs))).where("removed").collect():
        got.setdefault(row.doc_id, set()).update(range(row.from_word, row.from_word + row.words))
    for i, words in alone.items():
        # a piece over the passage's end can be similar as a whole, and then goes with its other words
        near = set(range(min(words) - 16, max(words) + 17))
        assert words <= got[i] <= near if i % 10 else i not in got
    hit = [i for i in inside if i % 10 and got.get(i)]
    # what of the passage is left are the words before its first cut and after its last one
    assert len(hit) >= 0.95 * 60 and all(len(got[i] - inside[i]) <= 32 for i in hit)
    assert sum(len(got[i] & inside[i]) for i in hit) >= 0.5 * 60 * len(hit)
    assert set(got) <= set(alone) | set(inside) and not any(got.get(i) for i in inside if i % 10 == 0)


def test_spans_have_lines_blocks_and_pieces_once():
    hashes = np.arange(1, 101, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts, lengths = op.spans(hashes, np.array([60, 40]), np.array([30, 30, 10, 30]), np.array([60, 40]))
    found = list(zip(starts.tolist(), lengths.tolist()))
    assert {(0, 30), (30, 30), (70, 30), (0, 60), (60, 40)} <= set(found) and len(found) == len(set(found))
    assert not any(s < 60 < s + n for s, n in found)
