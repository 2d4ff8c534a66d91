import random
import re

import xxhash

from shelfspark.llm import simhash_dedup as op
from shelfspark.llm.graph import components
from tests.llm.conftest import rows


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=2):
    seen, out = set(), [None] * len(ids)
    for i in range(len(ids)):
        if i in seen:
            continue
        group, open_ = {i}, [i]
        while open_:
            a = open_.pop()
            for b in range(len(ids)):
                if b not in group and (fps[a] ^ fps[b]).bit_count() <= radius:
                    group.add(b)
                    open_.append(b)
        seen |= group
        least = min((ids[j] for j in group if ids[j] is not None), default=None)
        for j in group:
            out[j] = least
    return out


def sample():
    r = random.Random(4)
    vocabulary = [f"W{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 40, 400]))) for _ in range(60)]
    for t in texts[:20]:
        words = t.split(" ")
        words[r.randrange(len(words))] = "changed"
        texts += [" ".join(words), t, t.upper() if t.isascii() else t + "\n"]
    texts += [None, "", " \t\x0b\n", "a b c", "x" * 300_000, "y " * 200_000]
    return texts


def test_matches_brute_force(docs_of):
    texts = sample()
    ids = [None if i == 5 else i % 110 for i in range(len(texts))]
    fps = [plain_fingerprint(t) for t in texts]
    want = sorted(((i, format(f, "016x"), c) for i, f, c in zip(ids, fps, plain_components(ids, fps))), key=repr)
    assert rows(op.near_duplicates(docs_of(list(zip(ids, texts))))) == want


def test_one_of_each_group_stays(docs_of):
    texts = sample()
    docs = docs_of(list(enumerate(texts)))
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    fps = [plain_fingerprint(t) for t in texts]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(range(len(texts)), fps)))


def test_rows_of_one_id_and_null_ids(docs_of):
    docs = docs_of([(7, "same text here"), (7, "same text here"), (None, "same text here"), (None, None)])
    assert [r.doc_id for r in op.keep_one(docs).collect()].count(7) == 1
    assert op.keep_one(docs).count() == 2


def test_empty_table(docs_of):
    assert op.near_duplicates(docs_of([])).collect() == []
    assert op.keep_one(docs_of([])).collect() == []


def test_tree_finds_all_within_the_radius():
    r = random.Random(1)
    values = sorted({r.getrandbits(64) for _ in range(50)} | {1 << i for i in range(64)} | {0})
    tree = op.BKTree()
    for v in values:
        tree.add(v)
    for v in values:
        for radius in (0, 1, 2, 5):
            assert sorted(tree.within(v, radius)) == [x for x in values if (x ^ v).bit_count() <= radius]


def test_hot_shards_lose_no_link(spark, monkeypatch):
    """Thousands of fingerprints in one shard are dealt again by their free bits, twice."""
    monkeypatch.setattr(op, "SHARD", 16)
    r = random.Random(2)
    low = sorted({r.getrandbits(20) for _ in range(900)})
    df = spark.createDataFrame([(x,) for x in low], "fp long")
    found = {frozenset(x) for x in map(tuple, op.fingerprint_links(df).collect())}
    assert all((a ^ b).bit_count() <= 2 for a, b in map(tuple, found))
    parent = {x: x for x in low}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in map(tuple, found):
        parent[root(a)] = root(b)
    got = [root(x) for x in low]
    want = plain_components(low, low)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want))) == len(set(want))


def test_components_of_chains_hubs_and_repeats(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(200)] + [(5, 4), (5, 4), (-9, -8)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(201)} | {-9: -9, -8: -9}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
