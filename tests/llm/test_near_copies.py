import random

import corpus_pipeline
from shelfspark.llm import jaccard
from shelfspark.llm import near_copies as op
from shelfspark.llm.simhash_dedup import simhash


def plain_kept(docs):
    """Brute force over all pairs: the first id of every component."""
    sets = []
    for _, text in docs:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))})
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {docs[i][0] for i in range(len(docs)) if root(i) == i}


def changed(r, words, n):
    """The words with n of them replaced, some way from each other."""
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_stage_drops_copies_with_changed_words_and_keeps_what_is_under(spark, docs_of):
    r = random.Random(5)
    docs = []
    for k in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(100, 250))]
        docs += [(10 * k, " ".join(base)), (10 * k + 1, changed(r, base, 2)), (10 * k + 2, changed(r, base, 8)), (10 * k + 3, " ".join(base).upper())]
    docs += [(900, "a b"), (901, "A  b"), (902, "a b c"), (903, None), (904, ""), (905, " ")]
    frame = docs_of(docs)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.schema == frame.schema
    got = {r.doc_id for r in kept.collect()}
    assert got == plain_kept(docs)
    assert not any(10 * k + 1 in got for k in range(40)) and sum(10 * k + 2 in got for k in range(40)) > 10


def test_hot_buckets_lose_no_link(docs_of, monkeypatch):
    """One text in hundreds of versions, and versions of a version: blocks, then rounds with chosen members."""
    monkeypatch.setattr(jaccard, "BUCKET", 8)
    monkeypatch.setattr(jaccard, "MEMBERS", 20)
    monkeypatch.setattr(jaccard, "CHOSEN", 5)
    r = random.Random(7)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    docs = []
    for i in range(150):
        words = list(base)
        for at in range(0, 12 * (i % 4) // 2, 6):
            words[at] = f"v{r.randrange(2)}"
        docs.append((i, changed(r, words, i % 5)))
    assert {r.doc_id for r in op.keep_one(docs_of(docs)).collect()} == plain_kept(docs)


def test_rows_grow_with_the_group(spark, docs_of, monkeypatch):
    """Versions of one text, twice as many each time: what meets in tasks must not grow with their pairs."""
    met = []
    compared = jaccard._compared

    def counted(rows, sets):
        met[-1] += rows.count()
        return compared(rows, sets)

    monkeypatch.setattr(jaccard, "_compared", counted)
    r = random.Random(11)
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    docs = [(i, changed(r, base, i % 4)) for i in range(1200)]
    for n in (300, 600, 1200):
        met.append(0)
        assert {x.doc_id for x in op.keep_one(docs_of(docs[:n])).collect()} == plain_kept(docs[:n])
    assert met[2] <= 2.6 * met[1] and met[1] <= 3.5 * met[0] and met[2] <= 60 * 1200


def test_a_bucket_of_texts_that_are_not_similar(docs_of, monkeypatch):
    """A shared half makes texts collide that are not linked, but for pairs among them."""
    monkeypatch.setattr(jaccard, "BUCKET", 4)
    r = random.Random(12)
    half = [f"h{i}" for i in range(60)]
    docs = []
    for i in range(60):
        own = [f"o{r.randrange(10**6)}" for _ in range(30)]
        docs += [(2 * i, " ".join(half + own))] + ([(2 * i + 1, " ".join(half + own[:-1] + ["end"]))] if i % 3 == 0 else [])
    kept = {x.doc_id for x in op.keep_one(docs_of(docs)).collect()}
    assert kept == plain_kept(docs) and len(kept) == 60


def test_a_very_long_text(docs_of):
    r = random.Random(13)
    base = [f"w{r.randrange(50000)}" for _ in range(200_000)]
    docs = [(1, " ".join(base)), (2, changed(r, base, 2000)), (3, " ".join(base[:100_000])), (4, "short text of some words here")]
    assert {x.doc_id for x in op.keep_one(docs_of(docs)).collect()} == {1, 3, 4}


def test_ids_and_empty_tables(docs_of):
    docs = docs_of([(7, "same text here"), (7, "same text here"), (None, "same text here"), (None, None), (3, None)])
    assert sorted(r.doc_id for r in op.keep_one(docs).collect()) == [3, 7]
    assert op.keep_one(docs_of([])).collect() == []


def test_fingerprints_alone_find_the_closest_copies(docs_of, monkeypatch):
    """Without any band, BK-trees over SimHash still give candidates; what they give is held to the exact similarity."""
    bands = op.shared_bands
    monkeypatch.setattr(op, "shared_bands", lambda rows, once: bands(rows, once).limit(0))
    r = random.Random(8)
    docs, close = [], set()
    for k in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(400)]
        other = changed(r, base, 1)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, other)]
        if (simhash(docs[-1][1]) ^ simhash(docs[-2][1])).bit_count() <= 2:
            close.add(2 * k + 1)
    docs += [(500, "one two three four five six seven"), (501, "one two three four five six eight")]  # under 0.8
    assert len(close) > 5
    kept = {x.doc_id for x in op.keep_one(docs_of(docs)).collect()}
    assert {d for d, _ in docs} - kept == close
