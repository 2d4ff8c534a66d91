import random
import re
from collections import Counter

from shelfspark.llm import decontaminate as op
from tests.llm.conftest import rows


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain_shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_leaks(docs, items):
    """{(doc, item): similarity} over all windows of the item's size."""
    out = {}
    for d, text in docs:
        words = plain_words(text)
        for i, item in items:
            wanted = plain_words(item)
            if not wanted or not words:
                continue
            n, theirs, best = len(wanted), plain_shingles(wanted), 0
            for s in range(len(words)):
                own = plain_shingles(words[s : s + n])
                both = sum((own & theirs).values())
                best = max(best, both / (sum(own.values()) + sum(theirs.values()) - both))
            if best >= 0.8:
                out[d, i] = best
    return out


def sample(seed=5):
    r = random.Random(seed)
    vocabulary = [f"word{i}" for i in range(40)] + ["Éa", "naïve"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([3, 5, 12, 35, 60]))) for i in range(12)] + [(20, None), (21, " ..."), (22, "same same same same same same same same")]
    items.append((23, items[3][1]))
    docs = []
    for k in range(160):
        body = text(r.choice([0, 4, 60])).split()
        if k % 2:
            own = r.choice(items[:12] + items[14:15])[1].upper().split()
            for _ in range(k % 3):  # one or two changed, dropped or inserted words
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([[], ["other"], [own[at], "other"]])
            if k % 11 == 0:
                own = own[len(own) // 2 :] + own[: len(own) // 2]
            at = r.randint(0, len(body))
            body[at:at] = own
        docs.append((k, ", ".join(body)))
    return docs + [(300, None), (301, ""), (302, "same " * 500), (303, items[4][1] + " " + "z " * 50_000)], items


def test_finds_what_brute_force_finds(docs_of, spark):
    docs, items = sample()
    want = plain_leaks(docs, items)
    assert len(want) > 20
    table = spark.createDataFrame([(*x, "q") for x in items], "item_id long, text string, words string")
    got = {(r.doc_id, r.item_id): r for r in op.leaks(docs_of(docs), table).collect()}
    # a near window may lie past the radius; exact ones never do
    assert got.keys() <= want.keys()
    assert {k for k, v in want.items() if v == 1} <= got.keys()
    assert len(got) >= 0.98 * len(want)
    assert all(abs(got[k].similarity - want[k]) < 1e-9 and got[k].hamming <= op.RADIUS for k in got)


def test_only_pairs_that_share_a_shingle_meet(docs_of, spark, monkeypatch):
    docs, items = sample()
    met = []
    plain_met = op._met

    def counted(windows, known, grams):
        pairs = windows.select("key", "n", "gram").join(grams.select("n", "gram", grams["key"].alias("item")), ["n", "gram"]).count()
        found = plain_met(windows, known, grams)
        met.append((found.select("key", "item").distinct().count(), pairs, windows.count() * known.count()))
        return found

    monkeypatch.setattr(op, "_met", counted)
    op.leaks(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    [(found, sharing, all_pairs)] = met
    assert 0 < found <= sharing < 0.2 * all_pairs


def test_a_window_starts_where_it_says(docs_of, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    got = op.leaks(docs_of([(1, "one two " + item + " three"), (1, "one two " + item + " three"), (None, item)]), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert rows(got, "doc_id", "item_id", "similarity", "hamming", "start", "words") == [(1, 9, 1.0, 0, 2, 8), (None, 9, 1.0, 0, 0, 8)]


def test_contaminated_documents_go(docs_of, spark):
    items = spark.createDataFrame([(9, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    docs = docs_of([(1, "x alpha beta gamma delta epsilon zeta y"), (2, "clean"), (None, "alpha beta gamma delta epsilon zeta"), (3, None), (2, "clean")])
    for name in ("_id", "_hash", "text_hash", "item_id"):
        docs = docs.withColumn(name, docs["doc_id"])
    kept = op.without_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3]


def test_empty_tables(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.leaks(docs_of([(1, "a b c d e f")]), none).collect() == []
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert op.leaks(docs_of([]), some).collect() == []
    assert op.without_leaks(docs_of([(1, "a")]), none).count() == 1


def test_native(docs_of, spark):
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    plan = op.leaks(docs_of([(1, "a b c d e f")]), some)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
