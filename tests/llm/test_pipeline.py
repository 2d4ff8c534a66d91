import random
import re
from collections import defaultdict

import corpus_pipeline
from shelfspark.llm import language_id, pii
from shelfspark.llm.common import stored
from tests.llm.test_decontaminate import plain_leaks
from tests.llm.test_language_id import WORDS
from tests.llm.test_mixing import plain_targets
from tests.llm.test_pii import plain_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    item = " ".join(r.choice(WORDS["en"]) + str(i) for i in range(20))
    docs = []
    for i in range(120):
        lang = r.choice(sorted(WORDS))
        text = " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(20, 90)))
        if i % 9 == 0:
            text += " write to ann@site.org now"
        if i % 13 == 0:
            text += " " + item
        docs.append((i, text, lang, f"s{i % 4}"))
    # near copies: a word changed, and the same with so many changed that they are texts of their own
    for k in range(30):
        words = docs[k][1].split()
        for at in range(3, len(words), 40 if k % 2 else 6):
            words[at] = "changed"
        docs.append((400 + k, " ".join(words), docs[k][2], "s2"))
    docs += [(200 + k, docs[k][1], docs[k][2], "s1") for k in range(10)] + [(None, docs[20][1], "en", None), (300, None, None, "s0"), (301, "12 34", "en", "s0"), (5, docs[5][1], docs[5][2], "s1")]
    return docs, [(0, item), (1, None)]


def plain_languages(docs, model):
    """What reaches 0.3 of the median score of its language's labelled documents."""
    judged = [(d, *model.judge(d[1])[:2]) for d in docs]
    own = defaultdict(list)
    for d, lang, score in judged:
        if lang == d[2]:
            own[lang].append(score)
    usual = {k: sorted(v)[-(-len(v) // 2) - 1] for k, v in own.items()}
    return [d for d, lang, score in judged if lang != "und" and score >= language_id.MIN_SCORE * usual.get(lang, 1.0)]


def plain_copies(docs):
    """One of each component of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for d in docs:
        words = (d[1] or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))})
    group = list(range(len(docs)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    order = lambda i: (docs[i][0] is None, docs[i][0] or 0, i)
    winners = {min((i for i in range(len(docs)) if root(i) == g), key=order) for g in {root(i) for i in range(len(docs))}}
    return [docs[i] for i in sorted(winners)]


def plain_pipeline(docs, items, model):
    """Each stage in plain Python but for the learned language filter: (doc_id, source, size, source_size, target)."""
    docs = plain_copies(plain_languages(docs, model))
    found = {d for d, _ in plain_leaks(list(enumerate(t for _, t, *_ in docs)), items)}
    docs = [d for i, d in enumerate(docs) if i not in found]
    out, sizes = [], defaultdict(int)
    for i, text, _, source in docs:
        for start, kind, end in reversed(plain_spans(text)):
            text = f"{text[:start]}[{pii.KINDS[kind].upper()}]{text[end:]}"
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        sizes[source] += size
        out.append((i, source, size))
    targets = plain_targets(sizes)
    return sorted(((i, s, n, sizes[s], round(targets[s], 6)) for i, s, n in out), key=repr)


def test_run_equals_the_plain_version(spark, folder_of):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], COLUMNS).coalesce(1)
    folder = folder_of(documents=frame, benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = corpus_pipeline.run(spark, folder).collect()
    model = language_id.learn(frame.select("text", "lang"))
    want = plain_pipeline(docs, items, model)
    assert 60 < len(want) < 150
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, round(r.target, 6)) for r in got), key=repr) == want
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in got)


def test_stages_keep_columns_and_take_empty_tables(spark, folder_of):
    docs, items = corpus()
    frame = spark.createDataFrame([(*d, len(d[1] or ""), "x") for d in docs], COLUMNS + ", rid string")
    folder = folder_of(benchmark=spark.createDataFrame(items, "item_id long, text string"))
    for rows in (frame, frame.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stored(stage(spark, rows, folder), "stage")
            assert out.columns == rows.columns, name
            assert out.count() <= rows.count()
            rows = out
        assert corpus_pipeline.STAGES[-1][1](spark, rows, folder).count() == rows.count()


def test_clean_documents_stay(spark, folder_of):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(WORDS[k]) + r.choice(["", ".", ","]) for _ in range(40)), k, "s") for i, k in enumerate(list(WORDS) * 20)]
    frame = spark.createDataFrame([(*d, len(d[1])) for d in docs], COLUMNS)
    folder = folder_of(documents=frame, benchmark=spark.createDataFrame([(1, "an item that no text here holds at all")], "item_id long, text string"))
    assert {x.doc_id for x in corpus_pipeline.run(spark, folder).collect()} == {d[0] for d in docs}
