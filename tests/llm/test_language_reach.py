import random

from shelfspark.llm import language_id as op
from tests.llm.test_language_id import corpus


def test_clean_texts_of_a_language_with_many_characters_stay(docs_of, monkeypatch):
    """Most running trigrams are too rare for the profile, as they are in a large corpus."""
    monkeypatch.setattr(op, "MIN_SHARE", 1e-3)
    r = random.Random(2)
    common = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(6)) for _ in range(6)]
    clean = []
    for i in range(300):
        parts = ["".join(chr(0x4E00 + r.randrange(6000)) for _ in range(30)) for _ in range(3)]
        clean.append((2000 + i, "".join(p + r.choice(common) for p in parts), "zh"))
    docs = docs_of(corpus(200) + clean + [(9000, "жжж щщщ ююю", None), (9001, "12 34", "zh")])
    model = op.learn(docs.select("text", "lang"))
    assert sum(model.judge(t)[1] < op.MIN_SCORE for _, t, _ in clean) > 200
    assert {x.doc_id for x in op.keep_identified(docs).collect()} == set(range(200)) | {i for i, *_ in clean}


def test_without_labels_documents_with_letters_stay(docs_of):
    docs = docs_of([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "", None), (5, "жук", None)])
    kept = op.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(x.doc_id for x in kept.collect()) == [1, 5]
