import random
import zlib

from shelfspark.llm import language_id as op
from tests.llm.conftest import rows

WORDS = {
    "en": "the house and river were bright when she walked through green fields toward morning light".split(),
    "de": "der hund und die katze laufen durch den grünen wald während es draußen regnet und schneit".split(),
    "fr": "le château près de la rivière était éclairé par les étoiles pendant toute cette belle nuit".split(),
}


def corpus(n=400, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(sorted(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(4, 30))), lang))
    return out


def test_held_out_accuracy(docs_of):
    data = corpus()
    got = {r.doc_id: r for r in op.identify(docs_of(data)).collect()}
    assert len(got) == len(data)
    for i, _, lang in data:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0.9 < got[i].score <= 1


def test_labels_of_held_out_rows_change_nothing(docs_of):
    data = corpus()
    spoilt = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in data]
    assert rows(op.identify(docs_of(data))) == rows(op.identify(docs_of(spoilt)))


def test_unreadable_texts(docs_of):
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 34 !!", "fr"), (None, "the house and river", "de"), (1003, "the house " * 200_000, None)]
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in op.identify(docs_of(corpus() + odd)).collect()}
    assert [got[i][0] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[None] == ("en", False) and got[1003][0] == "en"
    kept = op.keep_identified(docs_of(corpus() + odd + [(1004, "жжж щщщ ююю", "en")]))
    assert {1000, 1001, 1002}.isdisjoint(r.doc_id for r in kept.collect())
    assert kept.count() >= 402


def test_empty_table_and_no_labels(docs_of):
    assert op.identify(docs_of([])).collect() == []
    assert {r.lang_pred for r in op.identify(docs_of([(1, "words", None)])).collect()} == {"und"}


def test_trigrams_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = " ".join(WORDS["de"]) * 20
    whole = [g for p in op.trigrams(text) for g in p.tolist()]
    monkeypatch.setattr(op, "PIECE", 64)
    pieces = [g for p in op.trigrams(text) for g in p.tolist()]
    assert set(whole) <= set(pieces)
    assert len(pieces) - len(whole) < len(text) / 16


def test_false_positive_rates_are_corrected():
    grams = {lang: [g for p in op.trigrams(" ".join(w)) for g in p] for lang, w in WORDS.items()}
    import numpy as np

    model = op.LanguageFilter.build({k: np.unique(np.array(v, np.uint64)) for k, v in grams.items()})
    assert (model.rates < 1e-6).all()
    for lang, own in grams.items():
        assert model.hits(np.array(own, np.uint64))[model.langs.index(lang)] == len(own)
    model.rates[:] = 0.5
    assert model.judge("zzz qqq")[1] == 0
