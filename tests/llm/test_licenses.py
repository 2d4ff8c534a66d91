import pytest
from pyspark.sql import functions as F

from shelfspark.llm import licenses as op


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, op.LicenceModel.fit(docs)


def test_lines_of_the_corpus_are_found_and_nothing_else(corpus):
    docs, model = corpus
    got = op.scan(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    marks = {"MIT": "MIT License", "Apache": "Apache License", "CC-BY-NC": "CC BY-NC", "GPL": "GNU General Public"}
    wrong = [r.doc_id for r in got if sorted(r.licences.split(",")) != sorted([k for k, v in marks.items() if v in r.text] or [""])]
    assert len(wrong) <= 0.01 * len(got), wrong
    assert sum(bool(r.licences) for r in got) >= 10


CASES = {
    "MIT": "this project is released under the terms of the MIT License by its authors",
    "Apache": "Licensed under the Apache License, Version 2.0 (the License)",
    "GPL": "This work is licensed under the GNU General Public License, version 3",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "": "the weather was fine and we went on to the river where nothing of note took place",
}


def wrapped(text, columns):
    lines = [""]
    for word in text.split():
        if len(lines[-1]) + len(word) + 1 > columns and lines[-1]:
            lines.append("")
        lines[-1] += " " * bool(lines[-1]) + word
    return lines


def test_wrapped_notices_of_all_families(corpus, docs_of):
    _, model = corpus
    noise = "the road went on past the houses and down to the water where boats lay in rows under a low grey sky"
    rows, want = [], {}
    for family, templates in op.TEMPLATES.items():
        for t in templates:
            for columns in (60, 80):
                for mark in ("", "# ", " * "):
                    lines = [mark + x for x in wrapped(t, columns)]
                    want[len(rows)] = family
                    rows.append((len(rows), "\n".join([noise, "", *lines, "", noise])))
    got = {r.doc_id: r.licences for r in op.scan(docs_of(rows), model).collect()}
    wrong = {rows[i][1][len(noise) :][:90]: (got[i], f) for i, f in want.items() if got[i] != f}
    assert not wrong, wrong


def test_lines_with_two_licences_give_both(corpus, docs_of):
    _, model = corpus
    pairs = [
        ("Licensed under the MIT license. Licensed under the Apache License, Version 2.0.", "Apache,MIT"),
        ("Released under the MIT License. Released under the BSD License.", "BSD,MIT"),
        ("Licensed under CC BY 4.0. Licensed under the Mozilla Public License, version 2.0.", "CC-BY,MPL"),
        ("Licensed under CC BY-SA 4.0. Licensed under CC BY-NC 4.0.", "CC-BY-NC,CC-BY-SA"),
        ("Released under the GNU General Public License v2. Licensed under the GNU Lesser General Public License, version 2.1.", "GPL,LGPL"),
    ]
    got = {r.doc_id: r.licences for r in op.scan(docs_of([(i, t) for i, (t, _) in enumerate(pairs)]), model).collect()}
    assert got == {i: w for i, (_, w) in enumerate(pairs)}


def test_variants_edge_cases_and_long_texts(corpus, docs_of):
    _, model = corpus
    noise = "one two three four five six seven eight nine ten " * 2000
    rows = list(enumerate(CASES.values())) + [(10, None), (11, ""), (12, "\n\n"), (13, noise + CASES["GPL"] + " " + noise), (None, CASES["MIT"]), (0, CASES["MIT"])]
    got = sorted(((r.doc_id, r.licences, r.windows, r.found >= r.confirmed) for r in op.scan(docs_of(rows), model).collect()), key=repr)
    want = {**dict(enumerate(CASES)), 10: "", 11: "", 12: "", 13: "GPL", None: "MIT"}
    assert len(got) == len(rows)
    for doc, licences, windows, ordered in got:
        assert licences == want[doc] and ordered
        assert (windows == 0) == (doc in (10, 11, 12))


def test_windows_hold_every_notice_whole(docs_of):
    text = " ".join(f"w{i}" for i in range(1000))
    got = [r.words for r in op.windows(docs_of([(1, text)]), ["doc_id"]).collect()]
    assert all(len(w) <= op.WINDOW for w in got)
    words = text.split()
    for i in range(len(words) - op.OVERLAP + 1):
        run = words[i : i + op.OVERLAP]
        assert any(run == w[k : k + op.OVERLAP] for w in got for k in range(len(w) - op.OVERLAP + 1) if w[k] == run[0])


def test_empty_table_and_native_plan(corpus, docs_of):
    _, model = corpus
    assert op.scan(docs_of([]), model).collect() == []
    plan = op.scan(docs_of([(1, "x")]), model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_a_corpus_without_texts_can_be_scanned(docs_of):
    docs = docs_of([(1, None), (2, "")])
    assert [r.licences for r in op.scan(docs, op.LicenceModel.fit(docs)).collect()] == ["", ""]
    assert op.training_rows(docs).where(F.col("label") < 12).count() > 100
