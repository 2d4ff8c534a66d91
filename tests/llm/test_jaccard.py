import random

import numpy as np
import pyarrow as pa

from shelfspark.llm import graph, jaccard


def batches(rows, names, kinds, size):
    return [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], names=names) for i in range(0, len(rows), size)]


def test_keys_of_several_uids_are_found_when_only_keys_are_sorted():
    r = random.Random(2)
    rows = sorted(((r.randrange(60), r.randrange(40)) for _ in range(300)), key=lambda x: x[0])
    want = {(k, u) for k, u in rows if len({v for j, v in rows if j == k}) > 1}
    for size in (1, 2, 7, 300):
        out = [p for b in jaccard._shared(iter(batches(rows, ["key", "uid"], [pa.int64()] * 2, size))) for p in zip(*(c.to_pylist() for c in b.columns))]
        assert set(out) == want


def test_pairs_are_compared_as_sets_are():
    r = random.Random(3)
    sets = []
    for _ in range(200):
        own = r.sample(range(2**32), 20)
        sets += [own, own[: r.randint(14, 20)] + r.sample(range(2**32), r.randint(0, 3))]
    rows = [(i // 2, False, i, sorted(s)) for i, s in enumerate(sets)]
    want = {i // 2 for i in range(0, 400, 2) if len(set(sets[i]) & set(sets[i + 1])) >= 0.8 * len(set(sets[i]) | set(sets[i + 1]))}
    assert 20 < len(want) < 180
    signed = [(*x[:3], np.array(x[3], np.uint32).view(np.int32).tolist()) for x in rows]
    for size in (1, 5, 400):
        found = jaccard._links(iter(batches(signed, ["key", "member", "uid", "shingles"], [pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int32())], size)))
        links = [p for b in found for p in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(links) == [(2 * k + 1, 2 * k) for k in sorted(want)]


def test_words_of_any_length_have_their_own_hash():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "x" * 100, "x" * 101, "é", "日本語テキスト", "a\0", "\0"]
    found = jaccard.hash_words(words)
    assert len(set(found.tolist())) == len(words)
    assert [jaccard.hash_words([w])[0] for w in words] == found.tolist()


def test_few_links_are_closed_without_rounds(spark, monkeypatch):
    """A chain in many partitions took a dozen written tables; in rounds it gives the same."""
    written = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: written.append(label) or stored(df, label))
    links = spark.range(300).selectExpr("id + 1 as u", "id as v").repartition(6)
    assert {tuple(x) for x in graph.components(links).collect()} == {(i, 0) for i in range(301)}
    assert len(written) == 2
    monkeypatch.setattr(graph, "CLOSED", 0)
    assert {tuple(x) for x in graph.components(links).collect()} == {(i, 0) for i in range(301)}
    assert len(written) > 6
