import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import mixing as op


def plain_targets(sizes):
    """sizes: {source: words}; the excess of stopped sources is shared again until none is above."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: 3 * sizes[s] for s in above}


def corpus():
    r = random.Random(8)
    docs = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 30, 300]))), None, "abcdefg"[min(6, int(r.expovariate(0.6)))]) for i in range(200)]
    docs += [(500, "x y z", None, None), (501, None, None, "a"), (None, "one\ttwo\x0bthree", None, "b"), (7, "again", None, "a"), (7, "again", None, "a")]
    return docs + [(502, "long " * 30_000, None, "zz"), (503, "tiny", None, "Ω"), (504, "", None, "empty")]


def test_contract(docs_of):
    data = corpus()
    got = [r.asDict() for r in op.mix(docs_of(data)).collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(d[0]), size(d[1])) for d in data)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d in data:
        sizes[d[3]] += size(d[1])
    want = plain_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_whatever_the_partitions(docs_of, spark):
    docs = docs_of(corpus())
    first = sorted(map(tuple, op.mix(docs.repartition(3)).collect()), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, op.mix(docs.repartition(5, "source")).collect()), key=repr) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_slots_cover_blocks_as_often_as_planned(docs_of, monkeypatch):
    monkeypatch.setattr(op, "SLOTS", 64)  # many shards
    docs = docs_of(corpus())
    rows, sources = op.packed(docs, [])
    plan = {r.src: r for r in op.slot_plan(sources).collect()}
    words, uses = defaultdict(int), defaultdict(list)
    shards = defaultdict(int)
    for s in op.slots(op.slot_plan(sources)).collect():
        words[s.src] += s.words
        uses[s.src, getattr(s, "pass")].append(s.block)
        shards[s.shard] += 1
    for src, p in plan.items():
        assert words[src] == int(p.target + 0.5)
        for k in range(p.passes):
            assert sorted(uses[src, k]) == list(range(p.blocks))
        last = uses.get((src, p.passes), [])
        assert len(last) == len(set(last)) and all(0 <= b < p.blocks for b in last)
    total = sum(p.slots for p in plan.values())
    assert shards == {h: min(64, total - 64 * h) for h in range(-(-total // 64))}


def test_the_text_of_the_mix(docs_of, monkeypatch):
    monkeypatch.setattr(op, "SLOTS", 64)
    # every word names its document and its place in it
    data = [(i, " \n".join(f"{i}.{k}" for k in range(n)), None, s) for i, (n, s) in enumerate([(700, "a"), (3, "a"), (0, "a"), (1, "b"), (128, "b"), (260, "c"), (5, None), (40, "b")])]
    data += [(90, None, None, "a"), (7, data[7][1], None, "b")]
    docs = docs_of(data)
    got = op.mix_text(docs).collect()
    plan = {(s.shard, s.src, getattr(s, "pass"), s.place): s.words for s in op.slots(op.slot_plan(op.packed(docs, [])[1])).collect()}
    assert {(r.shard, r.src, getattr(r, "pass"), r.place): r.words for r in got} == plan
    counts = defaultdict(int)
    for r in got:
        words = r.text.split(" ")
        assert len(words) == r.words
        for a, b in zip(words, words[1:]):
            (i, k), (j, m) = (map(int, x.split(".")) for x in (a, b))
            assert (i, k + 1) == (j, m) or m == 0  # the next word, or the next document's first one
        for w in words:
            counts[int(w.split(".")[0])] += 1
    taken = defaultdict(int)
    for r in op.mix(docs).collect():
        taken[r.doc_id] += r.taken
    assert counts == {i: n for i, n in taken.items() if n}
    assert op.mix_text(docs_of([])).collect() == []


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 17, 256):
        got = spark.range(n).select(op.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3), F.lit(0)).alias("x")).collect()
        assert sorted(r.x for r in got) == list(range(n))


def test_empty_tables(docs_of):
    assert op.mix(docs_of([])).collect() == []
    got = op.mix(docs_of([(1, None), (2, "", None, "a")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
