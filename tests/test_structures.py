"""Lookups and walks whose cost must follow the data: contained texts, deep trees."""

import random

from shelfspark.operators import hierarchy as H, joins as J


def test_contained_texts_equal_all_pairs(spark):
    r = random.Random(1)
    letters = "abcdeё"
    text = lambda low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    needles = {text(1, 6) for _ in range(150)} | {"a", "be"}
    hays = {text(1, 14) for _ in range(300)} | needles
    found = J.contained(spark.createDataFrame([(x,) for x in needles], "n string"), "n", spark.createDataFrame([(x,) for x in hays], "h string"), "h")
    assert sorted(map(tuple, found.collect())) == sorted((n, h) for n in needles for h in hays if n in h)
    empty = spark.createDataFrame([], "n string")
    assert J.contained(empty, "n", spark.createDataFrame([("x",)], "h string"), "h").isEmpty()
    assert J.contained(spark.createDataFrame([("x",)], "n string"), "n", empty.toDF("h"), "h").isEmpty()


def test_candidates_follow_terms_and_names(spark):
    """Names with words of their own in texts that share most of their letters."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    for n in (400, 1600):
        names = [f"books about {word()}" for _ in range(n)]
        terms = [f"{r.choice(names)} and more" for _ in range(n)]
        found = J.anchored(spark.createDataFrame([(x,) for x in names], "n string"), "n", spark.createDataFrame([(x,) for x in set(terms)], "h string"), "h")
        assert found.count() <= 4 * n


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = H.cut_lineage
    monkeypatch.setattr(H, "cut_lineage", lambda df: rounds.append(1) or plain(df))
    n = 1500
    nodes = spark.createDataFrame([(str(i), f"n{i}", str(i - 1)) for i in range(1, n + 1)] + [("x", "X", "y"), ("y", "Y", "x"), ("z", "Z", "x"), ("q", "Q", "q"), ("o", "O", "gone")], "id string, name string, parent_id string")
    closed = H.category_closure(nodes)
    deepest = closed.where("id = '1500'").select("depth", "ancestor_ids").first()
    assert closed.count() == n and len(rounds) < 20
    assert deepest.depth == n and deepest.ancestor_ids == [str(i) for i in range(1, n + 1)]


def test_walks_equal_a_plain_walk(spark):
    """Random trees with several parents, cycles and nodes that hang in the air."""
    r = random.Random(3)
    for _ in range(3):
        edges = [(str(i), f"n{i}", r.choice([H.ROOT, *map(str, range(30))])) for i in range(30)] + [(str(r.randrange(30)), "again", str(r.randrange(30))) for _ in range(6)]
        want, level = [], [(i, n, p, (n,), (i,)) for i, n, p in edges if p == H.ROOT]
        while level:
            want += level
            level = [(i, n, p, (*names, n), (*ids, i)) for i, n, p in edges for j, _, _, names, ids in level if p == j and i not in ids]
        closed = H.category_closure(spark.createDataFrame(edges, "id string, name string, parent_id string")).collect()
        assert sorted((x.id, x.name, x.parent_id, tuple(x.path), tuple(x.ancestor_ids)) for x in closed) == sorted(want)
        assert all(x.depth == len(x.path) for x in closed)
