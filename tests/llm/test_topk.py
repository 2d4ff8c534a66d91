import math
import random

import numpy as np

from shelfspark.llm import topk as op

SCHEMA = "vec_id long, embedding array<float>, label int, row int, q int"


def plain(rows, k=10):
    """rows: (vec_id, vector), each candidate for every other row."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(good):
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(u, v)), c) for b, (c, v) in enumerate(good) if a != b)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, folder_of, rows):
    folder = folder_of(embeddings=spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA))
    return sorted(map(tuple, op.op5_exact_topk(spark, folder).select("query_id", "rank", "vec_id", "score").collect()))


def f32(v):
    return [float(np.float32(x)) if x is not None else None for x in v]


def test_matches_brute_force(spark, folder_of):
    r = random.Random(2)
    rows = [(i, f32(r.gauss(0, 0.3) for _ in range(8))) for i in range(900)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, rows[3][1]), (200, rows[3][1])]  # copies and a repeated id
    rows += [(3000, None), (3001, f32([1, None] + [0] * 6)), (3002, [math.nan] * 8), (3003, [math.inf] * 8), (None, [9.0] * 8), (3100, []), (3200, [2.0, 1.0])]
    assert run(spark, folder_of, rows) == plain(rows)


def test_few_candidates_and_none(spark, folder_of):
    assert run(spark, folder_of, []) == []
    assert run(spark, folder_of, [(0, [1.0])]) == []
    assert run(spark, folder_of, [(0, [1.0]), (7, [0.5]), (9, [-2.0])]) == [(0, 1, 7, 1024 * 512), (0, 2, 9, -2048 * 1024)]


def test_reading_stops_early_and_keeps_the_best():
    r = np.random.default_rng(5)
    centre = r.integers(-500, 500, 16)
    vectors = r.integers(-300, 300, (4000, 16))
    vectors[:20] = centre + r.integers(-20, 20, (20, 16))
    lists = op.Lists(np.arange(4000), np.arange(4000), vectors)
    left = lists.candidates(centre, 11)
    assert len(left) <= 500 and set(np.argsort(-(vectors @ centre), kind="stable")[:11]) <= set(left)


def test_large_components_are_scored_in_full():
    vectors = np.array([[2**30, 3], [2**30, 2], [1, 1]])
    lists = op.Lists(np.arange(3), np.arange(3), vectors)
    assert lists.top(np.array([2**30, 5]), -1, 2) == [(2**60 + 15, 0), (2**60 + 10, 1)]


def test_several_query_blocks(spark, folder_of, monkeypatch):
    monkeypatch.setattr(op, "QUERIES", 2)
    monkeypatch.setattr(op, "BLOCK", 7)
    r = random.Random(3)
    rows = [(i * 50, f32(r.gauss(0, 1) for _ in range(4))) for i in range(60)]
    assert run(spark, folder_of, rows) == plain(rows)
