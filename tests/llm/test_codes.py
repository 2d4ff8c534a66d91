import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from shelfspark.llm import codes as op

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part int, n int"


def plain(rows):
    """rows: (vec_id, vector, label) with ids; the contract in whole Python numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=1) // 4)
    kept = [(i, v + [0] * (4 * width - len(v)), g) for i, v, g in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [x[:256] for x in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(book))

    for _ in range(4):
        for p in range(4):
            own = [nearest(x, books[p])[1] for x in parts[p]]
            members = [[x for x, j in zip(parts[p], own) if j == k] for k in range(len(books[p]))]
            books[p] = [[sum(c) // len(m) for c in zip(*m)] if m else b for m, b in zip(members, books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[nearest(parts[p][i], books[p]) for p in range(4)] for i in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in found]
    of = {}
    for (_, _, g), e in zip(kept, errors):
        of[g] = of.get(g, 0) + e
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), e, of[g], digest) for (i, _, g), f, e in zip(kept, found, errors)), key=repr)


def run(spark, folder_of, rows):
    folder = folder_of(embeddings=spark.createDataFrame([(i, v, g, "x", 1, 2) for i, v, g in rows], SCHEMA))
    found = op.op12_vector_codes(spark, folder).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, found.collect()), key=repr)


def f32(v):
    return [float(np.float32(x)) for x in v]


def test_matches_brute_force(spark, folder_of):
    r = random.Random(3)
    rows = [(i, f32(r.gauss(0, 0.3) for _ in range(8)), r.choice([0, 0, 0, 1, 2, None])) for i in range(400)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(60)] + [(7, rows[9][1], 1), (None, rows[3][1], 2)]
    rows += [(2000, None, 0), (2001, [1.0, None] + [0.0] * 6, 0), (2002, [math.nan] * 8, 1), (2003, [math.inf] * 8, 1)]
    r.shuffle(rows)
    assert run(spark, folder_of, rows) == plain(rows)


def test_few_short_and_no_vectors(spark, folder_of):
    assert run(spark, folder_of, []) == []
    assert run(spark, folder_of, [(5, None, 1)]) == []
    rows = [(1, [0.5, -0.25, 3.0], 1), (2, [], None), (3, [1.0] * 6, None), (4, [1.0] * 6, 1)]
    assert run(spark, folder_of, rows) == plain(rows)


def test_ties_go_to_the_lower_entry():
    book = np.array([[0, 0], [2, 0], [0, 0], [4, 0]])
    best, apart = op.nearest(np.array([[1, 0], [0, 0], [3, 0]]), book)
    assert best.tolist() == [0, 0, 1] and apart.tolist() == [1, 0, 1]


def test_products_of_large_numbers_are_exact():
    r = random.Random(4)
    for width, bits in ((1, 30), (16, 28), (16, 12), (100, 27), (3, 2)):
        a, b = ([[r.randint(-(2**bits), 2**bits) for _ in range(width)] for _ in range(20)] for _ in range(2))
        assert op.products(np.array(a), np.array(b)).tolist() == [[sum(x * y for x, y in zip(u, v)) for v in b] for u in a]
    most = op.limit(16)
    ends = np.array([[most] * 16, [-most] * 16])
    assert op.nearest(ends, ends[:1])[1].tolist() == [0, 16 * (2 * most) ** 2]


def test_components_beyond_the_bound_are_held(spark, folder_of):
    found = run(spark, folder_of, [(0, [3e38, -3e38, 1.0, 2.0], 0), (1, [0.0, 0.0, 0.0, 0.0], 0)])
    assert [r[:2] for r in found] == [(0, "00000000"), (1, "01010101")] and all(r[2] == 0 for r in found)


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_equals_its_statement(spark, scale):
    folder = f"/root/testdata/{scale}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    found = op.op12_vector_codes(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({op.ORACLE_SQL})").fetchall())
