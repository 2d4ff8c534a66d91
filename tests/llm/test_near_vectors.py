import math

from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shelfspark.llm import near_vectors as op

SCHEMA = "vec_id long, embedding array<{kind}>, label int, node long, n long, cell string"


def plain(rows, cosine=0.95):
    """rows: (vec_id, vector); all pairs."""
    width = max((len(v) for _, v in rows if v), default=1)
    good = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    at = np.flatnonzero(good)
    m = np.array([[float(x) for x in rows[i][1]] + [0.0] * (width - len(rows[i][1])) for i in at]).reshape(-1, width)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(at))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(at)).min(axis=1, initial=len(at)))
        if (new == label).all():
            break
        label = new
    out = [(i, 0, i, i is not None) for (i, _), g in zip(rows, good) if not g]
    least = {}
    for k, i in zip(label, at):
        if rows[i][0] is not None:
            least[k] = min(least.get(k, rows[i][0]), rows[i][0])
    for j, i in enumerate(at):
        c = least.get(label[j])
        out.append((rows[i][0], int(near[j].sum()), c, rows[i][0] is not None and rows[i][0] == c))
    return sorted(out, key=repr)


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 0, 1, 2, "x") for i, v in rows], SCHEMA.format(kind=kind))
    return sorted(map(tuple, op.near_copies(df, **kw).collect()), key=repr)


def f32(m):
    return [[float(np.float32(x)) for x in v] for v in m]


def noisy(r, base, count, cosine):
    """Vectors at about the given cosine to the base."""
    base = base / np.linalg.norm(base)
    noise = r.normal(size=(count, len(base)))
    noise -= (noise @ base)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = np.asarray(cosine).reshape(-1, 1) * np.ones((count, 1))
    return c * base + np.sqrt(1 - c * c) * noise


def test_matches_all_pairs_over_many_cells(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = r.normal(size=(500, 12))
    near = [noisy(r, b, 4, r.uniform(0.93, 0.999, 4)) * r.uniform(0.1, 9) for b in base[:150]]
    m = f32(np.concatenate([base, *near]))
    rows = [(i * 3 % 2003, v) for i, v in enumerate(m)]
    rows += [(5000 + i, m[7]) for i in range(40)] + [(21, m[30]), (None, m[7]), (None, f32([r.normal(size=12)])[0])]
    rows += [(6000, None), (6001, [0.0] * 12), (6002, [1.0, None] + [0.0] * 10), (6003, [math.nan] * 12), (6004, [math.inf] + [1.0] * 11), (6005, []), (6006, m[3][:5])]
    want = plain(rows)
    assert run(spark, rows) == want
    monkeypatch.setattr(op, "BLOCK", 37)
    assert run(spark, rows, cell=40) == want
    assert run(spark, rows, cell=20) == want


def test_a_dense_group_of_different_vectors(spark, monkeypatch):
    r = np.random.default_rng(2)
    tight, loose = r.normal(size=16), r.normal(size=16)
    m = f32(np.concatenate([noisy(r, tight, 400, 0.998), noisy(r, loose, 300, 0.97), r.normal(size=(300, 16))]))
    rows = list(enumerate(m))
    monkeypatch.setattr(op, "BLOCK", 64)
    want = plain(rows)
    assert max(n for _, n, _, _ in want) >= 399
    assert run(spark, rows, cell=100) == want


@pytest.mark.parametrize("kind", ["float32", "float64"])
def test_blocks_hold_vectors_in_their_own_type(kind):
    vectors, n = [[1.0, 2.0, 3.0], [0.5], [4.0, 0.25, 1.0]], 3
    values = [
        pa.array([0, 0, 0], pa.int32()), pa.array([False, False, True]), pa.array([0.1, 0.2, 0.3]), pa.array([5, 6, 7]), pa.array([1, 1, 2]),
        pa.array([0, 0, 1], pa.int32()), pa.array([b"\0", b"\0", None]), pa.array(vectors, pa.list_(pa.type_for_alias(kind))),
    ]
    placed = pa.RecordBatch.from_arrays(values, names=["cell", "visitor", "near", "node", "n", "home", "visits", "embedding"])
    blocks = [b.to_pylist()[0] for b in op._packed(n)(iter([placed]))]
    assert [b["size"] for b in blocks] == [2, 1] and [b["visitor"] for b in blocks] == [False, True]
    assert b"".join(b["data"] for b in blocks) == np.array([[1, 2, 3], [0.5, 0, 0], [4, 0.25, 1]], kind).tobytes()
    assert [np.frombuffer(b["homes"], np.int32).tolist() for b in blocks] == [[], [1]]


def test_doubles_of_many_lengths_over_many_cells(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 9))
    m = np.concatenate([base, *(noisy(r, b, 4, r.uniform(0.93, 0.999, 4)) for b in base[:60])])
    rows = [(i, v[: 9 - i % 3].tolist()) for i, v in enumerate(m)]
    want = plain(rows)
    assert any(links for _, links, _, _ in want)
    monkeypatch.setattr(op, "BLOCK", 23)
    assert run(spark, rows, "double", cell=30) == want


def test_wide_blocks_are_written_in_small_row_groups(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = list(enumerate(r.normal(size=(320, 1024)).tolist()))
    folders, stored = [], op.stored

    def seen(df, label, *options):
        out = stored(df, label, *options)
        folders.extend(f for f in out.inputFiles() if label == "blocks")
        return out

    monkeypatch.setattr(op, "BLOCK", 32)
    monkeypatch.setattr(op, "stored", seen)
    monkeypatch.setitem(op.WIDE, "parquet.block.size", str(1 << 20))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run(spark, rows, "double") == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    meta = [pq.ParquetFile(Path(f.removeprefix("file:"))).metadata for f in folders]
    sizes = [m.row_group(i).total_byte_size for m in meta for i in range(m.num_row_groups)]
    # ten blocks of 0.26 MB: fewer than 100 rows, whose sizes are looked at nevertheless
    assert sum(sizes) > 2.6e6 and len(sizes) >= 2 and max(sizes) < 1.6e6


def test_small_tables_and_types(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [0.0]), (4, None)]) == [(3, 0, 3, True), (4, 0, 4, True)]
    assert run(spark, [(1, [2.0])]) == [(1, 0, 1, True)]
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1.1e-200]), (3, [1.0, -1.0]), (4, [-1e200, 1e200])]
    assert run(spark, rows, "double") == plain(rows)


def test_copies_alone(spark):
    rows = [(9 - i, [0.5, 0.25]) for i in range(5)]
    assert run(spark, rows) == plain(rows) and plain(rows)[0] == (5, 4, 5, True)


def test_equals_its_statement(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    found = op.op13_near_vectors(spark, folder)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({op.ORACLE_SQL})").fetchall())
