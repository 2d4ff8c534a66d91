"""Side-by-side check of registered queries against their DuckDB statements."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads=4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """List of differences, empty when both engines agree."""
    df = fn(spark, folder)
    spark_schema = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    duck_schema = {d[0]: str(d[1]) for d in rel.description}
    want = _rows(columns, rel.fetchall())
    problems = []
    if spark_schema != duck_schema:
        problems.append(f"schema {spark_schema} != {duck_schema}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        bad_a = [a for a in got if a not in want][:2] if len(got) < 5000 else [a for a, b in zip(got, want) if a != b][:2]
        bad_b = [b for b in want if b not in got][:2] if len(want) < 5000 else [b for a, b in zip(got, want) if a != b][:2]
        problems.append(f"values spark={bad_a} duck={bad_b}")
    return problems, len(got)


def main(pattern: str = "", folder: str = "/root/testdata/sf0.001") -> int:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from shelfspark.session import local_session

    spark = local_session()
    con = connect(folder)
    oracle = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if pattern and not any(name.startswith(p) for p in pattern.split(",")):
            continue
        start = time.time()
        try:
            if name in oracle:
                problems, n = compare(spark, con, folder, fn, oracle[name])
            else:
                problems, n = [], len(fn(spark, folder).collect())
        except Exception as e:  # report and go on
            problems, n = [f"{type(e).__name__}: {str(e)[:700]}"], -1
        mark = "ok" if not problems else "BAD"
        if n == 0:
            mark += " EMPTY"
        print(f"{mark:4} {name} rows={n} {time.time() - start:.1f}s{'' if name in oracle else ' (rows only)'}", flush=True)
        for p in problems:
            failed += 1
            print("     ", p[:1500], flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
