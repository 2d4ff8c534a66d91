"""Exact top-k by inner product: the no-random-access algorithm over blocks of vectors.

Vectors are packed into blocks where they lie, one per batch. In a block every dimension is a sorted list. For a query
the lists are read in step, from the end that its component prefers. What has been read of a candidate gives a lower
bound (its unread components at their list's worst value) and an upper bound (at the list's current value). Reading
stops once no candidate that is still unseen can reach the k-th lower bound; candidates whose upper bound doesn't reach
it either are out, and what is left is scored in full. Each block gives its k best per query, and a rank per query over
the blocks decides.

Query blocks and candidate blocks meet on (query block, salt): a candidate block goes to each query block once, under a
salt of its own, and a query block to every salt, so no task gets more than a few blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import prepare, stored, table

SCALE = 1024
EVERY = 100
#: Vectors of a candidate block at most, and queries of a query block.
BLOCK = 8192
QUERIES = 2048
#: Reading starts with this part of the lists; each further step is twice as long.
FIRST = 8
#: Scores up to here are whole numbers in a double.
EXACT = float(1 << 52)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: ids, row numbers, and components as a matrix of longs, shorter vectors filled up with zeros."""
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            ids, rows, vectors = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).to_pylist()
            matrix = np.zeros((len(ids), max(1, *map(len, vectors))), np.int64)
            for row, v in zip(matrix, vectors):
                row[: len(v)] = v
            blobs = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, rows, matrix)]
            yield pa.RecordBatch.from_arrays([*blobs, pa.array([matrix.shape[1]], pa.int32())], names=["ids", "rows", "data", "width"])


class Lists:
    """The sorted lists of a block of candidates: one per dimension, and each candidate's place in it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.rows, self.vectors = ids, rows, vectors
        order = np.argsort(vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(vectors, order, axis=0).astype(np.float64)
        self.place = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)
        self.floats = vectors.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Numbers of the candidates that can be among the k best: all that reading can't exclude."""
        n = len(self.ids)
        q = query.astype(np.float64)
        if k >= n or np.abs(q).sum() * self.largest >= EXACT:
            return np.arange(n)
        down = q > 0  # read from the high end for a positive component, from the low end for others
        place = np.where(down, n - 1 - self.place, self.place)
        worst = q * np.where(down, self.values[0], self.values[-1])
        read, step = 0, max(k, n // FIRST)
        while True:
            read, step = min(n, read + step), step * 2
            front = q * np.where(down, self.values[n - read], self.values[read - 1])
            seen = place < read
            known = (seen * self.floats) @ q
            unread = 1.0 - seen
            lower, upper = known + unread @ worst, known + unread @ front
            level = np.partition(lower, n - k)[n - k]
            alive = np.flatnonzero(upper >= level)
            # front.sum() bounds whatever hasn't been seen in any list
            if read == n or (front.sum() < level and len(alive) <= max(4 * k, n // 8)):
                return alive

    def top(self, query: np.ndarray, row: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k best but for row number `row`: score down, then id up."""
        # one more, for the query's own row
        left = self.candidates(query, k + 1)
        left = left[self.rows[left] != row]
        scores = self.vectors[left] @ query
        if len(left) > k:  # what ties with the last place stays until ids decide
            least = np.partition(scores, len(left) - k)[len(left) - k]
            left, scores = left[scores >= least], scores[scores >= least]
        rank = np.lexsort((self.ids[left], -scores))[:k]
        return [(int(scores[i]), int(self.ids[left[i]])) for i in rank]


def _block(ids: bytes, rows: bytes, data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64), np.frombuffer(data, np.int64).reshape(-1, width)


def _meet(k: int):
    """Input: a candidate block and a query block, four columns each. Output: (query_id, query_row, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                (ids, rows, vectors), (query_ids, query_rows, queries) = _block(*row[:4]), _block(*row[4:])
                shared = min(vectors.shape[1], queries.shape[1])
                lists, out = Lists(ids, rows, vectors[:, :shared]), []
                for name, number, query in zip(query_ids.tolist(), query_rows.tolist(), queries[:, :shared]):
                    out += [(name, number, c, s) for s, c in lists.top(query, number, k)]
                names = ["query_id", "query_row", "vec_id", "score"]
                yield pa.record_batch([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], names=names)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, all if there are fewer, its own row left out.

    Both tables have vec_id, row (a number that tells the rows apart, the same in both) and components (array<long>).
    Ties go to the smaller vec_id. Vectors of different length meet on their common components. Scores are exact as long
    as they fit in a long. Rows that repeat an id are candidates and queries of their own.
    """
    spark = vectors.sparkSession
    schema = "ids binary, rows binary, data binary, width int"
    columns = ["vec_id", "row", "components"]
    blocks = -(-queries.count() // QUERIES) or 1
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = vectors.select(columns).mapInArrow(_pack, schema)
    left = left.withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(salts))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.select(columns).repartition(blocks).mapInArrow(_pack, schema)
    right = stored(right.withColumn("q", F.spark_partition_id()), "queries").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.select("q", F.col("salt").cast("long").alias("salt"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "rows", "data", "width")))
    # the planner doesn't see that each query block comes once per salt, and must not broadcast them
    met = left.join(right.hint("merge"), ["q", "salt"]).select("ids", "rows", "data", "width", "q_ids", "q_rows", "q_data", "q_width")
    found = met.mapInArrow(_meet(k), "query_id long, query_row long, vec_id long, score long")
    # one row per block at most k times: few rows of a query meet here
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, row, components): floor(1024 * x) of each component, as a written table.

    Rows whose vec_id is null, whose vector is null, or whose vector holds a null, NaN or infinite component take no part.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    components = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    return stored(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("row"), components.alias("components")), "vectors")


def op5_exact_topk(spark, sf_dir):
    prepare(spark)
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0), 10)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
