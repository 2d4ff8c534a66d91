"""Vector codes: product quantization in whole numbers, with distances from limb-split matrix products.

Components become floor(1024 * x). A vector is cut into `PARTS` equal parts, and each part is named by the nearest of up
to `ENTRIES` codebook entries. Nearest means the smallest |c|² - 2 x·c, whose dot products come from BLAS: components are
split into limbs of so few bits that every sum of limb products stays below 2^53, where a double is exact; the limbs'
products are put together in 64-bit integers. All are whole numbers, so results don't depend on order or partitioning.

A round reads the written vectors once. A task adds up the components that fall to each entry (as many numbers as the
codebooks have, whatever the task reads), the sums are added by a group-by, and the driver holds the codebooks alone:
`ENTRIES` * width numbers. They travel to the tasks as a broadcast of that size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import prepare, stored, table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows of a matrix product.
ROWS = 4096


def limit(width: int) -> int:
    """The largest component that keeps squared distances of `width` components in 64 bits."""
    return isqrt((2**63 - 1) // max(width, 1)) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Signed limbs, the lowest first: values = sum of limb[i] * 2^(bits * i). All but the last are in [0, 2^bits)."""
    out = []
    while len(values) and (values.min() < -(1 << bits) or values.max() >= 1 << bits):
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*out, values.astype(np.float64)]


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left @ right.T of int64 matrices, exact if the results fit in 64 bits."""
    width = left.shape[1]
    # limbs are at most 2^bits in size, so width * 2^(2 * bits) < 2^53
    bits = (52 - max(width, 1).bit_length()) // 2
    total = np.zeros((len(left), len(right)), np.int64)
    rights = limbs(right, bits)
    for i, a in enumerate(limbs(left, bits)):
        for j, b in enumerate(rights):
            total += (a @ b.T).astype(np.int64) << np.int64(bits * (i + j))
    return total


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of every row; ties go to the lower index."""
    # |c|² - 2 x·c orders the entries as the distances do
    order = (book * book).sum(axis=1) - 2 * products(vectors, book)
    best = order.argmin(axis=1)
    apart = vectors - book[best]
    return best, (apart * apart).sum(axis=1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of longs as a matrix; shorter lists are filled up with zeros, components are held within limit()."""
    values = column.values.to_numpy(zero_copy_only=False) if len(column.values) else np.zeros(0, np.int64)
    offsets = column.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values[offsets[0] : offsets[-1]]
    most = limit(width // PARTS)
    return np.clip(out, -most, most, out=out)


def _parts(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """(rows, their parts) in pieces of ROWS rows."""
    for i in range(0, batch.num_rows, ROWS):
        rows = batch.slice(i, ROWS)
        yield slice(i, i + rows.num_rows), np.split(matrix(rows.column(column), width), PARTS, axis=1)


_SUMS = "part int, entry int, place int, total long, n long"


def _sums(books, width: int):
    """What the task's rows (components) add to each entry: a row for each part, entry and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        totals, counts = np.zeros_like(book), np.zeros(book.shape[:2], np.int64)
        for batch in batches:
            for _, parts in _parts(batch, 0, width):
                for p, x in enumerate(parts):
                    entry, _ = nearest(x, book[p])
                    order = np.argsort(entry, kind="stable")
                    met, begins = np.unique(entry[order], return_index=True)
                    totals[p, met] += np.add.reduceat(x[order], begins, axis=0)
                    counts[p] += np.bincount(entry, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        # a book of width 0 has nothing to move
        places = book.shape[2]
        columns = [
            pa.array(np.repeat(part, places).astype(np.int32)),
            pa.array(np.repeat(entry, places).astype(np.int32)),
            pa.array(np.tile(np.arange(places, dtype=np.int32), len(part))),
            pa.array(totals[part, entry].ravel()),
            pa.array(np.repeat(counts[part, entry], places)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "total", "n"])

    return run


def _encoded(books, width: int):
    """(vec_id, label, code, error) of (vec_id, label, components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = books.value
        hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, PARTS), np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, parts in _parts(batch, 2, width):
                for p, x in enumerate(parts):
                    codes[rows, p], apart = nearest(x, book[p])
                    errors[rows] += apart
            columns = [batch.column(0), batch.column(1), pa.array(["".join(c) for c in hexes[codes]], pa.string()), pa.array(errors)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return run


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, components) of the rows that take part, as a written table."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # a double beyond the longs is cut to the largest long by floor
    components = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    rows = embeddings.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", components.alias("components"))
    return stored(rows, "components")


def _first_books(rows: DataFrame, width: int) -> np.ndarray:
    """Codebooks (part, entry, place) from the ENTRIES smallest ids; nulls come last, equal ids go by their components."""
    first = rows.select("vec_id", "components").orderBy(F.asc_nulls_last("vec_id"), "components").limit(ENTRIES).collect()
    found = matrix(pa.array([r.components for r in first], pa.list_(pa.int64())), width)
    return np.stack(np.split(found, PARTS, axis=1))


def encode(embeddings: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks by part, entry and place) of all vectors without null and non-finite components.

    Vectors shorter than the longest, or than a multiple of `PARTS`, are filled up with zeros. Components beyond
    limit(width of a part), about 3 * 10^8 for 16, are held at that bound, so that distances fit in 64 bits. Null ids
    stay and count as the largest; rows that repeat an id are vectors of their own. Fewer than `ENTRIES` vectors give as
    many entries; without vectors there are no rows.
    """
    spark = prepare(embeddings.sparkSession)
    rows = whole_numbers(embeddings)
    longest = rows.agg(F.max(F.size("components"))).first()[0] or 0
    width = -(-max(longest, 1) // PARTS) * PARTS
    books = _first_books(rows, width)
    for _ in range(ROUNDS if books.size else 0):
        shared = spark.sparkContext.broadcast(books)
        sums = rows.select("components").mapInArrow(_sums(shared, width), _SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        found = sums.toArrow()  # at most ENTRIES * width rows
        part, entry, place, total, n = (c.to_numpy() for c in found.columns)
        books = books.copy()
        books[part, entry, place] = total // n
    coded = rows.mapInArrow(_encoded(spark.sparkContext.broadcast(books), width), rows.select("vec_id", "label").schema.add("code", "string").add("error", "long"))
    return coded, books


def compressed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256); see encode(). label_error is null where it is over a long."""
    coded, books = encode(embeddings)
    coded = stored(coded, "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)").alias("label_error"))
    # a written side leaves the join free to split a hot label
    by_label = stored(by_label, "label-errors").withColumnRenamed("label", "_label")
    rows = coded.join(by_label, coded["label"].eqNullSafe(F.col("_label")), "left")
    return rows.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark, sf_dir):
    return compressed(table(spark, sf_dir, "embeddings")).drop("label")


def _oracle() -> str:
    """The rounds one after the other; entries and vectors meet in blocks of one part."""
    part = "list_transform(list_slice(e, p * w + 1, p * w + w), lambda x: x::DOUBLE)"
    nearest_of = """
  SELECT id, p, any_value(x) AS x, min((list_inner_product(c, c) - 2 * list_inner_product(x, c))::HUGEINT * 256 + entry) AS best
  FROM x JOIN b{r} USING (p) GROUP BY id, p"""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"n{r} AS MATERIALIZED (SELECT id, p, x, ((best % 256 + 256) % 256)::INTEGER AS entry FROM ({nearest_of.format(r=r)}))")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (
  SELECT p, entry, list(s ORDER BY i) AS c FROM (
    SELECT p, entry, i, floor(sum(x[i]) / count(*)) AS s FROM n{r}, (SELECT unnest(range(1, (SELECT any_value(w) FROM v) + 1)) AS i) GROUP BY p, entry, i
  ) GROUP BY p, entry)""")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (p, entry))")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT id, p, {part} AS x FROM v, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, (id - 1)::INTEGER AS entry, x AS c FROM x WHERE id <= {ENTRIES}),
{", ".join(steps)},
f AS (
  SELECT id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code,
    sum(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT AS error
  FROM n{ROUNDS} JOIN b{ROUNDS} USING (p, entry) GROUP BY id
), h AS (
  SELECT sha256(string_agg(t, ',' ORDER BY p, entry)) AS digest FROM (SELECT p, entry, array_to_string(list_transform(c, lambda x: x::BIGINT), ',') AS t FROM b{ROUNDS})
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN f USING (id), h
"""


ORACLE_SQL = _oracle()
