"""Near copies among vectors: spherical k-means cells, cosine products by blocks, one vector of each group kept.

Two vectors are linked if their cosine is `COSINE` or more. Equal vectors are compared as one, with their number.

Centroids come from spherical k-means over a sample of about `SAMPLE` different vectors, those with the smallest hashes; of
centroids nearer to each other than `APART` one is left, so a dense group has one cell. Every vector lives in the cell of its
nearest centroid, and visits each other cell whose border is within half the link angle: of two linked vectors in
different cells one at least lies that near to the border between them, so every linked pair meets in the home cell of
one of the two. If both visit each other, the pair counts in the lower cell. No pair is lost, and none counts twice.

A cell is dealt into blocks of up to `BLOCK` vectors by their cosine to the centroid, so the members of a dense group share
blocks. Blocks know their centre and radius: two whose vectors must all be linked, or none, need no products. What is
left is one matrix product for each pair of blocks of a cell. No pair of vectors becomes a row: a product gives the number
of links of each vector and a star for each connected group in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import acos, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import prepare, stored, table
from shelfspark.llm.graph import components

COSINE = 0.95
SAMPLE = 16384
#: Vectors of a cell on average, and the most centroids; they are broadcast, CELLS * width doubles.
CELL = 4096
CELLS = 512
ROUNDS = 8
APART = 0.9
BLOCK = 2048
#: Vectors placed at a time.
ROWS = 1024
#: Room for rounding where a bound decides instead of a product.
SLACK = 1e-7
#: A page has 100 rows at least before its size is looked at, and is compressed and read in memory as a whole, outside the heap; a
#: block is a row of up to 0.5 MB or more, so sizes are looked at after each. Row groups are read as a whole as well.
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def filled(values: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of equal length and of the values' type; shorter vectors are filled up with zeros."""
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def units(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length, as doubles."""
    out = rows.astype(np.float64)
    # a power of two changes no digit, and keeps squares from overflowing
    _, exponent = np.frexp(np.abs(out).max(axis=1, initial=0))
    out = np.ldexp(out, -exponent[:, None])
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the first k rows; at least one centroid."""
    book = sample[:k]
    for _ in range(ROUNDS if len(sample) > k > 1 else 0):
        own = (sample @ book.T).argmax(axis=1)
        sums = np.zeros_like(book)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        book = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], book)
    kept: list[int] = []
    close = book @ book.T
    for i in range(len(book)):
        if not (close[i, kept] > APART).any():
            kept.append(i)
    return book[kept]


_PLACED = "cell int, visitor boolean, near double, node long, n long, home int, visits binary, {vector}"


def _placed(shared, width: int, reach: float):
    """Each vector (node, n, embedding) in its home cell and in those it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        apart = np.sqrt(np.maximum(2 - 2 * book @ book.T, 0))
        np.fill_diagonal(apart, 1)
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                near = units(filled(*_lists(batch.column(2)), width)) @ book.T
                home = near.argmax(axis=1)
                rows = np.arange(len(home))
                visits = (near[rows, home][:, None] - near) / apart[home] <= sin(reach / 2) + SLACK
                visits[rows, home] = False
                row, cell = np.nonzero(visits)
                row, cell = np.append(rows, row), np.append(home, cell)
                visitor = np.arange(len(row)) >= len(home)
                bits = [x.tobytes() for x in np.packbits(visits, axis=1)]
                taken = batch.take(pa.array(row))
                columns = [
                    pa.array(cell.astype(np.int32)), pa.array(visitor), pa.array(near[row, cell]), taken.column(0), taken.column(1),
                    pa.array(home[row].astype(np.int32)), pa.array(bits + [None] * (len(row) - len(bits)), pa.binary()), taken.column(2),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "visitor", "near", "node", "n", "home", "visits", "embedding"])

    return run


_BLOCKS = "cell int, visitor boolean, size int, weight long, first long, centre binary, radius double, nodes binary, weights binary, homes binary, visits binary, data binary"


def _packed(width: int):
    """Blocks of the rows of a partition, sorted by cell, visitor and nearness. data: the vectors as given, in their own type."""

    def block(cell: int, visitor: bool, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rows).combine_chunks()
        given = filled(*_lists(rows["embedding"].chunk(0)), width)
        unit = units(given)
        centre = unit.sum(axis=0)
        centre = centre / max(np.sqrt(centre @ centre), 1e-300)
        nodes, weights = rows["node"].to_numpy(), rows["n"].to_numpy()
        radius = acos(min(1.0, max(-1.0, float((unit @ centre).min()))))
        # a visitor's visits and a resident's home are not asked for
        bits = b"" if visitor else b"".join(rows["visits"].to_pylist())
        homes = rows["home"].to_numpy().tobytes() if visitor else b""
        values = [
            cell, visitor, len(nodes), int(weights.sum()), int(nodes[0]), centre.tobytes(), radius, nodes.tobytes(), weights.tobytes(),
            homes, bits, given.tobytes(),
        ]
        types = [pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, at = [], 0, None
        for batch in batches:
            cells, visitors = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((cells[1:] != cells[:-1]) | (visitors[1:] != visitors[:-1])) + 1
            for i, j in zip(np.append(0, edges), np.append(edges, len(cells))):
                while i < j:
                    key = (int(cells[i]), bool(visitors[i]))
                    if held and (key != at or count == BLOCK):
                        yield block(*at, held)
                        held, count = [], 0
                    at, size = key, min(j - i, BLOCK - count)
                    held.append(batch.slice(i, size))
                    count, i = count + size, i + size
        if held:
            yield block(*at, held)

    return run


_META = ["block", "weight", "first", "centre", "radius"]


def _decided(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
    """(left, right, visitor, all, weight, first, of_weight, of_first) of the pairs of blocks that can have links."""
    for batch in batches:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        if not batch.num_rows:
            continue
        a, b = (np.stack([np.frombuffer(x, np.float64) for x in column[c].to_pylist()]) for c in ("centre", "r_centre"))
        angle = np.arccos(np.clip((a * b).sum(axis=1), -1, 1))
        radii = column["radius"].to_numpy() + column["r_radius"].to_numpy()
        every = (angle + radii <= reach - SLACK) & ~column["visitor"].to_numpy(zero_copy_only=False)
        some = every | (angle - radii <= reach + SLACK)
        names = ["block", "r_block", "visitor", "weight", "first", "r_weight", "r_first"]
        out = pa.RecordBatch.from_arrays([*(column[n] for n in names), pa.array(every)], names=[*names, "every"])
        yield out.filter(pa.array(some))


_FOUND = "node long, other long, links long"


def _found(nodes: np.ndarray, others: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    own = (links > 0) | (others != nodes)
    return pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (nodes, others, links)], names=["node", "other", "links"])


def _grouped(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row and each column reaches by the links of a matrix."""
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, top = near[np.ix_(rows, columns)], np.iinfo(np.int64).max
    a, b = left[rows].copy(), right[columns].copy()
    while len(rows):
        before = a.sum(dtype=np.uint64) + b.sum(dtype=np.uint64)
        for i in range(0, len(rows), 256):
            part = near[i : i + 256]
            a[i : i + 256] = np.minimum(a[i : i + 256], np.where(part, b, top).min(axis=1))
            b = np.minimum(b, np.where(part, a[i : i + 256, None], top).min(axis=0))
        if before == a.sum(dtype=np.uint64) + b.sum(dtype=np.uint64):
            break
    left, right = left.copy(), right.copy()
    left[rows], right[columns] = a, b
    return left, right


def _products(batches: Iterator[pa.RecordBatch], cosine: float, width: int, kind: type) -> Iterator[pa.RecordBatch]:
    """Links between the vectors of two blocks of a cell; the right one may be of visitors."""
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            nodes, weights = (np.frombuffer(row[c], np.int64) for c in ("nodes", "weights"))
            r_nodes, r_weights = (np.frombuffer(row[c], np.int64) for c in ("r_nodes", "r_weights"))
            left, right = (units(np.frombuffer(row[c], kind).reshape(-1, width)) for c in ("data", "r_data"))
            near = left @ right.T >= cosine
            same = row["block"] == row["r_block"]
            if same:
                np.fill_diagonal(near, False)
            if row["visitor"]:
                homes = np.frombuffer(row["r_homes"], np.int32)
                visits = np.unpackbits(np.frombuffer(row["visits"], np.uint8).reshape(len(nodes), -1), axis=1)
                near &= (visits[:, homes] == 0) | (row["cell"] < homes)
            if not near.any():
                continue
            a, b = _grouped(near, nodes, r_nodes)
            yield _found(nodes, a, (near @ r_weights.astype(np.float64)).astype(np.int64))
            if not same:
                yield _found(r_nodes, b, (weights.astype(np.float64) @ near).astype(np.int64))


def _all_linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of blocks whose vectors are linked with all of other blocks: (nodes, weights, partner, links, own)."""
    for batch in batches:
        for nodes, weights, partner, links, own in zip(*(c.to_pylist() for c in batch.columns)):
            nodes, weights = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64)
            yield _found(nodes, np.full(len(nodes), partner), links - weights if own else np.full(len(nodes), links))


def _good(e: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def links(classes: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(node, other, links) of the different vectors (node, n, a, embedding), as a written table.

    A node's rows add up to the number of vectors that it is linked with, itself left out; (node, other) connect what is
    linked. a: a hash of the vector that the sample goes by.
    """
    spark = classes.sparkSession
    reach = acos(cosine)
    total, width = classes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not total:
        return spark.createDataFrame([], _FOUND)
    threshold = min(int(SAMPLE / total * 2**63), 2**63 - 1)
    sample = classes.where(F.shiftrightunsigned("a", 1) <= threshold).orderBy("a").select("embedding").toArrow()
    sample = units(filled(*_lists(sample["embedding"].combine_chunks()), width)) if len(sample) else np.eye(1, width)
    book = spark.sparkContext.broadcast(centroids(sample, min(CELLS, -(-total // cell))))
    vector = next(f for f in classes.schema.fields if f.name == "embedding")
    schema = _PLACED.format(vector=f"embedding {vector.dataType.simpleString()}")
    placed = classes.select("node", "n", "embedding").mapInArrow(_placed(book, width, reach), schema)
    order = ["cell", "visitor", "near", "node"]
    blocks = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed(width), _BLOCKS)
    blocks = stored(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks", WIDE)

    meta = blocks.select("cell", "visitor", *_META)
    right = meta.select("cell", F.col("visitor").alias("_visitor"), *(F.col(c).alias(f"r_{c}") for c in _META))
    met = meta.where("not visitor").drop("visitor").join(right, "cell").where("_visitor or block <= r_block").withColumnRenamed("_visitor", "visitor")
    decided = "block long, r_block long, visitor boolean, weight long, first long, r_weight long, r_first long, every boolean"
    met = stored(met.mapInArrow(partial(_decided, reach=reach), decided), "block-pairs")

    # what a block gets from blocks that it is linked with as a whole, itself among them
    every = met.where("every").select("block", "r_block", F.col("r_weight").alias("links"), F.col("r_first").alias("partner"))
    back = met.where("every and block <> r_block").select(F.col("r_block"), F.col("block"), F.col("weight"), F.col("first"))
    every = every.union(back).groupBy("block").agg(F.min("partner").alias("partner"), F.sum("links").alias("links"), F.max(F.col("block") == F.col("r_block")).alias("own"))
    every = stored(every, "linked-blocks")
    whole = blocks.select("block", "nodes", "weights").join(every, "block").select("nodes", "weights", "partner", "links", "own").mapInArrow(_all_linked, _FOUND)

    data = ["nodes", "weights", "homes", "data"]
    pairs = met.where("not every").select("block", "r_block", "visitor")
    one = blocks.select("block", "cell", "visits", "nodes", "weights", "data")
    two = blocks.select(F.col("block").alias("r_block"), *(F.col(c).alias(f"r_{c}") for c in data))
    # blocks are wide: where the pairs are few, these go to the blocks on the left, which stay where they are
    pairs = pairs.join(one, "block").join(two.hint("merge"), "r_block")
    kind = np.float32 if vector.dataType.elementType.simpleString() == "float" else np.float64
    compared = pairs.mapInArrow(partial(_products, cosine=cosine, width=width, kind=kind), _FOUND)
    return stored(whole.union(compared), "vector-links")


def near_copies(embeddings: DataFrame, cosine: float = COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of embeddings (vec_id, embedding).

    n_links counts the other rows whose cosine is `cosine` or more, rows that repeat a vector or an id included;
    component_id is the smallest vec_id reachable by links, kept says that it is the row's own. Vectors that are null or
    zero, or hold a null or non-finite component, link with nothing. Vectors of different length meet on their common
    components. Null ids count as links; a component of null ids alone has a null component_id and keeps nothing.
    """
    prepare(embeddings.sparkSession)
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    e = F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding"))
    good = _good(F.col("embedding"))
    # two hashes of 64 bits name a vector
    named = rows.where(good).withColumns({"a": F.xxhash64("embedding"), "b": F.xxhash64(F.lit(1), "embedding")})
    classes = named.groupBy("a", "b").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = links(classes.select("node", "n", "a", "embedding"), cosine, cell)
    roots = components(found.select("node", "other").where("node <> other"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = classes.select("node", "a", "b", "id", "n").join(counts, "node", "left").join(roots, "node", "left")
    each = stored(each.withColumn("root", F.coalesce("root", "node")), "classes")
    least = stored(each.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    # written sides leave the joins free to split a large component, and a vector that many rows share
    each = stored(each.join(least, "root").select("a", "b", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "answers")
    linked = named.select("vec_id", "a", "b").join(each, ["a", "b"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op13_near_vectors(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS size FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.size * b.size) >= {COSINE}
), r AS (
  SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u
), c AS (SELECT u, min(v) AS least FROM r GROUP BY u), n AS (SELECT u, count(*) AS n FROM p GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id,
  least(vec_id, coalesce(c.least, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN n ON n.u = vec_id
"""
