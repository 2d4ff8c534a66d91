"""Near-duplicate documents: SimHash fingerprints, linked through BK-trees.

Fingerprints within `radius` differing bits are linked. Two such fingerprints agree on two at least of four 16-bit
blocks, so the six pairs of blocks deal them into shards that hold both; inside a shard a BK-tree (children keyed by
their Hamming distance to the parent) finds the partners by following only edges within the radius.

A broadcast of all shard trees would grow with the corpus and pass through the driver. The shuffle brings each tree to
the task that searches it instead; the search itself is the same. A shard that grows over `SHARD` fingerprints is dealt
again by the bits its members do not share, twice at most: then only 8 bits are free, so a tree has 256 nodes at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfspark.llm.common import prepare, stored, table
from shelfspark.llm.graph import Forest, components

SEED = 42
RADIUS = 2
SHARD = 512
FULL = (1 << 64) - 1


def simhash(text: str | None, size: int = 3) -> int:
    """64-bit SimHash over `size`-word shingles of the lower-cased text, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = len(words) - size + 1
    view = memoryview(joined)
    bits = np.zeros(64, np.int64)
    for i in range(0, count, 1 << 17):  # a bounded piece of the hashes at a time
        j = min(count, i + (1 << 17))
        pairs = zip(starts[i:j].tolist(), ends[i + size - 1 : j + size - 1].tolist())
        hashes = np.fromiter((digest(view[a:b], SEED) for a, b in pairs), np.uint64, j - i)
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(k) for k in np.flatnonzero(2 * bits > count))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the fingerprint of the last column, a text, as a signed long."""
    for batch in batches:
        found = np.fromiter((simhash(t) for t in batch.column(batch.num_columns - 1).to_pylist()), np.uint64, batch.num_rows)
        names = [*batch.schema.names[:-1], "fp"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=names)


def fingerprints(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep` and the fingerprint `fp` of every row; a null text counts as empty."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    return kept.mapInArrow(_fingerprints, StructType([*kept.schema.fields[:-1], StructField("fp", LongType())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _narrower(mask: int) -> list[int]:
    """The masks that add two of four equal blocks of the bits outside `mask`."""
    free = [b for b in range(64) if not mask >> b & 1]
    step = len(free) // 4
    blocks = [sum(1 << b for b in free[i * step : (i + 1) * step]) for i in range(4)]
    return [mask | a | b for a, b in combinations(blocks, 2)]


class BKTree:
    """Children keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = len(self.values)
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.values[at])
            children = self.children[at]
            open_ += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        return found


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect all of `values` that are connected within the radius: a spanning forest of them."""
    tree, forest, out = BKTree(), Forest(), []
    for x in values:
        out += [(x, y) for y in tree.within(x & FULL, radius) if forest.join(x & FULL, y)]
        tree.add(x & FULL)
    return out


def _shard_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, members = None, []

        def done() -> list[tuple[int, int]]:
            return [(_signed(a & FULL), _signed(b)) for a, b in tree_links(members, radius)] if len(members) > 1 else []

        for batch in batches:
            out = []
            for mask, bits, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (mask, bits) != shard:
                    out += done()
                    shard, members = (mask, bits), []
                members.append(fp)
            yield _pairs(out)
        yield _pairs(done())

    return run


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["u", "v"])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between the distinct fingerprints `fp`, enough to connect all that are within `radius` bits.

    radius is 2 at most: four blocks and two agreeing ones prove the shards complete up to there.
    """
    if radius > 2:
        raise ValueError("the shards are complete up to two differing bits")
    masks, rest, cold = [0], fps.select("fp", F.lit(0).cast("long").alias("mask")), []
    for level in range(3):
        narrower = {m: _narrower(m) for m in masks}
        masks = [x for xs in narrower.values() for x in xs]
        deal = F.create_map(*(x for m, xs in narrower.items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(x)) for x in xs)))))
        rows = rest.select("fp", F.explode(F.element_at(deal, F.col("mask"))).alias("mask"))
        rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
        # a written side leaves the join free to split a large shard
        rows = rows.join(stored(sizes, "shard-sizes"), ["mask", "bits"])
        if level == 2:
            cold.append(rows.select("mask", "bits", "fp"))
        else:
            rows = stored(rows, "shards")
            cold.append(rows.where(F.col("n") <= SHARD).select("mask", "bits", "fp"))
            rest = rows.where(F.col("n") > SHARD).select("fp", "mask")
            if rest.isEmpty():
                break
    dealt = reduce(DataFrame.union, cold).repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp")
    return dealt.mapInArrow(_shard_links(radius), "u long, v long")


def fingerprint_classes(rows: DataFrame, least: Column, radius: int = RADIUS) -> DataFrame:
    """(fp, least): for each fingerprint of `rows` the minimum of `least` over all rows whose fingerprints it reaches."""
    fps = stored(rows.groupBy("fp").agg(F.min(least).alias("least")), "fingerprints")
    classes = components(fingerprint_links(fps, radius)).withColumnRenamed("node", "fp")
    rooted = fps.join(classes, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("lowest"))
    return rooted.join(lowest, "root").select("fp", F.col("lowest").alias("least"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of documents.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay and share a component. A
    component without any doc_id has a null id. Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = stored(fingerprints(docs, [F.col("doc_id").cast("long").alias("doc_id")]), "simhash")
    classes = fingerprint_classes(rows, F.col("doc_id"), radius)
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents with one of each component left: the smallest doc_id, nulls last, then the first row.

    All columns of `docs` are kept, also those named like the ones used here.
    """
    prepare(docs.sparkSession)
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.monotonically_increasing_id().alias("rid"),
        F.col("text").alias("_text"),
    )
    schema = StructType([*whole.schema.fields[:-1], StructField("fp", LongType())])
    rows = stored(whole.mapInArrow(_fingerprints, schema), "simhash")
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
    winners = fingerprint_classes(rows.select("fp", "id", "rid"), rank, radius).select(F.col("least.rid").alias("rid")).distinct()
    return rows.join(winners, "rid", "left_semi").select("row.*")


def op2_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
