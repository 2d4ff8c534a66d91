"""Connected components by star contraction, as joins and minima."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored

#: Links that one task closes on its own, some 50 MB; more than these are closed in rounds.
CLOSED = 1 << 18


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while (up := parent[x]) != top:
            parent[x], x = top, up
        return top

    def join(self, a: int, b: int) -> bool:
        """True if the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: (member, smallest member). Memory is that of the partition."""
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(u, v)
    pairs = [(x, r) for x in forest.parent if (r := forest.root(x)) != x]
    for i in range(0, len(pairs), 65536):
        u, v = zip(*pairs[i : i + 65536])
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, root the smallest node reachable; roots themselves are included.

    links: two columns of non-null longs. Links are contracted where they are; if no more than `CLOSED` are left, one task
    contracts these, however many there were. Otherwise each round links every node to the smallest of its neighbourhood, first the
    larger neighbours, then the smaller ones, until nothing changes; a chain shortens by a constant factor each round.
    Minima are combined before the shuffle, and a hub's neighbours are never gathered. No link reaches the driver, only
    a row count and a checksum per round.
    """
    u, v = links.columns
    links = links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v")
    links = stored(links.mapInArrow(_contract, "u long, v long"), "links")
    if links.count() <= CLOSED:
        links = stored(links.coalesce(1).mapInArrow(_contract, "u long, v long"), "links")
        return _rooted(links)
    seen = None
    while (now := links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()) != seen:
        seen = now
        if not now[0]:
            break
        both = links.union(links.select("v", "u"))
        # minima are written: a join with a written side can be split where a hub has most of the links
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        links = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        links = stored(links, "links")
        least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = links.join(least, "u")
        links = near.select("v", "m").where("v <> m").union(near.select("u", "m")).toDF("u", "v").distinct()
        links = stored(links, "links")
    return _rooted(links)


def _rooted(links: DataFrame) -> DataFrame:
    """(node, root) from stars of (member, smallest member)."""
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
