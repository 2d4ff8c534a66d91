"""Near copies of whole documents: SimHash fingerprints in BK-trees and MinHash bands, exact Jaccard, components.

Two documents are linked if their sets of five-word shingles (lower-cased words; a text of fewer words is one shingle) have
a Jaccard similarity of 0.8 or more. Candidates come in two ways. Documents whose fingerprints reach each other by steps of
two bits or fewer, found by BK-trees as in `simhash_dedup`, are one bucket. Most pairs at 0.8 are further apart in bits, so
bands follow, tuned so that a pair at 0.8 collides with probability `RECALL` or more. Every pair of a bucket is compared
exactly, unless other links connect it already (see `jaccard`). Equal texts are compared as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from shelfspark.llm.common import prepare, stored
from shelfspark.llm.graph import components
from shelfspark.llm.jaccard import SHINGLE, SIMILARITY, band_keys, colliding, identities, joined, linked, shingle_hashes, tuned
from shelfspark.llm.simhash_dedup import fingerprint_links, simhash

RECALL = 0.999
BANDS, ROWS = tuned(SIMILARITY, RECALL, 4)


def shingles(text: str | None) -> tuple[int, np.ndarray]:
    """(identity, sorted distinct shingle hashes); texts without words have identity 0 and the shingle 0."""
    words = (text or "").lower().split()
    if not words:
        return 0, np.zeros(1, np.uint32)
    if len(words) < SHINGLE:
        identity = xxhash.xxh64_intdigest(" ".join(words))
        return identity, np.array([identity >> 32], np.uint32)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return int(identities(hashes, np.array([0]), np.array([len(words)]))[0]), np.unique(shingle_hashes(hashes))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, a text, by its identity `uid`, its fingerprint `fp` and its band keys `keys`."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        fps = np.fromiter(map(simhash, texts), np.uint64, len(texts)).view(np.int64)
        found = [shingles(t) for t in texts]
        values, ends = joined([s for _, s in found])
        keys = band_keys(values, ends[:-1], BANDS, ROWS).ravel() if found else np.zeros(0, np.uint64)
        uids = np.array([u for u, _ in found], np.uint64).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(uids), pa.array(fps), lists], names=[*batch.schema.names[:-1], "uid", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, shingles) from (uid, text)."""
    for batch in batches:
        values, ends = joined([shingles(t)[1] for t in batch.column(1).to_pylist()])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["uid", "shingles"])


def close_fingerprints(rows: DataFrame) -> DataFrame:
    """(key, uid) of (uid, fp): a key stands for all fingerprints that reach each other by links of the BK-trees.

    Texts of one identity can differ in case or blanks and so in fingerprint; such a uid has the keys of all of them.
    """
    both = stored(rows.select("uid", "fp").distinct(), "fingerprints")
    classes = components(fingerprint_links(stored(both.select("fp").distinct(), "distinct-fingerprints")))
    reached = both.join(classes.withColumnRenamed("node", "fp"), "fp", "left")
    return reached.select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "uid")


def shared_bands(rows: DataFrame, once: DataFrame) -> DataFrame:
    """(key, uid) of (rid, uid, keys), the bands of one row of each uid; once: the rows' rid."""
    return rows.select("rid", "uid", "keys").join(once.select("rid"), "rid", "left_semi").select(F.explode("keys").alias("key"), "uid")


def copy_links(rows: DataFrame) -> DataFrame:
    """(u, v): links between the identities of (rid, uid, fp, keys, text), enough to connect all that collide and are similar."""
    once = stored(rows.groupBy("uid").agg(F.min("rid").alias("rid")), "once")
    found = colliding(close_fingerprints(rows)).unionByName(colliding(shared_bands(rows, once)))
    needed = once.join(found.select("uid").distinct(), "uid", "left_semi").select("rid")
    sets = stored(rows.select("rid", "uid", "text").join(needed, "rid", "left_semi").select("uid", "text").mapInArrow(_sets, "uid long, shingles array<int>"), "sets")
    return linked(found, sets)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near copies left: the smallest doc_id, nulls last, then the first row.

    Groups are the components of the links. Null texts and texts without words are one group. All columns of `docs` are
    kept, also those named like the ones used here.
    """
    prepare(docs.sparkSession)
    whole = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("id"),
        F.monotonically_increasing_id().alias("rid"),
        F.col("text").alias("_text"),
    )
    schema = StructType([*whole.schema.fields[:-1], StructField("uid", LongType()), StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))])
    rows = stored(whole.mapInArrow(_keys, schema), "keyed")
    links = copy_links(rows.select("rid", "uid", "fp", "keys", F.col("row.text").alias("text")))
    rank = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid"))
    least = stored(rows.groupBy("uid").agg(F.min(rank).alias("least")), "least")
    classed = least.join(components(links).withColumnRenamed("node", "uid"), "uid", "left")
    winners = classed.groupBy(F.coalesce("root", "uid").alias("root")).agg(F.min("least")["rid"].alias("rid"))
    return rows.join(winners.select("rid"), "rid", "left_semi").select("row.*")
