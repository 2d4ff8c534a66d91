"""Benchmark decontamination: SimHash windows of an item's size, multi-index Hamming blocks, exact verification.

A document's window of an item's n words counts as a leak if the weighted (multiset) Jaccard similarity of their five-word
shingles is `SIMILARITY` or more. Words are lower-cased runs of letters and digits. An item of fewer than five words is
one shingle.

Which windows are fingerprinted. A window that shares no shingle with any item of its size can't reach the similarity.
Nor need a window start elsewhere than at a shared shingle: moved on to its first one it keeps all it shares, loses only
what it doesn't, and so its similarity doesn't fall (at the end of the document it gets shorter, which raises it). So the
windows start at the document's shingles that occur in an item of that size, which one hash join finds.

Fingerprints are 64-bit SimHashes of the windows' words, each with its number of occurrences as weight. A window and an
item of the same size that differ in RADIUS bits or fewer agree on at least one of RADIUS + 1 blocks of bits. A window is
looked up only for items that have its first shingle, by the reasoning above; a join on (size, shingle, block, value)
finds all of them, and unrelated pairs don't meet. Five-word similarity of 0.8 leaves room for few changed words (one inside 49
words, three at the edges of 35), which move about 4 to 9 of 64 bits; RADIUS lies over two deviations above that.

DataFrame functions only. The driver sees the number of the items' shingles and the shingle lengths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import prepare, stored, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCK_BITS = 4
#: Up to so many (shingle, size) rows, 24 bytes each, are broadcast; more are joined through a shuffle.
BROADCAST_ROWS = 1_000_000


def word_array(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _gram(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(words, at + i) for i in range(size)))


def _grams(words: Column, size: int) -> Column:
    """Hashes of all runs of `size` words; none if there are fewer."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _gram(words, i, size)))


def _with_shingles(rows: DataFrame, name: str) -> DataFrame:
    """Add the shingles of `words`; each occurrence of one is numbered, so that sets do for multisets."""
    last = F.greatest(F.size("words") - SHINGLE, F.lit(0))
    rows = rows.withColumn(name, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " ")))

    def numbered(x: Column, i: Column) -> Column:
        return F.concat_ws("#", x, F.size(F.filter(F.slice(name, F.lit(1), i), lambda y: y == x)))

    once = F.size(F.array_distinct(name)) == F.size(name)
    return rows.withColumn(name, F.when(once, F.transform(name, lambda x: F.concat(x, F.lit("#0")))).otherwise(F.transform(name, numbered)))


def with_simhash(rows: DataFrame, key: str) -> DataFrame:
    """(key, fp) of rows of (key, words), words not empty: a bit is set if over half the words' hashes have it.

    Two counters of 32 bits share a long; a task sums a row's words before the shuffle.
    """
    hashed = rows.select(key, F.size("words").alias("n"), F.explode("words").alias("w")).withColumn("h", F.xxhash64("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit((1 << 32) + 1))).alias(f"b{j}") for j in range(32)]
    summed = hashed.groupBy(key, "n").agg(*lanes)
    bits = []
    for j in range(32):
        low, high = F.col(f"b{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"b{j}", 32)
        for b, count in ((j, low), (j + 32, high)):
            value = (1 << b) - (1 << 64 if b == 63 else 0)
            bits.append(F.when(2 * count > F.col("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def _blocks(fp: Column) -> Column:
    """(block number, value) of every block of the fingerprint."""
    return F.array(*(F.struct(F.lit(j).alias("block"), F.shiftrightunsigned(fp, j * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1)).alias("value")) for j in range(64 // BLOCK_BITS)))


def _windows(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, text_hash, start, n, gram, words): the windows of n words that begin with a shingle of an item of n words."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), word_array("text").alias("doc_words"))
    starts = []
    for q in sizes:
        shared = grams.where(F.col("q") == q).select("n", "gram").distinct()
        if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            shared = F.broadcast(shared)
        spread = texts.select("doc_id", "text_hash", "doc_words", F.posexplode(_grams(F.col("doc_words"), q)).alias("start", "gram"))
        hits = spread.join(shared, "gram")
        starts.append(hits.select("doc_id", "text_hash", "start", "n", "gram", F.slice("doc_words", F.col("start") + 1, F.col("n")).alias("words")))
    return reduce(DataFrame.union, starts)


def _met(windows: DataFrame, items: DataFrame, grams: DataFrame) -> DataFrame:
    """(key, fp, item, item_fp, block): windows and items that have the window's first shingle and agree on a block."""
    marked = with_simhash(windows.select("key", "words"), "key").join(windows.select("key", "n", "gram"), "key")
    marked = marked.select("key", "n", "gram", "fp", F.inline(_blocks(F.col("fp"))))
    known = with_simhash(items.select("key", "words"), "key").join(grams.select("key", "n", "gram"), "key")
    known = stored(known.select(F.col("key").alias("item"), "n", "gram", F.col("fp").alias("item_fp"), F.inline(_blocks(F.col("fp")))), "item-blocks")
    return marked.join(known, ["n", "gram", "block", "value"]).select("key", "fp", "item", "item_fp", "block")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, similarity, hamming, start, words): the best window of each document for each item.

    docs has doc_id and text, items has item_id and text; other columns are not read. Null, empty and wordless texts on
    either side match nothing. Rows of documents that repeat an id and a text give one row; so do repeated items. start
    counts words from 0; ties in similarity go to the nearer fingerprint, then to the smaller start.
    """
    prepare(docs.sparkSession)
    items = items.select("item_id", word_array("text").alias("words")).where(F.size("words") > 0).distinct()
    items = items.withColumn("n", F.size("words")).withColumn("q", F.least("n", F.lit(SHINGLE)))
    items = stored(items.withColumn("key", F.monotonically_increasing_id()), "items")
    sizes = sorted(r.q for r in items.select("q").distinct().collect())  # at most SHINGLE values
    if not sizes:
        item_id = F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")
        nothing = (F.lit(0).alias(x) for x in ("hamming", "start", "words"))
        return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), item_id, F.lit(0.0).alias("similarity"), *nothing).where("false")
    each = [items.where(F.col("q") == q).select("key", "n", "q", F.explode(F.array_distinct(_grams(F.col("words"), q))).alias("gram")) for q in sizes]
    grams = stored(reduce(DataFrame.union, each), "item-shingles")
    windows = stored(_windows(docs, grams, sizes).withColumn("key", F.monotonically_increasing_id()), "windows")

    met = _met(windows, items, grams)
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = met.withColumn("hamming", F.bit_count(apart)).where(F.col("hamming") <= RADIUS)
    # a pair that agrees on several blocks is kept at the first of them
    equal = reduce(lambda rest, j: F.when(F.shiftrightunsigned(apart, j * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1)) == 0, j).otherwise(rest), reversed(range(64 // BLOCK_BITS)), F.lit(-1))
    near = near.where(F.col("block") == equal).select("key", "item", "hamming")

    wanted = _with_shingles(items, "wanted").select(F.col("key").alias("item"), "item_id", "wanted")
    pairs = _with_shingles(windows.join(near, "key"), "found").join(wanted, "item")
    common = F.size(F.array_intersect("found", "wanted"))
    pairs = pairs.withColumn("similarity", common / (F.size("found") + F.size("wanted") - common)).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("h"), (-F.col("start")).alias("s"), F.size("words").alias("words"))).alias("best")
    return (
        pairs.groupBy("doc_id", "text_hash", "item_id").agg(best)
        .select("doc_id", "text_hash", "item_id", "best.similarity", (-F.col("best.h")).alias("hamming"), (-F.col("best.s")).alias("start"), "best.words")
    )


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item was found; all columns stay, whatever their names."""
    found = leaks(docs, items).select("doc_id", "text_hash").distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    leaked = whole["row.doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64("row.text") == found["text_hash"])
    return whole.join(found, leaked, "left_anti").select("row.*")


def op9_decontamination(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
