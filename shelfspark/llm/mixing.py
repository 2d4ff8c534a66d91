"""Mixing sources to target weights: fixed-length blocks, multinomial draws, index permutations, a join by index.

1. The words of a source, its documents in order of their ids, form a stream that is cut into blocks of `BLOCK` words;
   the last block of a stream may be shorter.
2. A source's target fixes how many words, and so how many slots of one block each, it gets: whole passes over its blocks
   and one pass that stops at the target, inside a block if need be. No pass begins after three times the source's size.
3. Slots are dealt to output shards of `SLOTS`. Each shard draws the source of each of its slots, with chances in
   proportion to the sources' slots: its counts are multinomial. What all draws together have over or under a source's
   slots is exchanged, so totals are exact and only the spread over shards is random.
4. A source's slots are numbered through all shards; number k is place k mod blocks of pass k div blocks, and a keyed
   permutation of the pass (a swap-or-not shuffle) turns the place into a block. The short block comes last in a pass.
5. Slots and documents meet by (source, block).

Everything is DataFrame work. Only single sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.common import ordered_totals, prepare, stored, table

BLOCK = 128
SLOTS = 65536
LIMIT = 3
WEIGHTS = 3
ROUNDS = 16
SEED = 7
#: Up to so many sources, the cells of the number line (4096 and two a source at most, 32 bytes each) are broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    """Number of words; only the ends of a split can be empty."""
    return F.coalesce(F.size(F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame) -> DataFrame:
    """(src, source, source_size, weight, target) from (source, size); src numbers the sources from 0, null last.

    Weights are 1, 2, 3, repeating. The level rises until what stopped sources leave over is shared out: one aggregate
    per round, and each round stops one more source at least.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = ordered_totals(sizes, [F.col("source").isNull(), F.col("source")], F.lit(1).cast("long"), "src")
    ranked = stored(ranked.withColumn("weight", (1 + F.col("src") % WEIGHTS).cast("long")), "sources")
    most = LIMIT * F.col("source_size")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        above = most < F.lit(level) * F.col("weight")
        r = ranked.agg(F.sum(F.when(above, most)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if r.n == stopped or not r.open:
            break
        stopped = r.n
        level = (total - (r.held or 0)) / r.open
    target = F.least(F.lit(level) * F.col("weight"), most.cast("double"))
    return ranked.select("src", "source", "source_size", "weight", target.alias("target"))


def permuted(place: Column, n: Column, *key: Column) -> Column:
    """The place's image under a keyed permutation of 0 to n - 1: in each round, x and (shift - x) mod n swap or not."""

    def round_(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *key), n) - x, n)
        swap = F.xxhash64(F.lit(SEED + 1), r, *key, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), place, round_)


def slot_plan(sources: DataFrame) -> DataFrame:
    """The sources with their blocks and slots: full, tail, blocks, passes, rest (words of the last pass), slots."""
    size, whole = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
    plan = (
        sources.withColumn("full", F.floor(size / BLOCK).cast("long"))
        .withColumn("tail", size % BLOCK)
        .withColumn("blocks", F.col("full") + (F.col("tail") > 0).cast("long"))
        .withColumn("passes", F.when(size > 0, F.floor(whole / size)).otherwise(0).cast("long"))
        .withColumn("rest", whole - F.col("passes") * size)
    )
    last = F.least(F.ceil(F.col("rest") / BLOCK).cast("long"), F.col("blocks"))
    return plan.withColumn("slots", F.col("passes") * F.col("blocks") + last)


def slots(plan: DataFrame) -> DataFrame:
    """(shard, src, pass, place, block, words): every slot of the mix and the block it takes, from its start on."""
    spark = plan.sparkSession
    plan = stored(ordered_totals(plan, [F.col("src")], F.col("slots"), "before"), "plan")
    total, sources = plan.agg(F.sum("slots"), F.count("*")).first()
    total = total or 0
    # a source covers the numbers from `before` on; equal cells of the number line turn the range into an equality
    width = max(1, -(-total // (4096 + sources)))
    cells = plan.where("slots > 0").select(
        "src", "before", "slots", F.explode(F.sequence(F.floor(F.col("before") / width), F.floor((F.col("before") + F.col("slots") - 1) / width))).alias("cell")
    )
    shards = spark.range(-(-total // SLOTS)).withColumnRenamed("id", "shard")
    draws = shards.select("shard", F.explode(F.sequence(F.lit(0), F.least(F.lit(SLOTS), F.lit(total) - F.col("shard") * SLOTS) - 1)).alias("i"))
    draws = draws.withColumn("u", F.pmod(F.xxhash64(F.lit(SEED), "shard", "i"), F.lit(max(total, 1))))
    draws = draws.withColumn("cell", F.floor(F.col("u") / width))
    inside = (F.col("u") >= F.col("before")) & (F.col("u") < F.col("before") + F.col("slots"))
    # the planner takes rows that an explode makes for few, so the join is chosen here
    cells = F.broadcast(cells) if sources <= BROADCAST_SOURCES else cells.hint("merge")
    drawn = draws.join(cells, "cell").where(inside).groupBy("shard", "src").agg(F.count("*").alias("n"))
    # one row per shard and source: a source's window holds as many rows as there are shards
    earlier = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = stored(drawn.withColumn("from", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "draws")

    plan = plan.join(drawn.groupBy("src").agg(F.sum("n").alias("got")), "src", "left").fillna(0, ["got"])
    plan = plan.withColumn("over", F.greatest(F.col("got") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("got"), F.lit(0)))
    plan = ordered_totals(plan, [F.col("src")], F.col("over"), "over_before")
    plan = stored(ordered_totals(plan, [F.col("src")], F.col("under"), "under_before"), "plan")

    # few rows make many slots: they are spread by number, or they would stay in one partition
    spread = drawn.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "src")
    numbered = spread.join(plan, "src").select("shard", "src", "slots", "over_before", F.explode(F.sequence("from", F.col("from") + F.col("n") - 1)).alias("k"))
    vacant = numbered.where("k >= slots").select("shard", (F.col("over_before") + F.col("k") - F.col("slots")).alias("place"))
    lacking = plan.where("under > 0").select(
        "src", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("i"), "got", "under_before"
    ).select("src", (F.col("got") + F.col("i")).alias("k"), (F.col("under_before") + F.col("i")).alias("place"))
    dealt = numbered.where("k < slots").select("shard", "src", "k").union(vacant.join(lacking.hint("merge"), "place").select("shard", "src", "k"))

    dealt = dealt.join(plan.select("src", "full", "tail", "blocks", "passes", "rest"), "src")
    dealt = dealt.withColumn("pass", F.floor(F.col("k") / F.col("blocks")).cast("long")).withColumn("place", F.col("k") % F.col("blocks"))
    short = F.col("place") == F.col("full")
    size = F.when(short, F.col("tail")).otherwise(F.lit(BLOCK))
    return dealt.select(
        "shard", "src", "pass", "place",
        F.when(short, F.col("full")).otherwise(permuted(F.col("place"), F.col("full"), F.col("src"), F.col("pass"))).alias("block"),
        F.when(F.col("pass") == F.col("passes"), F.least(size, F.col("rest") - F.col("place") * BLOCK)).otherwise(size).alias("words"),
    )


def packed(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's stream (src, at, start; start numbers the words of all), and the sources."""
    rows = docs.select(*keep, "doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64("text").alias("_hash"))
    rows = stored(rows, "sizes")
    sources = source_targets(rows)
    order = [F.col("source").isNull(), F.col("source"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("size"), F.col("_hash")]
    rows = ordered_totals(rows, order, F.col("size"), "start")
    sources = stored(ordered_totals(sources, [F.col("src")], F.col("source_size"), "base"), "sources")
    same = rows["source"].eqNullSafe(sources["source"])
    rows = rows.join(sources.select("source", "src", "base"), same).drop(sources["source"])
    return stored(rows.withColumn("at", F.col("start") - F.col("base")), "packed"), sources


def mixed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The mix: (shard, src, pass, place, block, start, from, words), a document's share of a slot from word `from` of the document on.

    A document is named by the number `start` of its first word. The shares of a slot, in order of `start`, are its text.
    """
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    pieces = rows.where("size > 0").select("src", "start", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("at") - F.col("block") * BLOCK, F.lit(0))
    high = F.least(F.col("at") + F.col("size") - F.col("block") * BLOCK, F.col("words"))
    return (
        pieces.join(slots(slot_plan(sources)), ["src", "block"])
        .select("shard", "src", "pass", "place", "block", "start", (F.col("block") * BLOCK + low - F.col("at")).alias("from"), (high - low).alias("words"))
        .where("words > 0")
    )


def mix_text(docs: DataFrame) -> DataFrame:
    """(shard, src, pass, place, words, text): the mix itself, a row for each slot; a shard's text is its slots in order.

    Documents are cut at the same block borders as the slots take, so a text that many slots take from travels block by
    block. Words are joined by single spaces. Slots of a source come in the order of (pass, place) within a shard.
    """
    prepare(docs.sparkSession)
    rows, sources = packed(docs, ["text"])
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("size") - 1) / BLOCK)

    def part(words: Column, block: Column) -> Column:
        low = F.greatest(F.col("at") - block * BLOCK, F.lit(0))
        start = (block * BLOCK + low - F.col("at")).cast("int")
        return F.struct(block.alias("block"), low.alias("low"), F.slice(words, start + 1, (BLOCK - low).cast("int")).alias("own"))

    # the words are found once, not once for each block
    found = F.array(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    parts = F.flatten(F.transform(found, lambda words: F.transform(F.sequence(first, last), lambda block: part(words, block))))
    pieces = rows.where("size > 0").select("src", "start", F.explode(parts).alias("part")).select("src", "start", "part.*")
    taken = pieces.join(slots(slot_plan(sources)), ["src", "block"]).where("low < words")
    own = F.slice("own", F.lit(1), (F.col("words") - F.col("low")).cast("int"))
    slot = taken.groupBy("shard", "src", "pass", "place").agg(F.max("words").alias("words"), F.array_sort(F.collect_list(F.struct("start", own.alias("own")))).alias("shares"))
    return slot.select("shard", "src", "pass", "place", "words", F.array_join(F.flatten(F.col("shares.own")), " ").alias("text"))


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`keep`, doc_id, source, size, source_size, target and taken of every row.

    A null source is a source of its own, the last; rows without words are never taken. Rows that agree in source, id,
    size and text are interchangeable; all else is in a fixed order, so reruns agree whatever the partitioning.
    """
    prepare(docs.sparkSession)
    rows, sources = packed(docs, keep or [])
    taken = mixed(rows, sources).groupBy("start").agg(F.sum("words").alias("taken"))
    key = F.when(F.col("size") > 0, F.col("start"))
    rows = rows.withColumn("_key", key).join(taken.withColumnRenamed("start", "_key"), "_key", "left")
    rows = rows.join(sources.select("src", "source_size", "target"), "src")
    return rows.select(*(keep or []), "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")
