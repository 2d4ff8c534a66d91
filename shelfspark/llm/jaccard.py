"""Links between sets of shingles: MinHash bands, exact Jaccard, and buckets of any size.

Sets are linked if their Jaccard similarity is `SIMILARITY` or more. Sets that agree on a band key are compared exactly.
Comparing is one matrix product over the shingles that several sets of a group share.

A bucket of over `BUCKET` sets is dealt into blocks, and every block also gets the bucket's `PIVOTS`: rows grow with the bucket,
not with its pairs, and versions of one text are connected through block mates and pivots. Of buckets that hold the same sets one is
compared. What is then outside the
bucket's largest component still lacks comparisons. Rounds follow in which some of these, four times as many each round,
are compared with the whole bucket; after that nothing is left to find for them. A bucket is closed when none are left,
so no colliding pair is lost, and a round's rows are those of the bucket and its pivots, by blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import stored
from shelfspark.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BUCKET = 128
PIVOTS = 4
#: Members and pivots that meet in a task in the rounds that close a bucket.
MEMBERS = 1024
CHOSEN = 512
#: Numbers of a matrix.
CELLS = 1 << 22

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def tuned(similarity: float, recall: float, rows: int) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` hashes that reach the recall at the similarity."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands, rows


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the runs, and where each run begins among them."""
    begins = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(begins - starts, counts), begins


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_words(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each word, none empty or with a space: its UTF-8 bytes, eight at a time, then their number."""
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(" ".join(words).encode("utf-8", "surrogatepass") + bytes(8), np.uint8)
    ends = np.append(np.flatnonzero(data[:-8] == 32), len(data) - 8)
    starts = np.append(0, ends[:-1] + 1)
    sizes = ends - starts
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place
    found = mix((eights[starts] & _MASKS[np.minimum(sizes, 8)]) + _GOLDEN)
    rest = np.flatnonzero(sizes > 8)
    done = 8
    while len(rest):
        more = eights[starts[rest] + done] & _MASKS[np.minimum(sizes[rest] - done, 8)]
        found[rest] = mix(found[rest] + mix(more + _GOLDEN))
        done += 8
        rest = rest[sizes[rest] > done]
    return mix(found + sizes.astype(np.uint64))


def identities(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit name of each run of words."""
    words, begins = spread(starts, lengths)
    place = (np.arange(len(words)) - np.repeat(begins, lengths)).astype(np.uint64)
    return mix(np.add.reduceat(mix(hashes[words] + place * _GOLDEN), begins) + lengths.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    """The shingles of consecutive words, 32 bits each; SHINGLE words or more."""
    shingle = np.zeros(len(hashes) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        shingle = mix(shingle + hashes[i : len(shingle) + i] + _GOLDEN)
    return (shingle >> np.uint64(32)).astype(np.uint32)


def band_keys(shingles: np.ndarray, begins: np.ndarray, bands: int, rows: int, ends: np.ndarray | None = None) -> np.ndarray:
    """One row of keys per set, one column per band. ends: where the sets' shingles end, if not where the next ones begin.

    Shingles are hashes already, so an order of them is a seed and an odd factor, both of 32 bits.
    """
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * _GOLDEN).astype(np.uint32).reshape(bands, rows, 2)
    if ends is not None:
        # what lies between two sets is reduced as well, and left out
        shingles, begins = np.append(shingles, np.uint32(0)), np.stack([begins, ends], axis=1).ravel()
    step = 1 if ends is None else 2
    keys = []
    for band in range(bands):
        key = np.full(len(begins) // step, band + 1, np.uint64)
        for seed, factor in seeds[band]:
            value = (shingles ^ seed) * (factor | np.uint32(1))
            least = np.minimum.reduceat(value, begins)[::step]
            key = mix(key + least + _GOLDEN)
        keys.append(key)
    return np.stack(keys, axis=1)


def joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sets' values one after the other, and where each begins and the last ends."""
    ends = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint32)), ends


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and ends (with a leading 0) of a list column of shingles."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint32), offsets - offsets[0]


def similar(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Whether each of the first sets is similar to each of all; the values of a set are distinct."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        apart = both >= SIMILARITY * (sizes.sum() - both)
        return np.array([[True, apart], [apart, True]])[:first]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((first, len(sets)), np.float32)
    total = int((count > 1).sum())
    width = min(max(CELLS // len(sets), 1), max(total, 1))
    for c in range(0, total, width):
        a, b = np.searchsorted(place, [c, c + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], place[a:b] - c] = 1
        both += held[:first] @ held.T
    both = both.astype(np.float64)
    return both >= SIMILARITY * (sizes[:first, None] + sizes - both)


def grouped(near: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node that each reaches; near says whether the first nodes are linked with all."""
    label, top = nodes.copy(), np.iinfo(np.int64).max
    while True:
        before = label.copy()
        first = np.minimum(label[: len(near)], np.where(near, label, top).min(axis=1))
        label = np.minimum(label, np.where(near, first[:, None], top).min(axis=0))
        label[: len(near)] = np.minimum(label[: len(near)], first)
        if (before == label).all():
            return label


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) that connect what is similar in a group. Input, sorted by key: key, member, uid, shingles.

    Rows that are no mere members are compared with all; members alone aren't compared with each other.
    """
    sets, uids, first, at = [], [], 0, None  # the last group, which may go on

    def done():
        if first and len(sets) > 1:
            nodes = np.array(uids)
            label = grouped(similar(sets, first), nodes)
            out.append((nodes[label != nodes], label[label != nodes]))

    def batch_of():
        columns = [np.concatenate([np.zeros(0, np.int64), *(p[i] for p in out)]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v"])

    for batch in batches:
        out: list[tuple[np.ndarray, np.ndarray]] = []
        values, ends = list_column(batch.column(3))
        key, uid = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        plain = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(key)))
        # most groups are pairs: all of a batch at once, but for those at its ends
        pair = (sizes == 2) & plain[starts]
        pair[:1] = pair[-1:] = False
        a = starts[pair]
        near = _alike(values, ends, a)
        low, high = np.minimum(uid[a], uid[a + 1])[near], np.maximum(uid[a], uid[a + 1])[near]
        out.append((high, low))
        for i in np.flatnonzero(~pair).tolist():
            begin, end = starts[i], starts[i] + sizes[i]
            if key[begin] != at:
                done()
                sets, uids, first, at = [], [], 0, key[begin]
            sets += [values[ends[j] : ends[j + 1]].copy() for j in range(begin, end)]
            uids += uid[begin:end].tolist()
            first += int(plain[begin:end].sum())
        yield batch_of()
    out = []
    done()
    yield batch_of()


def _alike(values: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether the sets of each of the rows and the row after it are similar."""
    counts = ends[rows + 2] - ends[rows]
    at, _ = spread(ends[rows], counts)
    of = np.repeat(np.arange(len(rows), dtype=np.uint64), counts)
    found = np.sort(of << np.uint64(32) | values[at])
    twice = found[1:][found[1:] == found[:-1]] >> np.uint64(32)
    both = np.bincount(twice.astype(np.int64), minlength=len(rows))
    return both >= SIMILARITY * (counts - both)


def _compared(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The links inside each key of (key, member, uid)."""
    met = rows.hint("merge").join(sets, "uid").select("key", "member", "uid", "shingles")
    dealt = met.repartition("key").sortWithinPartitions("key", "member", "uid")
    return stored(dealt.mapInArrow(_links, "u long, v long"), "links")


def colliding(rows: DataFrame) -> DataFrame:
    """(key, uid, n): the rows of (key, uid) whose key several different uids have, once each; n is their number."""
    # sorted by one number, which is far faster than by two; a batch orders its own uids
    dealt = rows.repartition("key").sortWithinPartitions("key")
    shared = stored(dealt.mapInArrow(_shared, "key long, uid long").distinct(), "shared")
    # a written side leaves the join free to split a hot key
    return stored(shared.join(stored(shared.groupBy("key").agg(F.count("*").alias("n")), "sizes"), "key"), "colliding")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, uid), sorted by key, those whose key has several uids; a uid may come again in a later batch.

    One row of the last key is held back.
    """
    last, open_ = None, False  # the held row, and whether its key has been given out
    for batch in batches:
        key, uid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        if last is not None:
            key, uid = np.append(last[0], key), np.append(last[1], uid)
        order = np.lexsort((uid, key))
        key, uid = key[order], uid[order]
        new = np.append(True, (key[1:] != key[:-1]) | (uid[1:] != uid[:-1]))
        key, uid = key[new], uid[new]
        same = key[1:] == key[:-1]
        give = np.append(False, same) | np.append(same, False)
        if open_:
            give |= key == last[0]
        last, open_ = (key[-1], uid[-1]), bool(give[-1])
        yield pa.record_batch([pa.array(key[give]), pa.array(uid[give])], names=["key", "uid"])


def _blocks(n, size: int):
    return F.ceil(n / size).cast("long")


def _block(uid, count):
    return F.pmod(F.xxhash64(uid), count)


def _all(count):
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def _different(found: DataFrame) -> DataFrame:
    """The rows of one key for each set of uids that share a key: similar sets share many keys, and are compared once.

    Sets of uids are told apart by their size and two xors of 64-bit hashes.
    """
    held = found.groupBy("key").agg(F.max("n").alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "uid")).alias("y"))
    kept = stored(held.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "kept")
    return stored(found.join(kept, "key", "left_semi"), "different")


def linked(found: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): links that connect all that share a key of (key, uid, n) and are similar by their sets (uid, shingles).

    Both are written tables; shingles are distinct, and no set is empty.
    """
    found = _different(found)
    plain = F.lit(False).alias("member")
    small = found.where(F.col("n") <= BUCKET).select("key", plain, "uid")
    hot = found.where(F.col("n") > BUCKET)
    count = _blocks(F.col("n"), BUCKET)
    chosen = [F.min(F.struct(F.xxhash64("uid", F.lit(i)), "uid"))["uid"] for i in range(PIVOTS)]
    pivots = hot.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("pivots"), F.max(count).alias("blocks"))
    pivots = pivots.select("key", "blocks", F.explode("pivots").alias("uid")).select("key", "uid", _all(F.col("blocks")).alias("block"))
    dealt = hot.select("key", "uid", _block(F.col("uid"), count).alias("block")).union(pivots)
    links = _compared(small.union(dealt.select(F.xxhash64("key", "block").alias("key"), plain, "uid")), sets)

    done, size = None, CHOSEN
    while not hot.isEmpty():
        roots = stored(components(links).withColumnRenamed("node", "uid"), "roots")
        links = roots.where("uid <> root").toDF("u", "v")  # the next round need not find these again
        rooted = stored(hot.join(roots, "uid", "left").select("key", "uid", "n", F.coalesce("root", "uid").alias("root")), "rooted")
        parts = stored(rooted.groupBy("key", "root").agg(F.count("*").alias("size")), "parts")
        largest = stored(parts.groupBy("key").agg(F.max(F.struct("size", "root"))["root"].alias("largest")), "largest")
        rest = rooted.join(largest, "key").where("root <> largest").select("key", "uid")
        rest = stored(rest if done is None else rest.join(done, ["key", "uid"], "left_anti"), "rest")
        left = stored(rest.groupBy("key").agg(F.count("*").alias("left")), "left")
        hot = stored(rooted.join(left, "key").select("key", "uid", "n"), "open")
        if hot.isEmpty():
            break
        # about `size` of what is left in a bucket, or all
        chosen = stored(rest.join(left, "key").where(F.pmod(F.xxhash64("uid", F.lit(size)), "left") < size).select("key", "uid"), "chosen")
        held = hot.groupBy("key").agg(F.max("n").alias("n"))
        counts = chosen.groupBy("key").agg(_blocks(F.count("*"), CHOSEN).alias("chunks")).join(held, "key")
        counts = stored(counts.select("key", "chunks", _blocks(F.col("n"), MEMBERS).alias("blocks")), "counts")
        ones = chosen.join(counts, "key").select("key", "uid", _all(F.col("blocks")).alias("block"), _block(F.col("uid"), F.col("chunks")).alias("chunk"), F.lit(False).alias("member"))
        many = hot.select("key", "uid").join(counts, "key").select("key", "uid", _block(F.col("uid"), F.col("blocks")).alias("block"), _all(F.col("chunks")).alias("chunk"), F.lit(True).alias("member"))
        links = links.union(_compared(ones.union(many).select(F.xxhash64("key", "block", "chunk").alias("key"), "member", "uid"), sets))
        done = chosen if done is None else done.union(chosen)
        size *= 4
    return links
