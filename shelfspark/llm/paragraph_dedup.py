"""Repeated passages: MinHash banding over paragraphs, lines and pieces of text, exact Jaccard, components.

Three kinds of units are compared whole, by five-word shingles:
- lines of `MIN_LINE` words or more;
- paragraphs of as many words: the lines between blank lines, joined, so a wrapped paragraph equals an unwrapped one;
- pieces of the document's whole word stream, cut where its own words say so: before a word whose pair hash is the smallest
  within `REACH` words on either side, and after `MAX_PIECE` words at the latest. Line breaks have no part in it, so a passage
  inside longer text meets its copy however either is wrapped, but for the pieces at its ends. Pieces have 17 words on
  average; those under `MIN_PIECE` words are left out.
Units of the same words of a document are one. Units overlap; what goes is the union of the removed ones. Each class keeps
the unit of the lowest rank, so what is removed always has a copy of lower rank.

Bands are tuned so that a pair at the least similarity collides with probability `RECALL` or more. Colliding units are
compared exactly, Jaccard 0.8 or more links them (see `jaccard`), and components of links are the classes. Equal units
share a 64-bit identity and are compared as one. Shingles are made again from the text for the units that collide; no
table holds those of all units.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import discard, prepare, stored, table
from shelfspark.llm.graph import components
from shelfspark.llm.jaccard import SHINGLE, SIMILARITY, band_keys, colliding, hash_words, identities, linked, mix, shingle_hashes, spread, tuned

RECALL = 0.99
MIN_LINE = 20
MIN_PIECE = 9
MAX_PIECE = 64
REACH = 8
#: Words handled at a time, and at least one text.
PIECE_WORDS = 1 << 18
BANDS, ROWS = tuned(SIMILARITY, RECALL, 4)
#: Bands that are dealt out at a time: the shuffle of all would be the largest thing on disk.
AT_ONCE = 3
DEALS = -(-BANDS // AT_ONCE)


def pieces(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the pieces of consecutive documents; hashes: one per word, docs: words of each, none 0."""
    n = len(hashes)
    doc = np.repeat(np.arange(len(docs)), docs)
    first = np.cumsum(docs) - docs
    follow = np.where(np.append(doc[1:] == doc[:-1], False), np.append(hashes[1:], np.uint64(0)), np.uint64(0))
    pair = mix(hashes * np.uint64(3) + follow)
    cut = np.ones(n, bool)
    for d in range(1, min(REACH, n - 1) + 1):
        same = doc[d:] == doc[:-d]
        cut[d:] &= ~same | (pair[d:] <= pair[:-d])
        cut[:-d] &= ~same | (pair[:-d] <= pair[d:])
    cut = _thinned(cut, doc)
    cut[first] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, n))
    parts = -(-lengths // MAX_PIECE)
    starts = np.repeat(starts, parts) + MAX_PIECE * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    lengths = np.diff(np.append(starts, n))
    good = lengths >= np.where(lengths == docs[doc[starts]], MIN_LINE, MIN_PIECE)
    return starts[good], lengths[good]


def _thinned(cut: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Cuts at equal hashes, as a repeated phrase has them, kept only where the last kept one is MIN_PIECE words away."""
    at = np.flatnonzero(cut)
    if len(at) > 1 and (close := (np.diff(at) < MIN_PIECE) & (doc[at[1:]] == doc[at[:-1]])).any():
        kept, of = -MIN_PIECE, -1
        for i in np.flatnonzero(np.append(close, False) | np.append(False, close)):
            x = at[i]
            if doc[x] == of and x - kept < MIN_PIECE:
                cut[x] = False
            else:
                kept, of = x, doc[x]
    return cut


def spans(hashes: np.ndarray, docs: np.ndarray, lines: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of all units of consecutive documents; docs, lines and blocks: words of each, none 0."""
    starts, lengths = pieces(hashes, docs)
    for whole in (lines, blocks):
        long = whole >= MIN_LINE
        starts = np.append(starts, (np.cumsum(whole) - whole)[long])
        lengths = np.append(lengths, whole[long])
    _, first = np.unique(starts * (len(hashes) + 1) + lengths, return_index=True)
    return starts[first], lengths[first]


def layout(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """(words, words of each line, words of each paragraph); empty ones are left out."""
    words, lines, blocks, block = [], [], [], 0
    for line in (text or "").lower().splitlines():
        found = line.split()
        if found:
            lines.append(len(found))
            block += len(found)
            words += found
        elif block:
            blocks.append(block)
            block = 0
    if block:
        blocks.append(block)
    return words, lines, blocks


def word_hashes(text: str | None) -> tuple[np.ndarray, list[int], list[int]]:
    """The layout with the words' hashes."""
    words, lines, blocks = layout(text)
    return hash_words(words), lines, blocks


_KEYS = [f"keys{i}" for i in range(DEALS)]
_UNIT = ", ".join(["doc_id long, rid long, text_hash long, from_word long, words int, uid long", *(f"{k} array<long>" for k in _KEYS)])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of every text. Input: doc_id, rid, text_hash, text. Band keys come with the first of equal units of a task."""
    seen: set[int] = set()

    def flush(words, docs, lines, blocks, owners):
        hashes, docs = hash_words(words), np.array(docs, np.int64)
        starts, lengths = spans(hashes, docs, np.array(lines, np.int64), np.array(blocks, np.int64))
        ends = np.cumsum(docs)
        shingles = shingle_hashes(hashes) if len(hashes) >= SHINGLE else np.zeros(0, np.uint32)
        # units go out in groups of bounded size
        group = np.cumsum(lengths) // PIECE_WORDS
        for g in np.unique(group):
            own, size = starts[group == g], lengths[group == g]
            of = np.searchsorted(ends, own, "right")
            uids = identities(hashes, own, size)
            fresh = np.zeros(len(uids), bool)
            for i, uid in enumerate(uids.tolist()):
                if uid not in seen:
                    seen.add(uid)
                    fresh[i] = True
            new = own[fresh]
            keys = band_keys(shingles, new, BANDS, ROWS, new + size[fresh] - (SHINGLE - 1)).view(np.int64) if fresh.any() else np.zeros((0, BANDS), np.int64)
            lists = []
            for part in np.array_split(keys, range(AT_ONCE, BANDS, AT_ONCE), axis=1):
                offsets = np.append(0, np.cumsum(fresh * part.shape[1])).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(part.ravel()), mask=pa.array(~fresh)))
            ids = [pa.array([x[k] for x in owners], pa.int64()).take(pa.array(of)) for k in range(3)]
            columns = [*ids, pa.array(own - (ends - docs)[of]), pa.array(size.astype(np.int32)), pa.array(uids.view(np.int64)), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _UNIT.split(", ")])

    for batch in batches:
        words, docs, lines, blocks, owners = [], [], [], [], []
        for doc, rid, name, text in zip(*(c.to_pylist() for c in batch.columns)):
            found, own_lines, own_blocks = layout(text)
            if found:
                words += found
                docs.append(len(found))
                lines += own_lines
                blocks += own_blocks
                owners.append((doc, rid, name))
            if len(words) >= PIECE_WORDS:
                yield from flush(words, docs, lines, blocks, owners)
                words, docs, lines, blocks, owners = [], [], [], [], []
        if docs:
            yield from flush(words, docs, lines, blocks, owners)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, shingles) of the wanted units. Input: wanted (from_word, words, uid), text. Only their own words are hashed."""

    def flush(words: list[str], sizes: list[int], uids: list[int]) -> pa.RecordBatch:
        counts = np.array(sizes, np.int64)
        at, _ = spread(np.cumsum(counts) - counts, counts - (SHINGLE - 1))
        # a unit's shingles, sorted, each once
        unit = np.repeat(np.arange(len(sizes), dtype=np.uint64), counts - (SHINGLE - 1))
        found = np.unique(unit << np.uint64(32) | shingle_hashes(hash_words(words))[at])
        ends = np.append(0, np.cumsum(np.bincount((found >> np.uint64(32)).astype(np.int64), minlength=len(sizes))))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.uint32).view(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(uids, pa.int64()), lists], names=["uid", "shingles"])

    for batch in batches:
        wanted = batch.column(0)
        offsets = wanted.offsets.to_numpy()
        places = zip(*(wanted.values.field(k).to_pylist() for k in range(3)))
        places = list(places)[offsets[0] : offsets[-1]]
        words, sizes, uids = [], [], []
        for a, b, text in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist(), batch.column(1).to_pylist()):
            own = text.lower().split()
            for from_word, size, uid in places[a:b]:
                words += own[from_word : from_word + size]
                sizes.append(size)
                uids.append(uid)
                if len(words) >= PIECE_WORDS:
                    yield flush(words, sizes, uids)
                    words, sizes, uids = [], [], []
        if sizes:
            yield flush(words, sizes, uids)


def unit_links(units: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v): links between units, enough to connect all that collide (key, uid, n) and are similar. docs: doc_id, text_hash, text."""
    # each unit that collides is fetched once, from the first document that has it
    place = F.struct("text_hash", "doc_id", "from_word", "words")
    once = units.join(found.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(F.min(place).alias("place"))
    wanted = once.groupBy("place.doc_id", "place.text_hash").agg(F.collect_list(F.struct("place.from_word", "place.words", "uid")).alias("wanted"))
    wanted = stored(wanted.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"), "wanted")
    # rows that repeat an id and a text would each give its units
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]) & (docs["text_hash"] == wanted["_hash"])).select("wanted", "text")
    fetched = stored(texts.mapInArrow(_sets, "uid long, shingles array<int>"), "fetched")
    sets = stored(fetched.dropDuplicates(["uid"]), "sets")
    discard(fetched)
    return linked(found, sets)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, from_word, words, component_id, removed): every unit whose class occurs in several documents.

    from_word counts the document's white-space separated words from 0. component_id is the smallest doc_id of the class
    (null if none has one). One unit of each class stays: that of the smallest doc_id, nulls last, then the first row and
    word; all others are removed. Rows that repeat a document are documents of their own, so all but one lose their
    passages. Null and empty texts have no units; repeats inside one document alone don't count.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    numbered = texts.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text_hash", "text")
    keyed = stored(numbered.mapInArrow(_units, _UNIT), "keyed-units")
    # a band's keys differ from those of all others
    found = reduce(DataFrame.union, [colliding(keyed.where(F.col(k).isNotNull()).select(F.explode(k).alias("key"), "uid")) for k in _KEYS])
    # the keys are most of the table, and have told what collides
    units = stored(keyed.drop(*_KEYS), "units")
    discard(keyed)
    classes = components(unit_links(units, found, texts)).withColumnRenamed("node", "uid")
    # units of one row alone, without a class, are most; sums by unit leave them out before anything is joined
    none = F.lit(None).cast("long")
    met = units.select("uid", F.col("rid").alias("a"), F.col("rid").alias("b"), none.alias("root"))
    met = met.union(classes.select("uid", none, none, "root"))
    met = met.groupBy("uid").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("root").alias("root")).where("root is not null or a < b")
    met = stored(met.select("uid", "a", "b", F.coalesce("root", "uid").alias("class")), "met")
    several = stored(met.groupBy("class").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a < b").select("class"), "several")
    named = stored(met.join(several, "class").select("uid", "class"), "named")
    repeated = stored(units.join(named, "uid").select("doc_id", "rid", "from_word", "words", "class"), "repeated")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid", "from_word", "words")
    firsts = stored(repeated.groupBy("class").agg(F.min(rank).alias("first")), "firsts")
    stays = (F.col("rid") == F.col("first.rid")) & (F.col("from_word") == F.col("first.from_word")) & (F.col("words") == F.col("first.words"))
    return repeated.join(firsts, "class").select("doc_id", "from_word", "words", F.col("first.doc_id").alias("component_id"), (~stays).alias("removed"))


def op10_paragraph_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
