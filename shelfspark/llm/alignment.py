"""Cross-tokenizer alignment: token links by byte ranges, pair counts by external sorted runs.

Texts are cut before every single space between two characters that are no space. A token of neither tokenizer crosses
such a place (A's pattern and B's vocabulary are checked for it, or texts stay whole), so a batch's different units are encoded and aligned once each, and a
document is the sequence of its units. Tokens of A and B are linked if their byte ranges overlap: each stretch between
neighbouring ends of tokens belongs to one token on either side, and to every linked pair belongs one stretch.

Counting. A task gathers (pair, document, links) records. When it has `RECORDS` of them, they are sorted by pair, B's id
first, and go out as one zstd run for each radix of the B id, with the pairs' own sums beside it. The sums of a radix
are merged: a heap over the runs' blocks gives all pairs in order, up to `FAN` runs at a time, until one merge is left for
each radix. As B ids come one after the other, the highest count of each is known when the next begins. The counted pairs
then meet the record runs again, and every run streams what its records contribute back to its documents.

A radix holds at most (vocabulary A * vocabulary B / `RADIX`) counted pairs, however large the corpus; its record runs are
spread over as many tasks as they need, each with a copy of its counted pairs. So a frequent token is no task's burden.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm.common import prepare, stored, table

FOLDER = "/opt/tokenizers"
#: B ids are dealt by their remainder; fewer counted pairs for each, and more contributions of each document.
RADIX = 16
#: Records of a run, over all radixes.
RECORDS = 1 << 21
#: Entries of a compressed block.
BLOCK = 1 << 16
#: Runs merged at a time.
FAN = 128
#: Bytes of record runs for a task.
SHARE = 16 << 20
#: Documents of a run: they take 24 bits beside a pair's 39.
DOCS = 1 << 24
#: Where texts are cut.
CUT = re.compile(r"(?<=\S) (?=\S)")

# The bytes that stand for themselves in byte-level vocabularies, the others follow from code point 256 on.
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
# Fixed value: how byte-level vocabularies of this kind divide text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary."""
    rest = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers: how they encode, and the bytes of their ids."""

    _last: tuple[str, Tokenizers] | None = None

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        alphabet = byte_alphabet()
        spec = json.loads(a)
        vocabulary, special = spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"]}
        size = max(max(vocabulary.values()), *(t["id"] for t in spec["added_tokens"]), 0) + 1
        self.a_bytes = [b""] * size
        for token, i in vocabulary.items():
            if token not in special:
                self.a_bytes[i] = bytes(alphabet[c] for c in token)
        self._fast = self._ranked(spec, special)
        self._slow = Tokenizer.from_str(a.decode())
        self._slow.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # each id as it stands inside and at the end of a group
        ids_a, ids_b = range(len(self.a_bytes)), range(len(self.b_bytes))
        self.words = [x for i in ids_a for x in (b"%d," % i, b"%d|" % i)] + [x for i in ids_b for x in (b"%d," % i, b"%d;" % i)]
        # A's pattern begins a token at a space that stands alone, and no piece of B goes on over a space
        self.cuts = self._fast is not None and all("▁" not in p.lstrip("▁") for p in pieces)

    @classmethod
    def of(cls, shared) -> Tokenizers:
        """The worker's own, built once from the files' bytes."""
        if cls._last is None or cls._last[0] != shared.id:
            cls._last = (shared.id, cls(*shared.value))
        return cls._last[1]

    def _ranked(self, spec: dict, special: set[str]) -> tiktoken.Encoding | None:
        """The same vocabulary where its merges come in the order of ids, as the faster library wants them."""
        vocabulary = spec["model"]["vocab"]
        merged = [m if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        order = [vocabulary.get(m.replace(" ", "")) for m in merged]
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        singles = sorted(i for t, i in vocabulary.items() if len(t) == 1)
        if not plain or order != list(range(256, 256 + len(order))) or singles != list(range(256)):
            return None
        ranks = {self.a_bytes[i]: i for t, i in vocabulary.items() if t not in special}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text behind a space."""
        if self._fast is not None:
            return [np.array(self._fast.encode_ordinary(" " + t), np.int64) for t in texts]
        return [np.array(e.ids, np.int64) for e in self._slow.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self._b.encode(texts, num_threads=1)]


class Units:
    """The alignment of texts (without their leading space), one entry for each."""

    def __init__(self, texts: list[str], tokenizers: Tokenizers) -> None:
        ids_a, ids_b = tokenizers.encode_a(texts), tokenizers.encode_b(texts)
        for i, (text, a, b) in enumerate(zip(texts, ids_a, ids_b)):
            want = (" " + text).encode()
            if b"".join([tokenizers.a_bytes[x] for x in a.tolist()]) != want or b"".join([tokenizers.b_bytes[x] for x in b.tolist()]) != want:
                ids_a[i] = ids_b[i] = np.zeros(0, np.int64)
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        self.good = self.n_a > 0
        a, b = (np.concatenate([*ids, np.zeros(0, np.int64)]) for ids in (ids_a, ids_b))
        size_a, size_b = (np.array([len(x) for x in table], np.int64) for table in (tokenizers.a_bytes, tokenizers.b_bytes))
        ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        of_a = np.repeat(np.arange(len(texts)), self.n_a)
        cut_a, cut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        self.n_groups = np.bincount(of_a[cut_a], minlength=len(texts))
        self.n_links = self.n_a + self.n_b - self.n_groups
        # each stretch ends with a token of A, of B or of both
        single = ~cut_b
        order = np.argsort(np.append(ends_a, ends_b[single]), kind="stable")
        from_a = order < len(a)
        with_b = ~from_a
        with_b[from_a] |= cut_a
        at_a, at_b = np.cumsum(from_a) - from_a, np.cumsum(with_b) - with_b
        pair = b[at_b] * len(tokenizers.a_bytes) + a[at_a]
        # (unit, pair) once each, with the number of links
        of = of_a[at_a]
        sort = np.lexsort((pair, of))
        of, pair = of[sort], pair[sort]
        new = np.append(True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])) if len(of) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.pair, self.links = pair[starts], np.diff(np.append(starts, len(pair)))
        self.first = np.searchsorted(of[starts], np.arange(len(texts) + 1))
        self.text = self._written(a, b, cut_a, cut_b, tokenizers.words, len(tokenizers.a_bytes))

    def _written(self, a, b, cut_a, cut_b, words: list[bytes], count_a: int) -> list[bytes]:
        """The groups of each unit as `a1,a2|b1;...;`."""
        last_a, last_b = np.append(-1, np.flatnonzero(cut_a)), np.append(-1, np.flatnonzero(cut_b))
        line = np.zeros(len(a) + len(b), np.int64)
        # before a token of A stand the B tokens of earlier groups, before one of B the A tokens of its own group too
        line[np.arange(len(a)) + last_b[np.cumsum(cut_a) - cut_a] + 1] = 2 * a + cut_a
        line[np.arange(len(b)) + last_a[np.cumsum(cut_b) - cut_b + 1] + 1] = 2 * (count_a + b) + cut_b
        ends = np.cumsum(self.n_a + self.n_b)
        return [b"".join([words[i] for i in line[e - n : e].tolist()]) for e, n in zip(ends.tolist(), (self.n_a + self.n_b).tolist())]


def squeezed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as zstd, their bytes in planes."""
    values = np.ascontiguousarray(values, np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 8).T.tobytes())


def opened(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel().astype(np.int64)


def _framed(blobs: Iterable[bytes]) -> bytes:
    return b"".join(x for b in blobs for x in (struct.pack("<I", len(b)), b))


def _frames(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


def sum_run(keys: np.ndarray, sums: np.ndarray) -> bytes:
    """Keys in order and their sums, in blocks."""
    parts = range(0, len(keys), BLOCK)
    return _framed(squeezed(x) for i in parts for x in (np.diff(keys[i : i + BLOCK], prepend=0), sums[i : i + BLOCK]))


def run_blocks(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The blocks of a sum run, one opened at a time."""
    frames = _frames(data)
    for keys in frames:
        yield np.cumsum(opened(keys)), opened(next(frames))


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All keys of runs in order, once each, with the total of their sums.

    The heap holds the last key of each run's block: what is at most the least of these is complete and goes out.
    """
    heads = [next(r, None) for r in runs]
    heap = [(int(h[0][-1]), i) for i, h in enumerate(heads) if h is not None]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        keys, sums = [], []
        for i, head in enumerate(heads):
            if head is not None:
                n = int(np.searchsorted(head[0], bound, "right"))
                keys.append(head[0][:n])
                sums.append(head[1][:n])
                heads[i] = (head[0][n:], head[1][n:])
        while heap and heap[0][0] == bound:
            i = heap[0][1]
            heads[i] = next(runs[i], None)
            if heads[i] is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (int(heads[i][0][-1]), i))
        keys, sums = np.concatenate(keys), np.concatenate(sums)
        order = np.argsort(keys, kind="stable")
        keys, sums = keys[order], sums[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield keys[starts], np.add.reduceat(sums, starts)


class Runs:
    """The records of a task until they go out as runs. Keys order pairs by the B id's remainder, then B's id, then A's."""

    def __init__(self, count_a: int, count_b: int) -> None:
        self.count_a, self.per_radix = count_a, -(-count_b // RADIX)
        assert self.per_radix * RADIX * count_a < 1 << 39
        self._clear()

    def _clear(self) -> None:
        self.rids: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.links: list[np.ndarray] = []
        self.docs = self.records = 0

    def add(self, rids: np.ndarray, doc: np.ndarray, pair: np.ndarray, links: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The records of a batch; doc is the place in rids. What is held is at most RECORDS and the last batch's."""
        if self.docs + len(rids) > DOCS:
            yield from self.flush()
        b, a = np.divmod(pair, self.count_a)
        key = ((b % RADIX) * self.per_radix + b // RADIX) * self.count_a + a
        self.keys.append((key << 24) | (doc + self.docs))
        self.links.append(links)
        self.rids.append(rids)
        self.docs, self.records = self.docs + len(rids), self.records + len(doc)
        if self.records >= RECORDS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.records:
            keys, links, rids = np.concatenate(self.keys), np.concatenate(self.links), np.concatenate(self.rids)
            self._clear()
            order = np.argsort(keys)
            keys, links = keys[order], links[order]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            links, keys = np.add.reduceat(links, starts), keys[starts]
            pair, doc = keys >> 24, keys & (DOCS - 1)
            radix = pair // (self.per_radix * self.count_a)
            known = squeezed(np.diff(rids, prepend=0))
            for r in np.unique(radix).tolist():
                own = slice(*np.searchsorted(radix, [r, r + 1]))
                yield _run_row(r, pair[own], doc[own], links[own], known)
        self._clear()


_RUN = ["radix", "sums", "rids", "records"]


def _run_row(radix: int, pair: np.ndarray, doc: np.ndarray, links: np.ndarray, rids: bytes) -> pa.RecordBatch:
    starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    step = np.diff(doc, prepend=0)
    step[starts] = doc[starts]
    times = np.diff(np.append(starts, len(pair)))
    records = _framed(map(squeezed, (np.diff(pair[starts], prepend=0), times, step, links)))
    values = [radix, sum_run(pair[starts], np.add.reduceat(links, starts)), rids, records]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), *[pa.binary()] * 3])], names=_RUN)


_ALIGNED = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, radix int, sums binary, rids binary, records binary"
_NAMES = [c.split()[0] for c in _ALIGNED.split(", ")]


def _full(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of _ALIGNED, nulls where the batch has none."""
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    have = dict(zip(batch.schema.names, batch.columns))
    columns = [have.get(n, pa.nulls(batch.num_rows, types[c.split()[1]])) for n, c in zip(_NAMES, _ALIGNED.split(", "))]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _aligned(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row for each document and one for each run. Input: rid, doc_id, text."""
    tokenizers = Tokenizers.of(shared)
    runs = Runs(len(tokenizers.a_bytes), len(tokenizers.b_bytes))
    for batch in batches:
        rids, doc_ids = batch.column(0).to_numpy(), batch.column(1)
        known: dict[str, int] = {}
        units, sizes = [], []
        for text in batch.column(2).to_pylist():
            parts = [] if not text else CUT.split(text) if tokenizers.cuts else [text]
            units += [known.setdefault(p, len(known)) for p in parts]
            sizes.append(len(parts))
        found = Units(list(known), tokenizers)
        units, sizes = np.array(units, np.int64), np.array(sizes, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.bincount(doc[~found.good[units]], minlength=len(sizes)) > 0
        keep = ~bad[doc]
        units, doc = units[keep], doc[keep]
        sizes[bad] = 0
        totals = [np.bincount(doc, x[units], len(sizes)).astype(np.int64) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        ends, digests = np.cumsum(sizes).tolist(), []
        for end, size in zip(ends, sizes.tolist()):
            line = b"".join([found.text[u] for u in units[end - size : end].tolist()])
            digests.append(hashlib.sha256(line[:-1]).hexdigest() if size else "")
        columns = [batch.column(0), doc_ids, *map(pa.array, totals), pa.array(digests, pa.string())]
        yield _full(pa.RecordBatch.from_arrays(columns, names=_NAMES[:7]))
        # a document's unit gives all its pairs, times its occurrences
        seen, times = np.unique(doc * len(known) + units, return_counts=True)
        doc, units = np.divmod(seen, max(len(known), 1))
        many = found.first[units + 1] - found.first[units]
        at = np.repeat(found.first[units] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        for row in runs.add(rids, np.repeat(doc, many), found.pair[at], found.links[at] * np.repeat(times, many)):
            yield _full(row)
    for row in runs.flush():
        yield _full(row)


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """(key, rows) of sorted batches, the key being the first columns."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != at:
                if rows:
                    yield at, rows
                at, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield at, rows


def _merged_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum run from the runs of each (radix, salt)."""
    for (radix, _), rows in _by_group(batches, 2):
        data = b"".join(sum_run(k, s) for k, s in merged([run_blocks(r[0]) for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([data], pa.binary())], names=["radix", "sums"])


def _counted(batches: Iterator[pa.RecordBatch], count_a: int) -> Iterator[pa.RecordBatch]:
    """(radix, seq, pairs): a radix's pairs in order, with their counts and whether they are the B id's highest."""

    def closed(keys, sums):
        b = keys // count_a
        starts = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        best = sums == np.repeat(np.maximum.reduceat(sums, starts), np.diff(np.append(starts, len(b))))
        return _framed(map(squeezed, (np.diff(keys, prepend=0), sums, best)))

    for (radix,), rows in _by_group(batches, 1):
        held_keys, held_sums, out = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for keys, sums in merged([run_blocks(r[0]) for r in rows]):
            keys, sums = np.append(held_keys, keys), np.append(held_sums, sums)
            # the last B id may go on
            end = int(np.searchsorted(keys, keys[-1] // count_a * count_a))
            if end:
                out.append(closed(keys[:end], sums[:end]))
            held_keys, held_sums = keys[end:], sums[end:]
        out.append(closed(held_keys, held_sums))
        for seq, data in enumerate(out):
            yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([seq], pa.int32()), pa.array([data], pa.binary())], names=["radix", "seq", "pairs"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, n_best, count_sum) of every run's documents. Input, sorted: radix, salt, seq (null for runs, last), data, rids."""
    at, parts, info = None, [], None
    for batch in batches:
        for radix, salt, seq, data, rids in zip(*(c.to_pylist() for c in batch.columns)):
            if (radix, salt) != at:
                at, parts, info = (radix, salt), [], None
            if seq is not None:
                keys, sums, best = map(opened, _frames(data))
                parts.append((np.cumsum(keys), sums, best))
                continue
            if info is None:
                info, parts = [np.concatenate(x) for x in zip(*parts)], []
            pair, times, step, links = map(opened, _frames(data))
            place = np.searchsorted(info[0], np.cumsum(pair))
            starts = np.cumsum(times) - times
            walked = np.cumsum(step)
            doc = walked - np.repeat(walked[starts] - step[starts], times)
            rid = np.cumsum(opened(rids))
            order = np.argsort(doc, kind="stable")
            begins = np.flatnonzero(np.append(True, np.diff(doc[order]) > 0))
            best, total = (np.add.reduceat((links * np.repeat(x[place], times))[order], begins) for x in (info[2], info[1]))
            columns = [pa.array(rid[doc[order][begins]]), pa.array(best), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "best", "total"])


def alignment(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs (doc_id, text).

    a, b: the files of a byte-level tokenizer and of a sentencepiece model, as the driver sees them; their bytes, a few MB,
    are broadcast. Null and empty texts, and texts that the tokens don't give back, have zeros and an empty digest. Rows
    that repeat an id are documents of their own and count as such.
    """
    spark = prepare(docs.sparkSession)
    files = [open(path, "rb").read() for path in (a, b)]
    shared = spark.sparkContext.broadcast(tuple(files))
    count_a = len(Tokenizers(*files).a_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = stored(rows.mapInArrow(partial(_aligned, shared=_Shared(shared)), _ALIGNED), "aligned")
    runs = found.where("radix is not null")

    sums = runs.select("radix", "sums")
    while (most := sums.groupBy("radix").count().agg(F.max("count")).first()[0] or 0) > FAN:
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(-(-most // FAN)))
        dealt = sums.withColumn("salt", salt).repartition("radix", "salt").sortWithinPartitions("radix", "salt")
        sums = stored(dealt.select("radix", "salt", "sums").mapInArrow(_merged_runs, "radix int, sums binary"), "sums")
    pairs = sums.repartition("radix").sortWithinPartitions("radix").mapInArrow(partial(_counted, count_a=count_a), "radix int, seq int, pairs binary")
    pairs = stored(pairs, "pairs")

    # a row for each radix: how many tasks its runs take
    shares = runs.groupBy("radix").agg(F.ceil(F.sum(F.length("records")) / SHARE).cast("int").alias("shares"))
    shares = F.broadcast(stored(shares, "shares"))
    copies = pairs.join(shares, "radix").select("radix", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), "seq", F.col("pairs").alias("data"), F.lit(None).cast("binary").alias("rids"))
    dealt = runs.join(shares, "radix").select("radix", F.pmod(F.xxhash64("records"), F.col("shares")).cast("int").alias("salt"), F.lit(None).cast("int").alias("seq"), F.col("records").alias("data"), "rids")
    met = copies.union(dealt).repartition("radix", "salt").sortWithinPartitions("radix", "salt", F.asc_nulls_last("seq"))
    given = met.mapInArrow(_contributions, "rid long, best long, total long").groupBy("rid").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))
    answers = found.where("radix is null").select(*_NAMES[:7]).join(given, "rid", "left")
    zero = F.lit(0).cast("long")
    return answers.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", zero).alias("n_best"), F.coalesce("total", zero).alias("count_sum"), "groups_sha256"
    )


class _Shared:
    """A broadcast and a number that tells it from others in the same worker."""

    def __init__(self, value) -> None:
        self._value, self.id = value, hashlib.sha256(b"".join(value.value)).hexdigest()

    @property
    def value(self):
        return self._value.value


def op11_token_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"), f"{FOLDER}/byte_bpe_50k.json", f"{FOLDER}/piece_bpe_32k.model")
