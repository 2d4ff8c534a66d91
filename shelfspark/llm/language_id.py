"""Language identification with a bit-sliced Bloom filter over character trigrams.

Training counts every trigram of every learned text. A trigram belongs to a language's profile if it makes up at least
`MIN_SHARE` of that language's trigrams, so a profile has 1 / MIN_SHARE entries at most, whatever the corpus. All profiles
share one filter: each cell holds a bitmask with one bit per language, and the masks of a trigram's cells, and-ed, are
the languages that contain it. A document's hits per language are popcounts over its trigrams; each is corrected for the
language's own false-positive rate before the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shelfspark.llm.common import prepare, stored, table

MIN_SHARE = 2e-5
CELLS = 1 << 20
HASHES = 4
#: The filter is broadcast: its size is CELLS * ceil(languages / 64) * 8 bytes.
MAX_LANGUAGES = 512
UNKNOWN = "und"
#: Trigram tables that training keeps in memory before it hands them to the shuffle.
FLUSH = 1 << 21
#: Characters handled at a time; longer texts go in pieces that overlap by a trigram.
PIECE = 1 << 20

_SPACE = np.uint32(32)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """One flag per code point, made once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _spaced(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of anything else is one space; a space on either side."""
    codes = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, _SPACE)[keep]


def trigrams(text: str | None) -> Iterator[np.ndarray]:
    """Packed trigrams (21 bits a character) within words and across their edges, in pieces of bounded size."""
    text = text or ""
    for i in range(0, max(1, len(text)), PIECE):
        # a piece starts two characters early, so no trigram between two pieces is lost
        c = _spaced(text[max(0, i - 2) : i + PIECE]).astype(np.uint64)
        if len(c) >= 3:
            middle = c[1:-1] != 32
            yield ((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[middle]


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the partition, merged per batch."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

    def drained():
        for lang, parts in held.items():
            keys, n = merge(parts)
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        fresh: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for piece in trigrams(text):
                fresh.setdefault(lang, []).append(piece)
                if len(piece) > PIECE // 2:  # a long text is merged at once
                    held.setdefault(lang, []).append(np.unique(fresh[lang].pop(), return_counts=True))
        for lang, pieces in fresh.items():
            if pieces:
                held.setdefault(lang, []).append(np.unique(np.concatenate(pieces), return_counts=True))
        for lang, parts in held.items():
            if len(parts) >= 16:
                held[lang] = [merge(parts)]
        if sum(len(k) for parts in held.values() for k, _ in parts) > FLUSH:
            yield from drained()
    yield from drained()


def _cells(grams: np.ndarray) -> np.ndarray:
    """HASHES cells of every trigram, one row per hash: double hashing over two mixed words."""
    x = grams.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        return np.stack([((a + np.uint64(i) * b) & np.uint64(CELLS - 1)).astype(np.int64) for i in range(HASHES)])


@dataclass
class LanguageFilter:
    """langs in order; slices[w] holds the cells' masks for languages 64w to 64w + 63; rates: false positives."""

    langs: list[str]
    slices: np.ndarray
    rates: np.ndarray

    @classmethod
    def build(cls, profiles: dict[str, np.ndarray]) -> LanguageFilter:
        langs = sorted(profiles)
        slices = np.zeros(((len(langs) + 63) // 64 or 1, CELLS), np.uint64)
        rates = np.zeros(len(langs))
        for k, lang in enumerate(langs):
            bit = np.uint64(1) << np.uint64(k % 64)
            slices[k // 64][_cells(profiles[lang]).ravel()] |= bit
            rates[k] = np.mean((slices[k // 64] & bit) != 0) ** HASHES
        return cls(langs, slices, rates)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Per language, how many of the trigrams the filter holds."""
        cells, out = _cells(grams), np.zeros(len(self.langs), np.int64)
        for w, masks in enumerate(self.slices):
            found = masks[cells[0]]
            for row in cells[1:]:
                found &= masks[row]
            for k in range(64 * w, min(64 * w + 64, len(self.langs))):
                out[k] = np.count_nonzero(found & (np.uint64(1) << np.uint64(k % 64)))
        return out

    def judge(self, text: str | None) -> tuple[str, float]:
        """(language, score): the largest corrected share of trigrams, ties to the smaller name."""
        if not self.langs or not _has_letter(text):
            return UNKNOWN, 0.0
        n, hits = 0, np.zeros(len(self.langs), np.int64)
        for grams in trigrams(text):
            n += len(grams)
            hits += self.hits(grams)
        true = np.clip((hits - n * self.rates) / np.maximum(1 - self.rates, 1e-9) / max(n, 1), 0, 1)
        best = int(np.argmax(true))
        return self.langs[best], float(true[best])


def learn(docs: DataFrame) -> LanguageFilter:
    """The filter of all rows of (text, lang); rows whose lang is null teach nothing.

    The driver receives the profiles alone: MAX_LANGUAGES / MIN_SHARE trigrams at most. More languages are refused, since
    the broadcast would have no bound.
    """
    counts = docs.where("lang is not null").select(F.coalesce("text", F.lit("")).alias("text"), "lang")
    grams = counts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = stored(grams, "trigrams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = [r.lang for r in totals.select("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    kept = grams.join(totals, "lang").where(F.col("n") >= F.col("total") * MIN_SHARE)
    profiles = {lang: [] for lang in langs}
    for r in kept.select("lang", "gram").toLocalIterator():
        profiles[r.lang].append(r.gram)
    return LanguageFilter.build({k: np.array(v, np.int64).view(np.uint64) for k, v in profiles.items()})


def predicted(docs: DataFrame, model: LanguageFilter, keep: list[Column], text: str = "text") -> DataFrame:
    """`keep`, lang_pred and score of every row; null texts and texts without a letter are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep, F.col(text).alias("_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.judge(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(judge, StructType([*kept.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def split(docs: DataFrame) -> Column:
    """crc32 of the id as text, modulo 4; null without an id."""
    return F.crc32(F.col("doc_id").cast("string")) % 4


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    The rows whose remainder is 0, 1 or 3 teach; a row without an id teaches nothing and isn't held out. Only the text is
    an input of a prediction. Repeated rows stay, and each teaches.
    """
    prepare(docs.sparkSession)
    model = learn(docs.where(split(docs) != 2).select("text", F.col("lang").cast("string").alias("lang")))
    return predicted(docs, model, [F.col("doc_id"), F.coalesce(split(docs) == 2, F.lit(False)).alias("held_out")])


#: A text that reaches less than this share of what its language's own texts usually reach is in no learned language.
MIN_SCORE = 0.3


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known: lang_pred isn't `und` and the score is MIN_SCORE of the language's or more.

    A language's score is the median of the documents that are labelled with it and recognised: a profile holds the frequent
    trigrams alone, so how much of a clean text it covers depends on the script and on the size of the corpus. Where no
    row has a label, nothing can be learned, and the documents that have letters stay. Columns stay.
    """
    prepare(docs.sparkSession)
    label = F.col("lang").cast("string")
    model = learn(docs.select("text", label.alias("lang")))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = stored(predicted(docs, model, [row, label.alias("label")]), "judged")
    own = judged.where(F.col("label") == F.col("lang_pred")).groupBy("lang_pred").agg(F.percentile_approx("score", 0.5).alias("usual"))
    rated = judged.where(F.col("lang_pred") != UNKNOWN).join(F.broadcast(own), "lang_pred", "left")
    return rated.where(F.col("score") >= MIN_SCORE * F.coalesce("usual", F.lit(1.0))).select("row.*")


def op3_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
