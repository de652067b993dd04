"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter keeps one word of language bits in each slot; the AND over an n-gram's
slots is the mask of all languages that contain it. Per-language popcounts over a text's n-grams,
corrected for each filter's false positives, decide.

N-grams are 4 bytes of lower-cased UTF-8 inside one word, with one space as the word's border; a
4-byte n-gram is its own 32-bit key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .bytesop import chunks, mix
from .store import small_batches

UNDETERMINED = "und"


@dataclass(frozen=True)
class Filters:
    """Slots of language bits: bit l of slot i says that some n-gram of language l has slot i. Languages share words of `slots.itemsize` bytes, one row a word."""

    languages: tuple[str, ...]
    slots: np.ndarray
    hashes: int
    false_rate: np.ndarray
    prior: int

    @property
    def bits(self) -> int:
        return 8 * self.slots.itemsize

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """The language bits of each n-gram, one row a word of languages."""
        top = np.uint64(self.slots.shape[-1] - 1)
        h = mix(keys.astype(np.uint64) + np.uint64(1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        out = self.slots[..., h & top]
        for _ in range(self.hashes - 1):
            h = h + step
            out = out & self.slots[..., h & top]
        return out


def ngrams(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): the n-grams of all texts of a chunk, in order, and the range of each text."""
    n = len(offsets) - 1
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    low = t[b]
    if len(b) > 1:  # upper case of the Latin-1 block: 0xC3 0x80-0x9E but for 0x97
        upper = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)
        low[1:][upper] += 32
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    stream = np.full(len(b) + n + 1, 32, np.uint8)  # a space before every text and at the end
    whose = np.zeros(len(stream), np.int32)
    at = np.arange(len(b)) + owner + 1
    stream[at], whose[at] = low, owner
    keep = stream != 32
    keep[1:] |= keep[:-1]  # of white space only the first byte after a word
    keep[0] = True
    stream, whose = stream[keep], whose[keep]
    if len(stream) < 4:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    s = stream.astype(np.uint32)
    keys = (s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]
    inside = (stream[1:-2] != 32) & (stream[2:-1] != 32)
    return keys[inside], np.searchsorted(whose[1:-2][inside], np.arange(n + 1))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = 400, least: int = 3, rival: float = 0.25, slots_log2: int = 18, hashes: int = 4) -> Filters:
    """Learn the filters from labelled rows outside the held-out fold.

    Reads a bounded sample: of each language the rows whose id and text hash lowest, `per_language` in expectation. An n-gram
    enters a language's filter if it occurs `least` times there and its share is at least `rival` times
    its share in any other language. Only these come to the driver, and the sample bounds them. There are at least
    2**`slots_log2` slots, and eight for each n-gram of the largest filter.

    Defined cases: rows without a label or a text teach nothing; any number of languages is learnt; without labelled
    rows the model knows no language.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & ~held_out(F.col(doc_id)))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).collect()}
    key = F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id), F.col(text)), F.lit(1 << 32)) / float(1 << 32)
    # One row a language, as many as the filters have bits a slot.
    shares = docs.sparkSession.createDataFrame([(name, min(1.0, per_language / n)) for name, n in sizes.items()], "l string, share double")
    keyed = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), key.alias("key"))
    sample = keyed.join(F.broadcast(shares), F.col("lang") == F.col("l")).where("key < share").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j, b, offsets in chunks(batch.column(0)):
                keys, bounds = ngrams(b, offsets)
                for one in set(langs[i:j]):
                    own = np.flatnonzero(langs[i:j] == one)
                    u, n = np.unique(np.concatenate([keys[bounds[x] : bounds[x + 1]] for x in own]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([one] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("lang"))).withColumn("most", F.max("share").over(W.partitionBy("gram")))
    grams = grams.where((F.col("n") >= least) & (F.col("share") >= rival * F.col("most")))
    rows = grams.groupBy("lang").agg(F.collect_list("gram").alias("grams")).orderBy("lang").collect()

    languages = tuple(r["lang"] for r in rows)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    bits = 8 * np.dtype(kind).itemsize
    slots = 1 << max(slots_log2, (8 * max((len(r["grams"]) for r in rows), default=1) - 1).bit_length())
    model = Filters(languages, np.zeros((-(-len(languages) // bits), slots), kind), hashes, np.zeros(len(languages)), int(np.argmax([sizes[x] for x in languages])) if rows else -1)
    top = np.uint64(slots - 1)
    for k, r in enumerate(rows):
        own, bit = model.slots[k // bits], kind(k % bits)
        h = mix(np.array(r["grams"], dtype=np.uint64) + np.uint64(1))
        step = (h >> np.uint64(32)) | np.uint64(1)
        for _ in range(hashes):
            own[h & top] |= kind(1) << bit
            h = h + step
        model.false_rate[k] = np.mean((own >> bit) & kind(1)) ** hashes
    return model


def predict(model: Filters, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, number of n-grams) of every text of an Arrow column."""
    langs: list[str] = []
    scores, sizes = np.zeros(len(column)), np.zeros(len(column), np.int64)
    letters = np.zeros(256, bool)
    letters[65:91] = letters[97:123] = True
    kind = model.slots.dtype.type
    for i, j, b, offsets in chunks(column):
        keys, bounds = ngrams(b, offsets)
        masks, n = model.masks(keys), np.diff(bounds)
        sizes[i:j] = n
        counts = np.zeros((len(model.languages), j - i))
        for k, rate in enumerate(model.false_rate):
            hit = np.concatenate([[0], np.cumsum((masks[k // model.bits] >> kind(k % model.bits)) & kind(1), dtype=np.int64)])
            counts[k] = np.maximum(0, (hit[bounds[1:]] - hit[bounds[:-1]] - n * rate) / (1 - rate))
        ascii_letters = np.concatenate([[0], np.cumsum(letters[b], dtype=np.int64)])
        has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        best = counts.argmax(0) if len(model.languages) else np.full(j - i, -1)
        for x in range(j - i):
            if not has[x] and not any(c.isalpha() for c in (column[i + x].as_py() or "")):
                langs.append(UNDETERMINED)
            elif best[x] < 0:
                langs.append(UNDETERMINED)
            elif counts[best[x], x] > 0:
                langs.append(model.languages[best[x]])
                scores[i + x] = min(1.0, counts[best[x], x] / n[x])
            else:
                langs.append(model.languages[model.prior])
    return langs, scores, sizes


def identify(docs: DataFrame, model: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`, from its whole text alone.

    `score` is the share of the text's n-grams that the language has, false positives taken off.

    Defined cases: a null text, or one without a letter, is `und` with score 0; letters without a known
    n-gram give the language with most labelled rows, with score 0; equal counts give the first
    language in code-point order; without labelled rows all is `und`; repeated rows each get a row; an
    empty table gives an empty frame; other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, _ = predict(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, model: Filters, least: float, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that have letters and a score of at least `least`.

    A text too short for a single n-gram can't be judged and stays.

    Defined cases: null texts and texts without letters go; repeated rows are judged alike; an empty table stays empty;
    other columns, of any name, are carried along.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = zip(*predict(model, batch.column(at)), strict=True)
            yield batch.filter(pa.array([a != UNDETERMINED and (s >= least or not n) for a, s, n in judged], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
