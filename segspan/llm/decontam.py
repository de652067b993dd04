"""Benchmark decontamination by a prefix-filtered set join.

A window is 10 consecutive words of a benchmark item, or the whole of a shorter one. Its tokens are
its shingles of 5 words (a shorter window is one shingle). Shingles are ordered by rarity in the
documents; as a window must be contained whole, the necessary prefix is its one rarest shingle.
Documents meet windows on that shingle only; the shingle's place in the window and the document's
length bound where the window can lie, and what remains is verified word by word, byte by byte.

The benchmark is taken in blocks of bounded size, each broadcast; a larger benchmark means more
passes over the documents, not a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesop import chunks, lower_table, shingles, word_hashes, word_table
from .store import small_batches

WINDOW, SHINGLE = 10, 5
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
SPANS = "array<struct<start:bigint,end:bigint>>"


@dataclass
class Windows:
    """Distinct windows of one block, with the items that have them."""

    hashes: list[np.ndarray]
    words: list[list[bytes]]
    items: list[list[str]]

    def tokens(self) -> dict[int, np.ndarray]:
        """All shingles by size."""
        out: dict[int, list[np.ndarray]] = {}
        for h in self.hashes:
            out.setdefault(min(SHINGLE, len(h)), []).append(shingles(h, min(SHINGLE, len(h))))
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


def windows_of(items: list[tuple[str, str]]) -> Windows:
    low, table = lower_table(), word_table("alnum")
    where: dict[tuple[bytes, ...], int] = {}
    out = Windows([], [], [])
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        b = low[data]
        starts, ends, _, h = word_hashes(b, np.array([0, len(b)]), table)
        if not len(h):
            continue
        raw, n = b.tobytes(), min(WINDOW, len(h))
        words = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
        for i in range(len(h) - n + 1):
            key = tuple(words[i : i + n])
            if key not in where:
                where[key] = len(out.words)
                out.hashes.append(h[i : i + n].copy())
                out.words.append(list(key))
                out.items.append([])
            if item not in out.items[where[key]]:
                out.items[where[key]].append(item)
    return out


class Members:
    """Membership and position in a set of 64-bit keys; a bitmap on the low bits spares most searches."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.low = np.uint64((1 << max(16, int(len(self.keys) * 16).bit_length())) - 1)
        self.map = np.zeros(int(self.low) + 1, bool)
        self.map[self.keys & self.low] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in keys) of the values that are keys."""
        near = np.flatnonzero(self.map[h & self.low])
        at = np.searchsorted(self.keys, h[near])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == h[near] if len(self.keys) else np.zeros(0, bool)
        return near[same], at[same]


def _owned(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each word index belongs to."""
    return np.searchsorted(first, at, side="right") - 1


def rarity(docs: DataFrame, text: str, tokens: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often each token of the block occurs in all documents; absent ones are left out."""
    low, table = lower_table(), word_table("alnum")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {k: Members(v) for k, v in tokens.items()}
        counts = {k: np.zeros(len(m.keys), np.int64) for k, m in sets.items()}
        for batch in batches:
            for _, _, b, offsets in chunks(batch.column(0)):
                _, _, first, h = word_hashes(low[b], offsets, table)
                for k, m in sets.items():
                    at, key = m.find(shingles(h, k))
                    whole = at + k <= first[_owned(first, at) + 1]
                    counts[k] += np.bincount(key[whole], minlength=len(m.keys))
        for k, m in sets.items():
            some = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(m.keys[some].view(np.int64)), pa.array(counts[k][some])], names=["size", "token", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "size long, token long, n long")
    rows = found.groupBy("size", "token").agg(F.sum("n").alias("n")).collect()  # bounded by the block's tokens
    return {(r["size"], r["token"] & (1 << 64) - 1): r["n"] for r in rows}


class Prefixes:
    """The necessary prefix token of every window that can occur, and what verifies a candidate."""

    def __init__(self, windows: Windows, rare: dict[tuple[int, int], int]):
        self.items, entries = windows.items, {}
        lens = [len(h) for h in windows.hashes]
        self.length = np.array(lens, np.int64)
        self.begin = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.hash = np.concatenate([*windows.hashes, np.zeros(0, np.uint64)])
        words = [w for ws in windows.words for w in ws]
        self.word_len = np.array([len(w) for w in words], np.int64)
        self.word_at = np.concatenate([[0], np.cumsum(self.word_len)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        for i, h in enumerate(windows.hashes):
            k = min(SHINGLE, len(h))
            order = [(rare.get((k, int(t)), 0), int(t), o) for o, t in enumerate(shingles(h, k))]
            n, token, offset = min(order)
            if n:  # else some part of the window occurs nowhere
                entries.setdefault(k, []).append((token, i, offset))
        self.sizes = {}
        for k, e in entries.items():
            e.sort()
            token = np.array([x[0] for x in e], np.uint64)
            m = Members(token)
            self.sizes[k] = (m, np.searchsorted(token, m.keys), np.searchsorted(token, m.keys, side="right"), np.array([x[1] for x in e]), np.array([x[2] for x in e]))

    def matches(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence in a chunk."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k, (m, lo, hi, window, offset) in self.sizes.items():
            at, key = m.find(shingles(h, k))
            n = hi[key] - lo[key]
            entry = np.repeat(lo[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p, win = np.repeat(at, n), window[entry]
            begin = p - offset[entry]
            text = _owned(first, p)
            ok = (begin >= first[text]) & (begin + self.length[win] <= first[text + 1])
            begin, win = begin[ok], win[ok]
            for j in range(WINDOW):  # word by word; the rest gets fewer each time
                more = j < self.length[win]
                ok = ~more
                x, y = begin[more] + j, self.begin[win[more]] + j
                ok[more] = (h[x] == self.hash[y]) & (ends[x] - starts[x] == self.word_len[y])
                begin, win = begin[ok], win[ok]
            if len(begin):  # and byte by byte
                n = self.length[win]
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x, y = np.repeat(begin, n) + nth, np.repeat(self.begin[win], n) + nth
                size = self.word_len[y]
                nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                same = b[np.repeat(starts[x], size) + nth] == self.bytes[np.repeat(self.word_at[y], size) + nth]
                cut = np.concatenate([[0], np.cumsum(n)])[:-1]
                per_word = np.minimum.reduceat(same, (np.cumsum(size) - size))
                ok = np.minimum.reduceat(per_word, cut)
                begin, win = begin[ok], win[ok]
            found.append((begin, win))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spans(column: pa.Array, index: Prefixes) -> Iterator[tuple[int, list[list[tuple[int, int]]], list[list[str]]]]:
    """For each row: number of words, hit spans (word index, end excluded), items."""
    low, table = lower_table(), word_table("alnum")
    for i, j, data, offsets in chunks(column):
        b = low[data]
        starts, ends, first, h = word_hashes(b, offsets, table)
        begin, win = index.matches(b, starts, ends, first, h)
        spans: list[list[dict]] = [[] for _ in range(j - i)]
        items: list[set[str]] = [set() for _ in range(j - i)]
        if len(begin):
            edge = np.zeros(len(h) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + index.length[win], -1)
            hit = np.cumsum(edge[:-1]) > 0
            before = np.concatenate([[False], hit[:-1]])
            before[first[:-1][first[:-1] < len(h)]] = False  # spans end with their text
            after = np.concatenate([hit[1:], [False]])
            last = first[1:] - 1
            after[last[last >= 0]] = False
            s, e = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
            for t, x, y in zip(_owned(first, s), s, e, strict=True):
                spans[t].append({"start": int(x - first[t]), "end": int(y - first[t])})
            for t, w in set(zip(_owned(first, begin).tolist(), win.tolist(), strict=True)):
                items[t].update(index.items[w])
        yield from zip(np.diff(first).tolist(), spans, [sorted(x) for x in items], strict=True)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("item").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield [(r["item"], r["text"]) for r in part.collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans (word ranges hit, end excluded, disjoint), items (sorted strings) for every row of `docs`.

    Defined cases: null and empty texts have no words; an item without words has no window and hits
    nothing; rows of one item id are all its windows; null item ids are left out; a null doc_id is kept;
    repeated rows each get a row; an empty table on either side gives no hits; other columns are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = []
    for items in _blocks(benchmark, item_id, item_text):
        windows = windows_of(items)
        index = spark.sparkContext.broadcast(Prefixes(windows, rarity(docs, text, windows.tokens()) if windows.hashes else {}))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_spans(batch.column(1), index.value))
                n, spans, found = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(pa.string())), *batch.columns[2:]],
                    names=["doc_id", "n_words", "spans", "items", *batch.schema.names[2:]],
                )

        parts.append(run)
    schema = f"doc_id {kind}, n_words long, spans {SPANS}, items array<string>"
    if len(parts) == 1:
        return texts.mapInArrow(parts[0], schema)
    # More blocks: hits of equal rows are equal, so (doc_id, hash and length of the text) brings them together.
    keyed = texts.withColumn("h", F.xxhash64("text")).withColumn("l", F.octet_length("text"))
    found = [keyed.mapInArrow(run, f"{schema}, h long, l int") for run in parts]
    some = found[0].where(F.size("items") > 0)
    for x in found[1:]:
        some = some.unionByName(x.where(F.size("items") > 0))
    some = some.groupBy("doc_id", "h", "l").agg(F.collect_set("spans").alias("s"), F.collect_set("items").alias("i"))
    some = some.select(F.col("doc_id").alias("d"), F.col("h").alias("h2"), F.col("l").alias("l2"), merged(F.flatten("s")).alias("s"), F.array_sort(F.array_distinct(F.flatten("i"))).alias("i"))
    all_rows = found[0].select("doc_id", "n_words", "h", "l")
    on = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("h2")) & F.col("l").eqNullSafe(F.col("l2"))
    none = F.expr(f"cast(array() as {SPANS})")
    return all_rows.join(some, on, "left").select("doc_id", "n_words", F.coalesce("s", none).alias("spans"), F.coalesce("i", F.expr("cast(array() as array<string>)")).alias("items"))


def merged(spans):
    """Union of ranges as disjoint ranges."""
    return F.aggregate(
        F.array_sort(spans),
        F.expr(f"cast(array() as {SPANS})"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, in which no benchmark window occurs.

    Defined cases: null and empty texts stay; null and empty items hit nothing; repeated rows are judged alike, repeated
    items count once; an empty benchmark keeps all rows; further columns, of any name, are carried along.
    """
    small_batches(docs.sparkSession)
    spark, at, out = docs.sparkSession, docs.columns.index(text), docs
    for items in _blocks(benchmark, "item_id", "text"):
        windows = windows_of(items)
        index = spark.sparkContext.broadcast(Prefixes(windows, rarity(docs, text, windows.tokens()) if windows.hashes else {}))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x[2] for x in _spans(batch.column(at), index.value)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM iw
), dw AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n
), dwin AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM dw
), hit AS (
  SELECT doc_id, p, n, item FROM dwin JOIN win USING (n, s)
), words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
