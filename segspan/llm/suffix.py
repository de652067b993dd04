"""Suffix-array dedup: distributed prefix doubling on the bytes of all texts.

A name is the rank of a substring: equal substrings have equal names, and the name of a doubled
substring comes from the names of its two halves (here both are 64-bit polynomial hashes, which
compose in the same way and need no sort to be agreed on). Spark sorts (name, document, position) at
growing lengths, drops what is unique and ranks the rest again, until the threshold is passed.

Sorting every byte position would shuffle some 30 times the input at each length. So the first length
ranks a sample that no repeat can miss: of the 20-byte names that start in each 50-byte window only the
smallest. Each sampled position stands for the run of windows that it is the smallest of.

1. Length 20, sampled positions: a name without a second document ends all its windows.
2. Whole runs (50 to 80 bytes): a run that a smaller document has too is removed whole.
3. Length 50, single windows: only runs of one 20-byte name that differ, which is where repeats begin
   and end, are taken apart. Equal windows have equal smallest names, so the runs of one 20-byte name
   are ranked where they meet; only names with very many runs send their windows through one more sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytesop import CHUNK_BYTES, chunks, mix, powers, prefix_hash, range_hash
from .store import Scratch

#: The threshold, and the length of the sampled names.
WINDOW, SEED = 50, 20
#: Rows that a task ranks among themselves before the shuffle.
LOCAL_ROWS = 1 << 18
#: Runs of one seed up to which their windows are ranked where the runs meet.
MEET = 1 << 16
RANGE = np.dtype([("start", "<i8"), ("size", "<i4"), ("name", "<u8"), ("seed", "<u8")])
RUNS = "seed long, doc long, start long, run binary"


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each text, bytes before it in its row); very long texts come in pieces that overlap by 49 bytes."""
    for i, j, b, offsets in chunks(column):
        if len(b) <= 2 * CHUNK_BYTES:
            yield b, offsets, np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for at in range(0, len(b), CHUNK_BYTES):
                one = b[at : at + CHUNK_BYTES + WINDOW - 1]
                yield one, np.array([0, len(one)]), np.array([i]), np.array([at])


def runs(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size, seed name, run name): all windows of all texts, gathered by their smallest seed."""
    none = np.zeros(0, np.int64)
    n = len(b) - WINDOW + 1
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    h, (_, down) = prefix_hash(b), powers(len(b))
    seeds = mix((h[SEED:] - h[:-SEED]) * down[: len(b) - SEED + 1])
    place = np.uint64((1 << int(len(b)).bit_length()) - 1)
    v = (seeds & ~place) | np.arange(len(seeds), dtype=np.uint64)  # ties go to the left
    width = WINDOW - SEED + 1
    step = 1
    while step * 2 <= width:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if step < width:
        v = np.minimum(v[:n], v[width - step : width - step + n])
    at = (v[:n] & place).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    q = np.flatnonzero(np.arange(n) + WINDOW <= offsets[1:][owner])
    if not len(q):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at, owner = at[q], owner[q]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(q)]]) - 1
    lo, hi = q[first], q[last] + WINDOW
    return owner[first], lo, hi - lo, seeds[at[first]], range_hash(h, lo, hi)


def _local(doc: np.ndarray, start: np.ndarray, size: np.ndarray, seed: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """Rows to sort. Of equal names a task sends one row, of its smallest document; the others, removed for certain, ride along."""
    order = np.lexsort((start, doc, name))
    doc, start, size, seed, name = doc[order], start[order], size[order], seed[order], name[order]
    new = np.concatenate([[True], name[1:] != name[:-1]])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least = doc[first][run]
    own, later = doc == least, doc > least
    sent = np.flatnonzero(own)
    more: list[bytes | None] = [None] * len(sent)
    if later.any():
        head = np.searchsorted(sent, first)  # a run's first row is always sent
        where = np.flatnonzero(later)
        cut = np.flatnonzero(np.concatenate([[True], run[where][1:] != run[where][:-1]]))
        packed = np.rec.fromarrays([doc[where], start[where]], dtype=[("doc", "<i8"), ("start", "<i8")])
        for a, z in zip(cut, np.concatenate([cut[1:], [len(where)]]), strict=True):
            more[head[run[where[a]]]] = packed[a:z].tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array(seed[sent].view(np.int64)), pa.array(name[sent].view(np.int64)), pa.array(doc[sent]), pa.array(start[sent]), pa.array(size[sent].astype(np.int32)), pa.array(more, pa.binary())],
        names=["seed", "name", "doc", "start", "size", "more"],
    )


ROWS = "seed long, name long, doc long, start long, size int, more binary"
RANKED = "seed long, doc long, start long, size int, name long, open boolean"


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    count = 0
    for batch in batches:
        ids, known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        for b, offsets, row, before in pieces(batch.column(1)):
            text, start, size, seed, name = runs(b, offsets)
            ok = known[row[text]]
            held.append(tuple(x[ok] for x in (ids[row[text]], start - offsets[text] + before[text], size, seed, name)))
            count += len(text)
            if count > LOCAL_ROWS:
                yield _local(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count = [], 0
    if count:
        yield _local(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _ranges(seed, doc, start, size, name, opened) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (seed, doc, start, size.astype(np.int32), name, opened)], names=["seed", "doc", "start", "size", "name", "open"])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (seed, name, doc): closed ranges, which go, and open runs of seeds with several names.

    Works through groups of any size; between batches it holds the rows of one document at most.
    """
    seed0 = name0 = least0 = None
    several = False  # the seed at the border has had several names
    wait: list[tuple] = []  # rows of its only name; they open if a second name comes

    def out(seed, doc, start, size, name, opened: bool) -> pa.RecordBatch:
        return _ranges(seed, doc, start, size, name, np.full(len(doc), opened))

    for batch in batches:
        if not batch.num_rows:
            continue
        seed, name, doc, start, size = (batch.column(k).to_numpy() for k in range(5))
        new_seed = np.concatenate([[seed[0] != seed0], seed[1:] != seed[:-1]])
        new_name = new_seed | np.concatenate([[name[0] != name0], name[1:] != name[:-1]])
        # The smallest document of each name is the one of its first row.
        first = np.flatnonzero(new_name)
        group = np.cumsum(new_name)
        least = np.concatenate([[least0 if least0 is not None else 0], doc[first]])[group]
        gone = doc > least
        yield out(seed[gone], doc[gone], start[gone], size[gone], name[gone], False)
        more = batch.column(5)
        waiting, held = [], 0
        for k in np.flatnonzero(more.is_valid().to_numpy(zero_copy_only=False)).tolist():
            x = np.frombuffer(more[k].as_buffer(), [("doc", "<i8"), ("start", "<i8")])
            waiting.append((np.full(len(x), k), x["doc"], x["start"]))
            held += len(x)
            if held >= LOCAL_ROWS:
                k, d, s = (np.concatenate(x) for x in zip(*waiting, strict=True))
                yield out(seed[k], d, s, size[k], name[k], False)
                waiting, held = [], 0
        if waiting:
            k, d, s = (np.concatenate(x) for x in zip(*waiting, strict=True))
            yield out(seed[k], d, s, size[k], name[k], False)
        # Runs of the smallest documents open where their seed has several names.
        keep = np.flatnonzero(~gone)
        part = np.cumsum(new_seed)  # 0 goes on with the last batch's seed
        mult = np.bincount(part, weights=new_name, minlength=part[-1] + 1) > 1
        if new_seed[0]:
            wait = []
        else:
            mult[0] = several or bool(new_name[part == 0].any())
            if mult[0] and wait:
                yield out(*(np.concatenate(x) for x in zip(*wait, strict=True)), True)
                wait = []
        opens = keep[mult[part[keep]]]
        yield out(seed[opens], doc[opens], start[opens], size[opens], name[opens], True)
        if part[-1]:
            wait = []
        several = bool(mult[part[-1]])
        if not several:
            tail = keep[part[keep] == part[-1]]
            wait.append((seed[tail], doc[tail], start[tail], size[tail], name[tail]))
        seed0, name0, least0 = seed[-1], name[-1], least[-1]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document from rows sorted by document: its ranges, as bytes."""
    doc0, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column("doc").to_numpy()
        rows = np.rec.fromarrays([batch.column("start").to_numpy(), batch.column("size").to_numpy(), batch.column("name").to_numpy().view(np.uint64), batch.column("seed").to_numpy().view(np.uint64)], dtype=RANGE)
        edge = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]])
        docs, data = [], []
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            if doc[a] != doc0:
                if held:
                    docs.append(doc0)
                    data.append(b"".join(held))
                doc0, held = int(doc[a]), []
            held.append(rows[a:z].tobytes())
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(data, pa.binary())], names=["doc", "ranges"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([doc0], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["doc", "ranges"])


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "start", "size", "name", "seed").repartition(F.col("doc")).sortWithinPartitions("doc", "start").mapInArrow(_pack, "doc long, ranges binary")


def _own(b: np.ndarray, offsets: np.ndarray, column: pa.Array, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, starts, ends, seeds) of the ranges that are really in the text: rows that share a doc_id have their ranges mixed."""
    h = None
    for k in range(len(offsets) - 1):
        if column[i + k].is_valid:
            x = np.frombuffer(column[i + k].as_buffer(), RANGE)
            h = prefix_hash(b) if h is None else h
            s = x["start"] + offsets[k]
            e = s + x["size"]
            ok = e <= offsets[k + 1]
            s, e, x = s[ok], e[ok], x[ok]
            ok = range_hash(h, s, e) == x["name"]
            yield k, s[ok], e[ok], x["seed"][ok]


def _open_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the open runs of each text."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, _, b, offsets in chunks(batch.column(1)):
            for k, s, e, seed in _own(b, offsets, batch.column(2), i):
                if len(s):
                    raw = b[offsets[k] : offsets[k + 1]].tobytes()
                    at = s - offsets[k]
                    run = [raw[x:y] for x, y in zip(at.tolist(), (e - offsets[k]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(np.full(len(s), ids[i + k])), pa.array(at), pa.array(run, pa.binary())], names=["seed", "doc", "start", "run"])


def _window_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, name) of each window of the table's runs."""
    run = table.column("run").combine_chunks()
    run = run.chunk(0) if isinstance(run, pa.ChunkedArray) else run
    none = np.zeros(0, np.int64)
    found = [(none, none, none)]
    doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy()
    for i, j, b, offsets in chunks(run):
        n = np.diff(offsets) - WINDOW + 1
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(offsets[:-1], n) + nth
        found.append((np.repeat(doc[i:j], n), np.repeat(start[i:j], n) + nth, range_hash(prefix_hash(b), q, q + WINDOW).view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _apart(meet: int):
    """From runs sorted by seed: windows that a smaller document has too are closed; those of seeds with more than `meet` runs are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, hot = 0, None

        def ranked() -> pa.RecordBatch:
            doc, start, name = _window_rows(pa.Table.from_batches(held))
            order = np.lexsort((doc, name))
            doc, start, name = doc[order], start[order], name[order]
            new = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.zeros(0, bool)
            gone = doc > doc[new][np.cumsum(new) - 1]
            return closed(doc[gone], start[gone], name[gone], False)

        def closed(doc, start, name, opened: bool) -> pa.RecordBatch:
            return _ranges(name, doc, start, np.full(len(doc), WINDOW), name, np.full(len(doc), opened))

        for batch in batches:
            while batch.num_rows:
                seed = batch.column(0).to_numpy()
                cut = int(np.searchsorted(seed != seed[0], True)) if seed[-1] != seed[0] else len(seed)  # the first seed's rows
                if seed[0] == hot:
                    yield closed(*_window_rows(pa.Table.from_batches([batch.slice(0, cut)])), True)
                    batch = batch.slice(cut)
                    continue
                last = int(np.searchsorted(seed == seed[-1], True))  # where the last seed begins
                if held and count >= meet and held[-1].column(0)[-1].as_py() != seed[0]:
                    yield ranked()
                    held, count = [], 0
                if last and count + last <= 4 * meet:
                    held.append(batch.slice(0, last))
                    count += last
                    batch = batch.slice(last)
                    if count >= meet:
                        yield ranked()
                        held, count = [], 0
                    continue
                held.append(batch.slice(0, cut))
                count += cut
                own = sum(int((x.column(0).to_numpy() == seed[0]).sum()) for x in held)
                if own > meet:
                    mine = [x.filter(pa.array(x.column(0).to_numpy() == seed[0])) for x in held]
                    held = [y for x in held if (y := x.filter(pa.array(x.column(0).to_numpy() != seed[0]))).num_rows]
                    if held:
                        yield ranked()
                    held, count, hot = [], 0, seed[0]
                    for x in mine:
                        if x.num_rows:
                            yield closed(*_window_rows(pa.Table.from_batches([x])), True)
                batch = batch.slice(cut)
        if held:
            yield ranked()

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = [batch.column(k).to_numpy() for k in range(4)]
            yield _local(x[0], x[1], x[2], x[3].view(np.uint64), x[3].view(np.uint64))


def repeated_ranges(docs: DataFrame, scratch: Scratch, meet: int = MEET) -> DataFrame:
    """seed, doc, start, size, name: byte ranges that go; their union, by document, is what the dedup removes. Reads doc_id and text."""
    sort = lambda rows: rows.repartition(F.col("seed")).sortWithinPartitions("seed", "name", "doc", "start").mapInArrow(_ranked, RANKED)
    ranked = scratch.put("ranked", sort(docs.mapInArrow(_sampled, ROWS)))
    scratch.free()
    opened = _by_document(ranked.where("open"))
    met = docs.join(opened, docs["doc_id"] == opened["doc"]).select("doc_id", "text", "ranges").mapInArrow(_open_runs, RUNS)
    apart = scratch.put("apart", met.repartition(F.col("seed")).sortWithinPartitions("seed").mapInArrow(_apart(meet), RANKED))
    scratch.free()
    many = scratch.put("many", sort(apart.where("open").select("doc", "start", "size", "name").mapInArrow(_again, ROWS)).where("not open"))
    return ranked.where("not open").drop("open").unionByName(apart.where("not open").drop("open")).unionByName(many.drop("open"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        n_bytes, n_removed, n_spans, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
        for i, j, b, offsets in chunks(batch.column(1)):
            n_bytes[i:j] = np.diff(offsets)
            cut = {k: (s, e) for k, s, e, _ in _own(b, offsets, batch.column(2), i)}
            for k in range(j - i):
                one = b[offsets[k] : offsets[k + 1]]
                if k in cut and len(cut[k][0]):
                    gone = removed_mask(len(one), cut[k][0] - offsets[k], cut[k][1] - offsets[k])
                    n_removed[i + k] = gone.sum()
                    n_spans[i + k] = gone[0] + (gone[1:] & ~gone[:-1]).sum()
                    one = one[~gone]
                sha[i + k] = hashlib.sha256(one.tobytes()).hexdigest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_removed), pa.array(n_spans), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", meet: int = MEET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of `docs`.

    Removed is each byte inside a 50-byte string that also starts in a document with a smaller doc_id.
    Strings are compared by 64-bit hashes, and a range is applied only where the text has its hash.

    Defined cases: null and empty texts have 0 bytes and keep nothing (the hash of no bytes); texts under
    50 bytes are kept; rows of one doc_id never remove from one another; rows with a null doc_id are kept
    whole and remove nothing; an empty table gives an empty frame; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranges = scratch.keep("ranges", _by_document(repeated_ranges(texts, scratch, meet)))
    both = texts.join(ranges, texts["doc_id"] == ranges["doc"], "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
