"""Exact n-gram Jaccard join in the metric space of shingle sets.

The distance 1 - J is a metric, and a link is a distance of at most 0.2. Documents as top-level pivots
would be useless here: nearly all documents lie at distance 1 from each other, so every
triangle-inequality window around them would hold everything. The pivots therefore go from sets of one
shingle to documents:

1. Singleton pivots. Every shingle {s} is a pivot; a set A is at 1 - 1/|A| from the pivots it contains
   and at 1 from all others. Ties go to the rarest pivot (by hashed corpus counts, then by hash), which
   makes Voronoi regions. For sets within the radius the triangle inequality turns into an overlap
   bound, |A & B| >= 4/9 (|A| + |B|), so a set near a border is replicated to the regions of its first
   |A| - ceil(4/5 |A|) + 1 pivots in that order, and of two linked sets the smaller already meets the
   other within its first |A| - ceil(8/9 |A|) + 1.
2. Document pivots. A region is joined at once if it is tiny. Otherwise one member becomes its center and
   all distances to it are computed; regions that chose the same center are one from then on. Members
   within 0.2 of the center are linked to it, hence to each other. Only the rest, with the members close
   enough to them by |d(x, p) - d(y, p)| <= 0.2, recurses. Regions that are still large are dealt into Voronoi
   regions of some of their members, with border members copied as the triangle inequality demands, so they shrink by a
   factor a round. Where they don't shrink, and in small ones, members with many possible partners are pivots; members
   that links of the region already connect are never compared. So a group of n near copies costs some n distances.

A parity sketch of each set (the parities of its members in 2048 hash classes) differs in no more bits than
the sets differ in members. It bounds every distance from below; where that is beyond the radius the bound
stands in for the distance, and the sets stay where they are. Links are verified on the whole sets, which travel as texts. Equal sets are one node from the start.
All joins are merges at every size of the input, which Spark splits at hot keys; a pair's bundle follows from its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .bytesop import chunks, lower_table, mix, shingles, word_hashes, word_table
from .graph import components
from .lots import merged_array, planes
from .store import Scratch

SHINGLE = 5
#: Hashed counts that order the singleton pivots by rarity.
COUNTS_LOG2 = 20
#: Bytes of sets that a bundle holds on one side of its pairs, and of those that stream past one center.
BUNDLE_BYTES, STREAM_BYTES = 16 << 20, 4 << 20
#: Regions of so many sets are joined at once.
SMALL = 16
#: Bits of the parity sketch that bounds symmetric differences from below.
SKETCH_BITS = 2048
#: Document pivots that each cluster of a region gets in a later round, and the most clusters that get some.
PIVOTS, CLUSTERS = 32, 16
#: Members up to which a region's remainder is compared by sketches in one block of memory; copies of a member, on
#: average, that dealing a larger one may make.
BLOCK, COPIES = 4096, 2
#: Set ids that a task remembers to send equal sets once.
SEEN = 1 << 20
#: Regions that the hashed counts say are larger are not gathered in one task; their one center meets them in a join.
HOT = 1 << 20
#: Flags below 4n in a region row: the smaller side's bound holds; hot region.
CORE, HOT_FLAG = 1, 2
#: A pair to measure, and what its region has to know of b: flags, the labels of both, bounds of its distance to the
#: center. Pairs of one `region` are measured together, in `ka` times `kb` bundles by the hashes of a and b.
TODO = "a long, b long, pivot long, m long, ca long, cb long, lo double, hi double, region long, ka long, kb long"
#: A set and its content: the text, or the hashes of its shingles.
CONTENT = "sid long, text string, set binary"
#: A region's possible pairs are measured at once if they are so many a member.
AT_ONCE = 16
#: Bits a key and the most bits of the filter that says which sets are needed, and the bits that each key sets.
FILTER_BITS, FILTER_MOST_LOG2, PROBES = 16, 27, 2


def document_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer than 5 words are one shingle, none are no shingle."""
    low, table = lower_table(), word_table("space")
    for i, j, b, offsets in chunks(column):
        _, _, first, h = word_hashes(low[b], offsets, table)
        all_of = shingles(h, SHINGLE)
        for k in range(j - i):
            lo, hi = int(first[k]), int(first[k + 1])
            if hi - lo >= SHINGLE:
                yield i + k, np.unique(all_of[lo : hi - SHINGLE + 1])
            else:
                yield i + k, shingles(h[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    h = mix(s)
    both = np.array([h.sum()], np.uint64) ^ mix(np.bitwise_xor.reduce(h, keepdims=True))
    return int(mix(both).view(np.int64)[0])


def _levels(counts: np.ndarray) -> np.ndarray:
    """Rarity levels: 0 for what is as rare as hashing makes it look, then by powers of 2."""
    mean = max(1.0, float(counts.mean())) if len(counts) else 1.0
    return np.where(counts > mean + 6 * np.sqrt(mean), np.log2(counts / mean + 1) * 4, 0).astype(np.uint8)


def _sets_pass(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """One row (doc_id, n, sid, sketch) per document, and the hashed shingle counts of the corpus."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks, shift = 64, np.uint64(64 - COUNTS_LOG2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTS_LOG2, np.uint32)
        names = ["doc_id", "n", "sid", "sketch", "block", "data"]
        id_type = pa.int64()
        for batch in batches:
            n, sid = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            pool, held = [], 0
            sketches: list[bytes | None] = [None] * batch.num_rows
            id_type = batch.column(0).type
            for row, s in document_sets(batch.column(1)):
                n[row] = len(s)
                if len(s):
                    sid[row], sketches[row] = set_id(s), sketch(s)
                    pool.append((s >> shift).astype(np.int64))
                    held += len(s)
                    if held > 1 << 18:
                        counts += np.bincount(np.concatenate(pool), minlength=len(counts)).astype(np.uint32)
                        pool, held = [], 0
            if pool:
                counts += np.bincount(np.concatenate(pool), minlength=len(counts)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sid, mask=n == 0), pa.array(sketches, pa.binary()), pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names=names)
        if counts.any():
            data = [planes(x) for x in np.split(counts, blocks)]
            yield pa.RecordBatch.from_arrays([pa.nulls(blocks, id_type), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.int64()), pa.nulls(blocks, pa.binary()), pa.array(np.arange(blocks, dtype=np.int32)), pa.array(data, pa.binary())], names=names)

    both = scratch.put("sets", docs.mapInArrow(run, f"doc_id {kind}, n long, sid long, sketch binary, block int, data binary"))
    counts = merged_array(both.where("block is not null").select("block", "data"), np.add, np.uint32)
    return both.where("block is null").select("doc_id", "n", "sid", "sketch"), counts if len(counts) else np.zeros(1 << COUNTS_LOG2, np.uint32)


def _region_rows(docs: DataFrame, counts: np.ndarray, hot: int) -> DataFrame:
    """(pivot, sid, m): each set in the regions of its first pivots; m is 4n plus flags."""
    level = np.minimum(_levels(counts), 127) | (counts > hot).astype(np.uint8) << 7
    shared = docs.sparkSession.sparkContext.broadcast(level)  # 1 MB
    shift = np.uint64(64 - COUNTS_LOG2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task sends one copy of equal sets
        pivots, sids, ms, held = [], [], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(pivots).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(ms))], names=["pivot", "sid", "m"])
        for batch in batches:
            for _, s in document_sets(batch.column(1)):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                n = len(s)
                far, near = n - -(-4 * n // 5) + 1, n - -(-8 * n // 9) + 1
                # One sortable key: the rarity level above, the mixed hash without its low byte below.
                h, rare = mix(s), shared.value[(s >> shift).astype(np.int64)]
                order = ((rare & 127).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
                first = np.argpartition(order, far - 1)[:far]
                first = first[np.lexsort((h[first], order[first]))]
                pivots.append(h[first])
                sids.append(np.full(far, sid))
                ms.append(4 * n + CORE * (np.arange(far) < near) + HOT_FLAG * (rare[first] > 127))
                held += far
                if held > 1 << 16:
                    yield flush()
                    pivots, sids, ms, held = [], [], [], 0
        if pivots:
            yield flush()

    return docs.mapInArrow(run, "pivot long, sid long, m long")


def _grouped(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal `pivot` from sorted batches; a group may span batches."""
    held: list[pa.RecordBatch] = []

    def parts(table: pa.Table, last: bool) -> tuple[list[dict], pa.Table | None]:
        key = table.column("pivot").to_numpy()
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        if not last:
            rest = table.slice(edge[-2])
            edge = edge[:-1]
        # Regions of one row end here; they are most of all.
        columns = {x: table.column(x).to_numpy() if not pa.types.is_binary(table.schema.field(x).type) else table.column(x) for x in names}
        many = np.flatnonzero(np.diff(edge) > 1)
        out = [{x: c[edge[k] : edge[k + 1]] if isinstance(c, np.ndarray) else c.slice(edge[k], edge[k + 1] - edge[k]) for x, c in columns.items()} for k in many]
        return out, None if last else rest

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.column("pivot")[0] == batch.column("pivot")[-1] and batch.column("pivot")[0] == held[0].column("pivot")[0]:
            continue
        out, rest = parts(pa.Table.from_batches(held), False)
        yield from out
        held = rest.combine_chunks().to_batches()
    if held:
        yield from parts(pa.Table.from_batches(held), True)[0]


def _todo(a, b, pivot, m, ca, cb, lo, hi, region, ka, kb) -> pa.RecordBatch:
    a = a if isinstance(a, pa.Array) else pa.array(a)
    lo, hi = (pa.nulls(len(b), pa.float64()) if x is None else pa.array(x) for x in (lo, hi))
    return pa.RecordBatch.from_arrays([a, *(pa.array(x) for x in (b, pivot, m, ca, cb)), lo, hi, pa.array(region), pa.array(ka), pa.array(kb)], names=[x.split()[0] for x in TODO.split(", ")])


def _bundles(n: np.ndarray) -> int:
    """Parts of a region whose sets have `n` members each: a part of them fits in a bundle."""
    return int(8 * n.sum()) // BUNDLE_BYTES + 1


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1 of the regions: pairs (a, b) to measure. In larger regions a is the center, and the row (pivot, b, m) stays open."""
    cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
    held = 0

    def flush() -> pa.RecordBatch:
        a, b, p, m, region, kb = (np.concatenate(c) for c in cols)
        return _todo(a, b, p, m, a, b, None, None, region, np.ones(len(a), np.int64), kb)

    for g in _grouped(batches, ["pivot", "sid", "m"]):
        sid, at = np.unique(g["sid"], return_index=True)
        if len(sid) < 2:
            continue
        m = g["m"][at]
        n, core = m >> 2, (m & CORE) > 0
        if not core.any():
            continue
        if len(sid) <= SMALL:
            x, y = np.triu_indices(len(sid), 1)
            ok = _can_link(n[x], core[x], n[y], core[y])
            a, b = sid[x[ok]], sid[y[ok]]
            p = m = np.zeros(len(a), np.int64)
            # Small regions with one least set, which has about a fifth of its size of them, are measured together, in as many
            # bundles as may be needed: a pair that several regions find takes the first.
            parts = int(n[0] // 5 + 2) * SMALL * 10 * int(n[0]) // BUNDLE_BYTES + 1
            name = sid[:1].view(np.uint64) + mix(g["pivot"][:1].view(np.uint64) % np.uint64(parts))
            region, kb = np.full(len(a), mix(name).view(np.int64)[0]), np.ones(len(a), np.int64)
        else:  # the center is the smallest set id: the same one in all regions that a group of near copies shares
            a, b = np.full(len(sid) - 1, sid[0]), sid[1:]
            p, m = np.full(len(a), g["pivot"][0]), m[1:]
            region, kb = a, np.full(len(a), int(8 * n.sum()) // STREAM_BYTES + 1)
        for col, v in zip(cols, (a, b, p, m, region, kb), strict=True):
            col.append(v)
        held += len(a)
        if held > 1 << 16:
            yield flush()
            cols, held = [[], [], [], [], [], []], 0
    if held:
        yield flush()


def _can_link(n: np.ndarray, core: np.ndarray, n2: np.ndarray, core2: np.ndarray) -> np.ndarray:
    """Sizes within the radius, and the smaller set in this region by its own bound."""
    return (np.minimum(n, n2) * 5 >= np.maximum(n, n2) * 4) & np.where(n < n2, core, np.where(n == n2, core | core2, core2))


def sketch(s: np.ndarray) -> bytes:
    """The parities of a set's members by hash class."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sketches(column: pa.Array) -> np.ndarray:
    """One row of 64-bit words per sketch."""
    return np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint64).reshape(len(column), -1)


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to (a, b, region, ka, kb, na, nb, sa, sb): a lower bound of the distance, and whether it is within the radius."""
    for batch in batches:
        total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
        differ = np.bitwise_count(_sketches(batch.column("sa")) ^ _sketches(batch.column("sb"))).sum(1).astype(np.int64)
        differ = np.maximum(differ, np.abs(batch.column("na").to_numpy() - batch.column("nb").to_numpy()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("region"), batch.column("ka"), batch.column("kb"), pa.array(2 * differ / (total + differ)), pa.array(9 * differ <= total)], names=["a", "b", "region", "ka", "kb", "lo", "close"])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact overlaps. Rows by bundle: first the sets of its a (sid; text or set), then for each b its set, if it is no a, and its pairs (sid, other).

    Holds the sets of a bundle's a, and one b at a time.
    """
    bundle0, sets, passing = None, {}, (None, None)
    for batch in batches:
        a, b, both, either = [], [], [], []
        keys = list(zip(*(batch.column(k).to_pylist() for k in ("region", "i", "j")), strict=True))
        sid, other, streams, data = batch.column("sid").to_pylist(), batch.column("other").to_pylist(), batch.column("streams").to_pylist(), batch.column("set")
        of_texts = document_sets(batch.column("text").drop_null())
        for k, bundle in enumerate(keys):
            if bundle != bundle0:
                bundle0, sets = bundle, {}
            if other[k] is None:
                one = np.frombuffer(data[k].as_py(), np.uint64) if data[k].is_valid else next(of_texts)[1]
                if streams[k]:
                    passing = sid[k], one
                else:
                    sets[sid[k]] = one
            else:
                x, y = sets[other[k]], passing[1] if passing[0] == sid[k] else sets[sid[k]]
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                a.append(other[k])
                b.append(sid[k])
                both.append(int((y[at] == x).sum()))
                either.append(len(x) + len(y) - both[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, both, either)], names=["a", "b", "both", "either"])


def _bundled(close: DataFrame, content: DataFrame) -> DataFrame:
    """Pairs (a, b, region, ka, kb) with the sets they need, in the order of `_measure`."""
    of = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    pairs = close.select("region", of("a", "ka").alias("i"), of("b", "kb").alias("j"), F.col("b").alias("sid"), F.col("a").alias("other"))
    key = ["region", "i", "j"]
    ends = pairs.select(*key, "sid", F.lit(1).alias("streams")).union(pairs.select(*key, "other", F.lit(0)))
    ends = ends.groupBy("sid", *key).agg(F.min("streams").alias("streams"))
    sets = content.join(ends.hint("merge"), "sid").select(*key, "streams", "sid", F.lit(None).cast("long").alias("other"), "text", "set")
    rows = sets.unionByName(pairs.select(*key, F.lit(1).alias("streams"), "sid", "other", F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("set")))
    return rows.repartition(*[F.col(c) for c in key]).sortWithinPartitions(*key, "streams", "sid", F.col("other").asc_nulls_first())


def _spots(sid: np.ndarray, rep: np.ndarray, size: int) -> np.ndarray:
    """The places of (sid, rep) in a filter of `size` bits, one column a probe."""
    h = mix(sid.view(np.uint64) + mix(rep.view(np.uint64)))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) & np.uint64(size - 1) for k in range(PROBES)], -1).astype(np.int64)


def _in_filter(bits: np.ndarray, sid: np.ndarray, rep: np.ndarray) -> np.ndarray:
    at = _spots(sid, rep, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7)) & 1).all(-1)


def _needed_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """sid, text, set for the sets in `need` (sid, rep), each from the document rep; the filter passes few others.

    A set travels as the text it is of, a fraction of its hashes once compressed, or as hashes where the text is longer.
    """
    reps = need.select(F.lit(0).cast("long").alias("sid"), "rep")  # tells documents to skip before their words are read
    bc = docs.sparkSession.sparkContext.broadcast(_filter_bits(need.select("sid", "rep").union(reps), 2 * need.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            rep = batch.column(0).fill_null(0).to_numpy()
            batch = batch.filter(pa.array(_in_filter(bc.value, np.zeros(len(rep), np.int64), rep)))
            rows, sids, data = [], [], []
            known, texts = batch.column(0).fill_null(0).to_pylist(), batch.column(1)
            for row, s in document_sets(texts):
                if not len(s) or ((sid := set_id(s)), known[row]) in seen:
                    continue
                if _in_filter(bc.value, np.array([sid], np.int64), np.array([known[row]], np.int64))[0]:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((sid, known[row]))
                    rows.append(row)
                    sids.append(sid)
                    data.append(s.tobytes() if s.nbytes < texts[row].as_buffer().size else None)
            own = texts.take(pa.array(rows, pa.int64()))
            sent = pa.array(data, pa.binary())
            own = pa.compute.if_else(sent.is_null(), own, pa.scalar(None, own.type))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), own, sent], names=["sid", "text", "set"])

    found = docs.mapInArrow(run, CONTENT)
    return found.join(need.select("sid").hint("merge"), "sid", "left_semi").dropDuplicates(["sid"])


def _passed(content: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of `content` that a filter over the sids of `need` passes: few others travel."""
    named = need.select("sid", F.lit(0).cast("long").alias("rep"))
    bc = content.sparkSession.sparkContext.broadcast(_filter_bits(named, named.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid = batch.column(0).to_numpy()
            yield batch.filter(pa.array(_in_filter(bc.value, sid, np.zeros(len(sid), np.int64))))

    return content.mapInArrow(run, CONTENT)


def _filter_bits(need: DataFrame, n: int) -> np.ndarray:
    """A bitmap of bounded size over (sid, rep), merged from the tasks' parts."""
    log2 = min(FILTER_MOST_LOG2, max(16, (n * FILTER_BITS).bit_length()))
    size, blocks = 1 << (log2 - 3), 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            rep = np.array([x or 0 for x in batch.column(1).to_pylist()], np.int64)
            at = _spots(batch.column(0).to_numpy(), rep, size * 8).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array([x.tobytes() for x in np.split(bits, blocks)], pa.binary())], names=["block", "data"])

    out = merged_array(need.select("sid", "rep").mapInArrow(run, "block int, data binary"), np.bitwise_or, np.uint8)
    return out if len(out) else np.zeros(size, np.uint8)


def _labels(ca: np.ndarray, cb: np.ndarray, linked: np.ndarray) -> dict[int, int]:
    """New labels where links join old ones."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    for x, y in zip(ca[linked].tolist(), cb[linked].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def _choose(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Pivots for a graph of possible pairs: of each cluster the first few members with at least half the most partners."""
    free, new = np.ones(n, bool), []
    for _ in range(CLUSTERS):
        some = free[x] & free[y]
        degree = np.bincount(np.concatenate([x[some], y[some]]), minlength=n)
        if degree.max() <= AT_ONCE:
            break
        own = np.flatnonzero(degree * 2 >= degree.max())[:PIVOTS]
        new.append(own)
        free[own] = False
        free[y[np.isin(x, own)]] = False
        free[x[np.isin(y, own)]] = False
    return np.concatenate(new)


def _deal(sk: np.ndarray, n: np.ndarray) -> list[np.ndarray] | None:
    """Members of the Voronoi regions of some members, or None if these are hardly smaller.

    The distance is that of sketches. Two sets x, y within the radius differ in at most (n(x) + n(y)) / 9 bits, which is
    n(y) / 4 at most, as neither has over 5/4 of the other. With p the pivot next to x and q the one next to y,
    d(y, p) <= d(x, p) + n(y)/4 <= d(x, q) + n(y)/4 <= d(y, q) + n(y)/2. So y goes to all pivots that are at most n(y)/2
    farther than its own, and meets x at p.
    """
    pivots = np.arange(0, len(sk), -(-len(sk) // PIVOTS))
    d = np.stack([np.bitwise_count(sk ^ sk[p]).sum(1).astype(np.int64) for p in pivots], 1)
    inside = 2 * (d - d.min(1, keepdims=True)) <= n[:, None]
    if inside.sum() > COPIES * len(sk) or 2 * inside.sum(0).max() > len(sk):
        return None
    return [np.flatnonzero(x) for x in inside.T]


def _recurse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Later rounds of the regions. Rows: pivot, sid, m, ca, cb, lo and hi (the distance to the center lies between), inner, sketch.

    Sends pairs to measure; those with a pivot keep the region open. A member without a possible partner
    under another label is done, and so is a pivot, of which all possible pairs are sent. Large regions are dealt into
    smaller ones first: their members go on without a pair.
    """
    for g in _grouped(batches, ["pivot", "sid", "m", "ca", "cb", "lo", "hi", "inner", "sketch"]):
        new_label = _labels(g["ca"], g["cb"], g["inner"].astype(bool))
        sid, at = np.unique(g["sid"], return_index=True)
        m, lo, hi = g["m"][at], g["lo"][at], g["hi"][at]
        n = m >> 2
        label = np.array([new_label.get(x, x) for x in g["cb"][at].tolist()], np.int64)
        if (label == label[0]).all():
            continue
        sk = _sketches(g["sketch"].take(pa.array(at)))

        def near(k: int, y: np.ndarray, n=n, lo=lo, hi=hi, label=label, sk=sk) -> np.ndarray:
            y = y[(label[y] != label[k]) & (np.minimum(n[y], n[k]) * 5 >= np.maximum(n[y], n[k]) * 4)]
            y = y[np.maximum(lo[y], lo[k]) - np.minimum(hi[y], hi[k]) <= 0.2 + 1e-9]
            return y[np.bitwise_count(sk[y] ^ sk[k]).sum(1).astype(np.int64) * 9 <= n[y] + n[k]]

        everyone = np.arange(len(sid))
        if len(sid) <= BLOCK:
            close = [near(k, everyone[k + 1 :]) for k in everyone]
            x, y = np.repeat(everyone, [len(c) for c in close]), np.concatenate(close)
            alive = np.unique(np.concatenate([x, y]))
            if len(x) > AT_ONCE * len(sid):
                new = _choose(x, y, len(sid))
                some = np.isin(x, new) | np.isin(y, new)
                x, y = x[some], y[some]
                flip = ~np.isin(x, new)
                x, y = np.where(flip, y, x), np.where(flip, x, y)
                p = np.where(np.isin(y, new), 0, g["pivot"][0])  # a pair of pivots measures, but keeps neither
                carried = np.setdiff1d(alive, np.concatenate([new, y]))
            else:
                p, carried = np.zeros(len(x), np.int64), everyone[:0]
        elif (parts := _deal(sk, n)) is not None:
            for k, own in enumerate(parts):
                if len(own) > 1:
                    p = np.full(len(own), mix(g["pivot"][:1].view(np.uint64) + mix(np.array([k + 1], np.uint64))).view(np.int64)[0])
                    yield _todo(pa.nulls(len(own), pa.int64()), sid[own], p, m[own], label[own], label[own], lo[own], hi[own], p, *np.ones((2, len(own)), np.int64))
            continue
        else:  # members at even steps are pivots for all, and more of them until there are pairs enough for a round
            rest, chosen, pairs, found = everyone, [], [], 0
            while len(rest) > 1 and found < len(sid):
                chosen.append(rest[:: -(-len(rest) // PIVOTS)])
                pairs += [(k, near(k, rest)) for k in chosen[-1]]
                found = sum(len(c) for _, c in pairs)
                rest = np.setdiff1d(rest, chosen[-1])
            new = np.concatenate(chosen)
            x, y = np.concatenate([np.full(len(c), k) for k, c in pairs]), np.concatenate([c for _, c in pairs])
            p = np.where(np.isin(y, new), 0, g["pivot"][0])
            carried = np.setdiff1d(rest, y)
        if len(x):
            b = np.concatenate([y, carried])
            a = pa.array(np.concatenate([sid[x], np.zeros(len(carried), np.int64)]), mask=np.arange(len(b)) >= len(x))
            p = np.concatenate([p, np.full(len(carried), g["pivot"][0])])
            yield _todo(a, sid[b], p, m[b], np.concatenate([label[x], label[carried]]), label[b], lo[b], hi[b], np.full(len(b), g["pivot"][0]), *np.full((2, len(b)), _bundles(n)))


def _first_round(rows: DataFrame, has_hot: bool, scratch: Scratch) -> DataFrame:
    """Pairs of round 1."""
    if has_hot:
        rows = scratch.put("regions", rows)
    is_hot = F.col("m").bitwiseAND(F.lit(HOT_FLAG).cast("long")) > 0
    cold = rows.where(~is_hot) if has_hot else rows
    first = cold.repartition(F.col("pivot")).sortWithinPartitions("pivot").mapInArrow(_first_pairs, TODO)
    if not has_hot:
        return first
    # Centers are combined before the shuffle; the join's hot keys can be split, as its other side has one row a key.
    hot = rows.where(is_hot)
    k = F.expr(f"8 * sum(m div 4) div {STREAM_BYTES} + 1")
    centers = hot.groupBy("pivot").agg(F.min("sid").alias("a"), k.alias("kb"))
    met = hot.join(centers.hint("merge"), "pivot").where("a <> sid").select("a", F.col("sid").alias("b"), "pivot", "m", "kb").distinct()
    null = F.lit(None).cast("double")
    return first.unionByName(met.select("a", "b", "pivot", "m", F.col("a").alias("ca"), F.col("b").alias("cb"), null.alias("lo"), null.alias("hi"), F.col("a").alias("region"), F.lit(1).cast("long").alias("ka"), "kb"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`.

    Words are runs of other characters than space and 0x09-0x0D after lower-casing A-Z; a document's set
    holds its distinct 5-word shingles, or its one shorter sequence. Documents whose sets have
    100 * |intersection| >= 80 * |union| are linked; component_id is the smallest doc_id within reach.
    Shingles are compared by 64-bit hashes.

    Defined cases: null texts and texts without words have an empty set, are linked with nothing and are
    their own component; equal sets (copies, repeated rows) are linked; a null doc_id takes part and gets
    its component's smallest other id; an empty table gives an empty frame; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets, counts = _sets_pass(texts, scratch)
    todo = scratch.put("pairs-1", _first_round(_region_rows(texts, counts, hot), bool((counts > hot).any()), scratch))
    scratch.drop("regions")
    scratch.free()
    reps = scratch.put("reps", sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    ids = scratch.put("ids", sets.select("doc_id", "n", "sid"))
    scratch.drop("sets")  # its sketches are in `reps`, one of equal ones
    side = lambda x: reps.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    links, content, round_ = None, None, 1
    all_reps = reps
    while not todo.isEmpty():
        if round_ == 2:  # from here on all pairs are of members that are open now
            alive = todo.select(F.col("b").alias("sid")).union(todo.where("a is not null").select("a")).distinct()
            reps = scratch.put("reps-open", all_reps.join(alive.hint("merge"), "sid", "left_semi"))
        # A pair keeps its direction: its first set is the pivot.
        pairs = todo.where("a is not null").groupBy("a", "b").agg(F.min(F.struct("region", "ka", "kb")).alias("r")).select("a", "b", "r.*")
        pairs = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
        bounds = scratch.put(f"bounds-{round_}", pairs.mapInArrow(_bound, "a long, b long, region long, ka long, kb long, lo double, close boolean"))
        close = bounds.where("close").select("a", "b", "region", "ka", "kb")
        if round_ <= 2:  # all later pairs are of members that round 2 leaves open
            ends = close if round_ == 1 else todo.where("a is not null")
            ends = ends.select(F.col("a").alias("sid")).union(ends.select("b"))
            ends = (ends if round_ == 1 else ends.union(todo.select("b"))).distinct()
            need = scratch.put(f"need-{round_}", ends.join(reps.select("sid", "rep").hint("merge"), "sid"))
            content = _needed_sets(texts, need)
            if round_ == 2:  # round 1 sends its sets on as they come
                content = scratch.put("content", content)
            scratch.free()
        ends = close.select(F.col("a").alias("sid")).union(close.select("b")).distinct()
        sets_of = content if round_ == 1 else _passed(content, ends)
        measured = scratch.put(f"measured-{round_}", _bundled(close, sets_of).mapInArrow(_measure, "a long, b long, both long, either long"))
        scratch.free()
        within = F.coalesce(100 * F.col("both") >= 80 * F.col("either"), F.lit(False))
        linked = measured.where(within).select("a", "b")
        links = linked if links is None else links.unionByName(linked)
        exact = 1 - F.col("both") / F.col("either")
        distance = bounds.drop("region", "ka", "kb").join(measured.hint("merge"), ["a", "b"], "left").select("a", "b", F.coalesce(exact, "lo").alias("lo"), F.coalesce(exact, F.lit(1.0)).alias("hi"), within.alias("inner"))
        members = todo.where("pivot <> 0").withColumnsRenamed({"lo": "lo0", "hi": "hi0"}).join(distance.hint("merge"), ["a", "b"], "left")
        members = members.select("pivot", F.col("b").alias("sid"), "m", "ca", "cb", F.coalesce("lo0", "lo").alias("lo"), F.coalesce("hi0", "hi").alias("hi"), F.coalesce("inner", F.lit(False)).alias("inner"))
        if round_ == 1:
            members = members.drop("pivot").withColumn("pivot", F.col("ca")).dropDuplicates(["pivot", "sid"])
            # Regions of one center are one. Those wholly linked to it end; of the linked members only those stay that an unlinked one can be near to.
            least = members.where("not inner").groupBy("pivot").agg(F.min("lo").alias("least"))
            members = members.join(least, "pivot").where((~F.col("inner")) | (F.col("hi") >= F.col("least") - 0.2 - 1e-9)).drop("least")
        open_ = members.join(reps.select("sid", "sketch").hint("merge"), "sid").select("pivot", "sid", "m", "ca", "cb", "lo", "hi", "inner", "sketch")
        round_ += 1
        todo = scratch.put(f"pairs-{round_}", open_.repartition(F.col("pivot")).sortWithinPartitions("pivot").mapInArrow(_recurse, TODO))
        for name in (f"pairs-{round_ - 1}", f"bounds-{round_ - 1}", f"need-{round_ - 1}"):
            scratch.drop(name)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    roots = components(links, scratch).withColumnRenamed("node", "sid")
    labelled = all_reps.select("sid", "rep").join(roots.hint("merge"), "sid", "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    least = labelled.groupBy("root").agg(F.min("rep").alias("component"))
    by_set = labelled.join(least.hint("merge"), "root").select("sid", "component")
    out = ids.join(by_set.hint("merge"), "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return scratch.keep("components", out)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with its columns: of each component the document with the smallest doc_id.

    Equal rows of one doc_id become one; rows that share a doc_id count as one document; rows with a null
    doc_id can't be named and stay.
    """
    found = near_duplicates(docs, text, doc_id)
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__first")).agg(F.count(F.lit(1)).alias("__n"))
    # Ids only on the other side: it is the hashed one, and no text is sorted.
    rows_of = lambda ids: docs.join(ids.hint("shuffle_hash"), docs[doc_id].cast("long") == ids["__first"], "left_semi")
    kept = rows_of(first.where("__n = 1"))
    if not first.where("__n > 1").isEmpty():
        kept = kept.unionByName(rows_of(first.where("__n > 1")).dropDuplicates([doc_id, text]))
    return kept.unionByName(docs.where(docs[doc_id].isNull()))
