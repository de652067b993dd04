"""Prefix trie of conversations: which ones begin alike, and what sharing their prefixes saves.

A node is a distinct sequence of first turns. Nodes are never built level by level:

1. Every turn gets the polynomial rolling fingerprint of the conversation up to it, from numpy scans over turns in
   order. Scans run in blocks of turns, and only conversations of several blocks need their blocks' sums.
2. Turns of one depth and fingerprint are a candidate node. Its least (parent, role, text) is its representative, and
   the node is verified if its greatest is the same: both come from one aggregate that is combined before the shuffle.
   By induction over the depth, verified nodes are equal turn by turn. Groups that are not equal are split, and so is
   all that lies below them.
3. Sums over subtrees need no levels either. Once a conversation is the smallest member of a node, it is the smallest
   on its whole way down. So every node belongs to one conversation, and a subtree holds all nodes of its members but
   those that its smallest member owns above it: one sum over members less one running sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .bytesop import _MIX1, _MIX2, _P, chunks, mix, powers, prefix_hash, range_hash
from .store import Scratch

#: Turns (by their order) that are scanned together, and conversation ids whose decimals make one piece of a digest.
BLOCK_LOG2, IDS_LOG2 = 12, 12
#: Fixed values of the rebuilt test conversations: the families share a first conversation; h is a remainder of this.
FAMILY, HEADS = 100, 6
NODE = ["d", "fp", "path"]


def numbered(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, k (place of the turn, from 0), role, text. Ties of a turn stand by role, then text.

    Turns are dealt by ranges of their whole order, so a long conversation spans tasks. Only conversations that do
    need a correction, and there are no more of them than borders between tasks: those few rows are broadcast.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(conv)), -1))
            i = np.arange(len(conv)) - first
            i[first < 0] = count + np.arange((first < 0).sum())
            last, count = conv[-1], int(i[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i), batch.column(2), batch.column(3)], names=["conv_id", "part", "i", "role", "text"])

    rows = turns.select("conv_id", "turn", "role", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    kind = "conv_id long, part int, i long, role string, text string"
    placed = scratch.put("placed", rows.select("conv_id", F.spark_partition_id().alias("part"), "role", "text").mapInArrow(place, kind))
    pieces = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    several = pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("pieces")).where("pieces > 1")
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = pieces.join(several, "conv_id", "left_semi").select("conv_id", "part", before.alias("base"))
    return placed.join(F.broadcast(base), ["conv_id", "part"], "left").select("conv_id", (F.col("i") + F.coalesce("base", F.lit(0))).alias("k"), "role", "text")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations that begin like another: the first h turns of the first one of their hundred, then their own from the h-th on.

    h is the CRC-32 of the decimal id modulo 6. Null roles and texts become empty; rows without a conv_id belong to no
    conversation.
    """
    scratch = Scratch(conversations.sparkSession, "rebuilt")
    clean = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    turns = numbered(clean, scratch)
    ids = scratch.put("ids", turns.select("conv_id").distinct())
    heads: Column = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = turns.where(F.col("k") >= heads).select("conv_id", (F.col("k") - heads + HEADS).alias("ord"), "role", "text")
    first = turns.where((F.col("k") < HEADS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("host"), F.col("k").alias("ord"), "role", "text")
    takes = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("host"), heads.alias("h"))
    shared = takes.join(first, "host").where(F.col("ord") < F.col("h")).select("conv_id", "ord", "role", "text")
    return own.unionByName(shared), ids


def text_hashes(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), np.uint64)
    for i, j, b, offsets in chunks(column):
        out[i:j] = range_hash(prefix_hash(b), offsets[:-1], offsets[1:])
    return out


def fingerprint(raw: np.ndarray, depth: np.ndarray, bits: int) -> np.ndarray:
    """Of prefix sums; the root, of depth 0, has 0."""
    f = mix(raw + depth.astype(np.uint64) * _MIX2) >> np.uint64(64 - bits)
    return np.where(depth > 0, f, np.uint64(0)).view(np.int64)


SCANNED = "conv_id long, block long, d long, sum long, fp long, pfp long, role string, text string"


def _scan(bits: int):
    """Rows in order of (conv_id, block, ord): depth within the block, sum of turn hashes times powers of the base, and, as in the first block, fingerprints of the turn and of what is before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = None, 0, np.uint64(0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            turn = mix(text_hashes(batch.column(2)) * _MIX1 + text_hashes(batch.column(3)))
            new = np.concatenate([[(conv[0], block[0]) != last], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            i = np.arange(n) - first
            i[first < 0] = count + np.arange((first < 0).sum())
            part = turn * powers(int(i.max()) + 1)[0][i]
            s = np.cumsum(part, dtype=np.uint64)
            s -= np.where(first > 0, s[np.maximum(first - 1, 0)], np.uint64(0))
            s[first < 0] += total
            last, count, total = (conv[-1], block[-1]), int(i[-1]) + 1, s[-1]
            fp, pfp = fingerprint(s, i + 1, bits), fingerprint(s - part, i, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i + 1), pa.array(s.view(np.int64)), pa.array(fp), pa.array(pfp), batch.column(2), batch.column(3)], names=[x.split()[0] for x in SCANNED.split(", ")])

    return run


def _carried(bits: int):
    """The same fingerprints for turns of later blocks, given depth (d0) and sum (s0) before their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda name: batch.column(name).to_numpy()
            s, before, d, d0, s0 = col("sum").view(np.uint64), col("psum").view(np.uint64), col("d"), col("d0"), col("s0").view(np.uint64)
            at, where = np.unique(d0, return_inverse=True)
            power = np.array([pow(int(_P), int(x), 1 << 64) for x in at], np.uint64)[where]
            deep = d0 + d
            fp, pfp = fingerprint(s0 + power * s, deep, bits), fingerprint(s0 + power * before, deep - 1, bits)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(deep), pa.array(fp), pa.array(pfp), batch.column("role"), batch.column("text")], names=["conv_id", "d", "fp", "pfp", "role", "text"])

    return run


def _bases(rows):
    """Depth and sum before each block of one conversation, from its blocks' lengths and sums."""
    rows = rows.sort_values("block")
    d0, s0, depth, total = [], [], 0, 0
    for n, s in zip(rows["n"].tolist(), rows["s"].tolist(), strict=True):
        d0.append(depth)
        s0.append(total - (1 << 64) if total >= 1 << 63 else total)
        total = (total + pow(int(_P), depth, 1 << 64) * s) % (1 << 64)
        depth += n
    return rows.assign(d0=d0, s0=s0)[["conv_id", "block", "d0", "s0"]]


def members(turns: DataFrame, scratch: Scratch, bits: int = 64, block_log2: int = BLOCK_LOG2) -> DataFrame:
    """conv_id, d, fp, pfp, role, text: every turn with its depth and the fingerprints up to and before it."""
    rows = turns.select("conv_id", F.shiftright("ord", block_log2).alias("block"), "role", "text", "ord")
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "ord").select("conv_id", "block", "role", "text")
    scanned = scratch.put("scanned", rows.mapInArrow(_scan(bits), SCANNED))
    sums = scanned.groupBy("conv_id", "block").agg(F.max("d").alias("n"), F.max_by("sum", "d").alias("s"))
    # The first block may have another number than 0; conversations of one block need nothing.
    several = sums.groupBy("conv_id").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    bases = sums.join(several, "conv_id", "left_semi").groupBy("conv_id").applyInPandas(_bases, "conv_id long, block long, d0 long, s0 long")
    later = scratch.put("bases", bases.where("d0 > 0"))
    whole = scanned.select("conv_id", "d", "fp", "pfp", "role", "text", "block")
    if later.isEmpty():
        return whole.drop("block")
    first = whole.join(later, ["conv_id", "block"], "left_anti").drop("block")
    at = W.partitionBy("conv_id", "block").orderBy("d")
    rest = scanned.withColumn("psum", F.lag("sum", 1, 0).over(at)).join(later, ["conv_id", "block"])
    return first.unionByName(rest.mapInArrow(_carried(bits), "conv_id long, d long, fp long, pfp long, role string, text string"))


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per candidate: its members, its smallest member, its parent's fingerprint, and whether all have one parent, role and text."""
    least, most = ([f(c).alias(f"{name}_{c}") for c in ("pfp", "role", "text")] for f, name in ((F.min, "least"), (F.max, "most")))
    found = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("rep"), *least, *most)
    same = (F.col("least_pfp") == F.col("most_pfp")) & (F.col("least_role") == F.col("most_role")) & (F.col("least_text") == F.col("most_text"))
    return found.select(*NODE, "n", "rep", F.col("least_pfp").alias("pfp"), F.length("least_text").cast("long").alias("chars"), same.alias("same"))


def _split(rows: DataFrame, bad: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose group has several (parent, role, text) get the number of theirs, and so do all turns below them.

    `path` lists depth and number of every split on the way, so that two prefixes with other paths never meet.
    """
    inside = rows.join(bad.select("d", "fp"), ["d", "fp"], "left_semi")
    kinds = inside.select("d", "fp", "pfp", "role", "text").distinct()
    kinds = kinds.withColumn("nth", F.row_number().over(W.partitionBy("d", "fp").orderBy("pfp", "role", "text")) - 1).where("nth > 0")
    splits = inside.join(kinds, ["d", "fp", "pfp", "role", "text"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("d", "nth"))).alias("splits"))
    upto = F.filter("splits", lambda x: x["d"] <= F.col("d"))
    path = F.array_join(F.transform(upto, lambda x: F.concat(x["d"].cast("string"), F.lit(":"), x["nth"].cast("string"))), ",")
    return scratch.put("split", rows.drop("path").join(splits, "conv_id", "left").withColumn("path", F.coalesce(path, F.lit(""))).drop("splits"))


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the decimal conv_ids of each node, ascending and comma-joined.

    Ids are joined in ranges of 4096 first; those pieces of a node are then digested in order as they stream by.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", IDS_LOG2).alias("piece")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for d, fp, path, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (d, fp, path) == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    done.append((*key, state.hexdigest()))
                key, state = (d, fp, path), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])
                done = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=[*NODE, "ends_sha256"])

    return pieces.repartition(*[F.col(c) for c in NODE]).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids").mapInArrow(digest, "d long, fp long, path string, ends_sha256 string")


def _owned_before(nodes: DataFrame) -> DataFrame:
    """Sums over the nodes that the same conversation owns above each node; in blocks of depths, so long ways span tasks."""
    rows = nodes.withColumn("block", F.shiftright("d", BLOCK_LOG2))
    inside = W.partitionBy("rep", "block").orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy("rep").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("rep", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    blocks = blocks.select("rep", "block", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(f"{c}_far") for c in ("leaf", "saved")])
    near = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_near") for c in ("leaf", "saved")])
    joined = near.join(blocks, ["rep", "block"])
    return joined.select(*nodes.columns, *[(F.col(f"{c}_near") + F.col(f"{c}_far")).alias(f"{c}_before") for c in ("leaf", "saved")])


def trie(conversations: tuple[DataFrame, DataFrame], bits: int = 64, block_log2: int = BLOCK_LOG2) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each distinct prefix.

    `conversations` is (turns, ids): turns with conv_id, ord (their order, unique within a conversation), role and
    text, and every conv_id, also those without turns. A node goes by its smallest member. `bits` is the width of
    fingerprints: narrower ones collide more often and give the same rows.

    Defined cases: conversations without turns are members of the root only; without any conversation there is no
    row; null roles and texts are to be filled before (`rebuilt` does); equal turns at one depth below other parents
    are other nodes; further columns are not read.
    """
    turns, ids = conversations
    scratch = Scratch(ids.sparkSession, "trie")
    rows = scratch.put("members", members(turns, scratch, bits, block_log2).withColumn("path", F.lit("")))
    scratch.drop("scanned")
    nodes = scratch.put("nodes", _nodes(rows))
    bad = nodes.where("not same")
    if not bad.isEmpty():
        rows = _split(rows, bad, scratch)
        nodes = scratch.put("nodes_split", _nodes(rows))
    rows = rows.select("conv_id", *NODE)
    # The parent's path is one's own without a split at one's own depth.
    up = nodes.withColumn("ppath", F.regexp_replace("path", F.concat(F.lit("(^|,)"), F.col("d").cast("string"), F.lit(r":\d+$")), F.lit("")))
    kids = up.groupBy((F.col("d") - 1).alias("d"), F.col("pfp").alias("fp"), F.col("ppath").alias("path")).agg(F.count(F.lit(1)).alias("n_children"))
    known = up.join(kids, NODE, "left").fillna(0, ["n_children"])
    known = scratch.put("known", known.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("chars")))
    owned = scratch.put("owned", known.groupBy(F.col("rep").alias("conv_id")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")))
    whole = rows.join(owned.hint("merge"), "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("leaf_all"), F.sum("saved").alias("saved_all"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("at"))
    # Conversations without turns end at the root.
    root = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("fp"), F.lit("").alias("path"))
    ends = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("at", root).alias("at")).select("conv_id", "at.*")
    digests = scratch.put("digests", _digests(ends))
    sums = scratch.put("sums", _owned_before(known).join(whole, NODE).join(digests, NODE, "left"))
    every = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    above = known.select((F.col("d") + 1).alias("d"), F.col("fp").alias("pfp"), F.col("path").alias("ppath"), F.col("rep").alias("parent"))
    none = F.lit(hashlib.sha256().hexdigest())
    below = sums.join(above.hint("merge"), ["d", "pfp", "ppath"], "left").crossJoin(F.broadcast(every.select(F.col("conv_id").alias("first"))))
    below = below.select(
        F.col("rep").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == 1, F.col("first")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        (F.col("leaf_all") - F.col("leaf_before")).alias("n_leaves"),
        (F.col("saved_all") - F.col("saved_before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total = known.agg(sum_of(F.when(F.col("d") == 1, 1).otherwise(0)).alias("n_children"), F.greatest(sum_of("leaf"), F.lit(1)).alias("n_leaves"), sum_of("saved").alias("saved_tokens"))
    turnless = digests.where("d = 0").agg(F.max("ends_sha256").alias("ends"))
    top = every.where("n_convs > 0").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(turnless))
    top = top.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))
    return top.unionByName(below)


ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS b)
), crc(c, i, s, x) AS (
  SELECT DISTINCT c, 1, CAST(c AS VARCHAR), 4294967295 FROM t
  UNION ALL
  SELECT c, i + 1, s, xor(x // 256, v) FROM crc JOIN bits ON b = xor(x % 256, ascii(s[i])) WHERE i <= length(s)
), h AS (
  SELECT c, xor(x, 4294967295) % 6 AS h, c - c % 100 AS host FROM crc WHERE i = length(s) + 1
), built AS (
  SELECT c, k AS o, r.role, r.text FROM h JOIN (SELECT c AS host, k, role, text FROM t) r USING (host) WHERE k < h.h
  UNION ALL
  SELECT c, k + 6, role, text FROM t JOIN h USING (c) WHERE k >= h.h
), seqs AS (
  SELECT c, list({'r': role, 't': text} ORDER BY o) AS s FROM built GROUP BY c
), whole AS (
  SELECT h.c, coalesce(s, []) AS s FROM h LEFT JOIN seqs USING (c)
), mem AS (
  SELECT c, s, unnest(range(len(s) + 1)) AS d FROM whole
), keyed AS (
  SELECT c, d, s[:d] AS pre, s[:d - 1] AS par, len(s) = d AS ends, CASE WHEN d > 0 THEN length(s[d].t) ELSE 0 END AS chars FROM mem
), nodes AS (
  SELECT d, pre, any_value(par) AS par, min(c) AS c, count(*) AS n, max(chars) AS chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM keyed GROUP BY d, pre
), kids AS (
  SELECT d - 1 AS d, par AS pre, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, par
), facts AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, pre)
), below AS (
  SELECT k.d, k.pre, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n - 1) * f.chars) AS saved
  FROM facts f JOIN keyed k ON k.c = f.c AND k.d <= f.d GROUP BY k.d, k.pre
)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN below b USING (d, pre) LEFT JOIN facts p ON p.d = f.d - 1 AND p.pre = f.par
"""
