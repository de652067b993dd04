"""Exact dedup by distributed MSD radix partitioning.

Documents are split by their leading bytes, the groups by the bytes that follow, and so on, until a group has one
document or its texts have ended. Equality is decided by the bytes themselves, never by a digest.

A round is two steps on one digit, a run of bytes:

1. count the documents of each (group, digit), combined before the shuffle, so that a group of copies of any size
   sends one row a task; digits of several documents become the groups of the next round;
2. give every document its new group. Single documents and ended texts are done; only the rest goes on, with the
   bytes that are left. This is a merge join of two written tables, whose large partitions Spark splits; in the first
   round a broadcast where the groups are known to be few.

Digits grow by a factor, so the rounds grow with the logarithm of the longest text that has a near twin. After
the first digit most documents are single, and their texts are read but never shuffled or written where the groups
fit a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Scratch

#: Bytes of the first digit, and how many times longer each digit is than the one before.
DIGIT, GROWTH = 64, 8
#: Groups of the first round up to this size on disk, as measured, are broadcast; larger ones are merged.
BROADCAST_BYTES = 4 << 20

ROWS = "doc_id {kind}, sha string, uid long, keep {kind}, n long, kept boolean, grp long, rest binary, open boolean"


def _split(width: int) -> list:
    """The digit of `rest`, and whether the text ends with it: a text may end where another one goes on."""
    return [F.substring("rest", 1, width).alias("digit"), (F.length("rest") <= width).alias("ends")]


def _dealt(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    """The rows with the facts of their new group, or nulls where they are alone."""
    keys = [F.col(f"r.{c}") == F.col(f"g.{c}") for c in ("grp", "digit", "ends")]
    return rows.alias("r").join(F.broadcast(groups.alias("g")) if small else groups.alias("g").hint("merge"), keys, "left")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digit: int = DIGIT, growth: int = GROWTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of `docs`.

    Of equal texts the row with the largest doc_id is kept; `keep_id` is its doc_id.

    Defined cases: null texts count as empty, and empty texts equal each other; of repeated rows with the largest
    doc_id exactly one is kept; a null doc_id is smaller than any other, and `keep_id` is null where all doc_ids of a
    group are; texts that differ in case, white space or Unicode form differ; an empty table gives an empty frame;
    other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "radix")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = ROWS.format(kind=kind)
    text_of = F.coalesce(F.col(text), F.lit(""))
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_of.alias("t"), F.lit(0).cast("long").alias("grp"), text_of.cast("binary").alias("rest"))
    open_, width, done, k = None, digit, [], 0
    while True:
        rows = (whole if open_ is None else open_).select("*", *_split(width))
        # The first round has no row ids yet, so it only splits; ended texts close in the second.
        top = [] if open_ is None else [F.max(F.struct("doc_id", "uid")).alias("top")]
        counted = rows.groupBy("grp", "digit", "ends").agg(F.count(F.lit(1)).alias("size"), *top).where("size > 1")
        groups = scratch.put(f"groups{k}", counted.withColumn("id", F.monotonically_increasing_id()))
        dealt = _dealt(rows, groups, k == 0 and scratch.bytes("groups0") <= broadcast_bytes)
        alone = F.col("g.id").isNull()
        if open_ is None:
            goes_on, sha, uid = ~alone, F.sha2(F.col("t"), 256), F.monotonically_increasing_id()
            keep, kept = F.when(alone, F.col("r.doc_id")), F.when(alone, F.lit(True))
        else:
            goes_on, sha, uid = ~alone & ~F.col("r.ends"), F.col("sha"), F.col("uid")
            keep, kept = F.when(alone, F.col("r.doc_id")).otherwise(F.col("top.doc_id")), alone | (F.col("uid") == F.col("top.uid"))
        after = F.expr(f"substring(rest, {width + 1})")
        out = dealt.select(
            F.col("r.doc_id").alias("doc_id"), sha.alias("sha"), uid.alias("uid"), keep.alias("keep"), F.coalesce("g.size", F.lit(1)).alias("n"), kept.alias("kept"), F.col("g.id").alias("grp"), F.when(goes_on, after).alias("rest"), goes_on.alias("open")
        )
        written = scratch.put(f"rows{k}", out, schema, by="open")
        done.append(written.where("not open"))
        scratch.drop(f"groups{k}")
        if k:
            scratch.drop(f"rows{k - 1}/open=true")
        scratch.free()
        open_ = written.where("open").drop("open")
        if open_.isEmpty():
            break
        width, k = width * growth, k + 1
    result = done[0]
    for other in done[1:]:
        result = result.unionByName(other)
    return result.select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
