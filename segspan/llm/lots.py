"""Columns of many rows packed into one binary value a bucket: numbers cross a shuffle without a Spark row each.

Buckets are runs of hash slots with some LOT rows in all, cut from counts of the whole input, so a bucket fits in a task's
memory whatever the size of the input. A slot that alone has more than HOT rows has no bucket: its rows must go one by
one, sorted by Spark, which needs no memory for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PACKED = "bucket int, data binary"
#: Rows of a bucket and of a lot that is packed at once; rows from which a slot has no bucket.
LOT, HOT = 1 << 19, 1 << 21
#: Slots are the top bits of a hash.
SLOTS_LOG2 = 18
#: Parts of a counted array, and the groups that the tasks' parts are first summed in.
BLOCKS, GROUPS = 64, 256


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


def buckets_of(counts: np.ndarray, passes: int = 1) -> np.ndarray:
    """The bucket of each slot, -1 for hot ones; `counts` are the rows of all passes."""
    rows = counts.astype(np.int64) // passes
    hot = rows > HOT
    return np.where(hot, -1, np.cumsum(np.where(hot, 0, rows)) // LOT).astype(np.int32)


def pack(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row a bucket: its rows' columns one after another, each as planes of equal bytes, which compress well."""
    if len(bucket) and bucket.max() < 1 << 16:
        bucket = bucket.astype(np.uint16)  # sorted by its digits
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(bucket)), bool), bucket[1:] != bucket[:-1]]))
    ends = np.concatenate([at[1:], [len(bucket)]])[: len(at)]
    columns = [np.ascontiguousarray(c[order]).view(np.uint8).reshape(len(bucket), c.itemsize) for c in columns]
    # A transposed copy is made in one go; tobytes() of a transposed array goes byte by byte.
    data = [b"".join(np.ascontiguousarray(c[a:z].T) for c in columns) for a, z in zip(at.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def unpack(data: list[pa.Scalar], kinds: list[np.dtype]) -> list[np.ndarray]:
    """The columns of all rows in some packed values."""
    width = sum(k.itemsize for k in kinds)
    parts = [np.frombuffer(x.as_buffer(), np.uint8) for x in data]
    out = [np.empty((sum(len(b) for b in parts) // width, k.itemsize), np.uint8) for k in kinds]
    begin = 0
    for b in parts:
        n, lo = len(b) // width, 0
        for c in out:
            for k in range(c.shape[1]):
                c[begin : begin + n, k] = b[lo : lo + n]
                lo += n
        begin += n
    return [c.view(k).ravel() for c, k in zip(out, kinds, strict=True)]


def in_buckets(batches: Iterator[pa.RecordBatch], kinds: list[np.dtype]) -> Iterator[list[np.ndarray]]:
    """The columns of each bucket from packed rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now:
                if held:
                    yield unpack(held, kinds)
                now, held = b, []
            held.append(x)
    if held:
        yield unpack(held, kinds)


def dealt(packed: DataFrame) -> DataFrame:
    """Packed rows with each bucket in one task."""
    return packed.repartition(F.col("bucket")).sortWithinPartitions("bucket")


def counted(s: np.ndarray, counts: np.ndarray) -> None:
    """Add the hashes `s` to the counts of their slots."""
    counts += np.bincount(slot(s), minlength=len(counts)).astype(counts.dtype)


def count_rows(counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(block, data) that a task sends for its counts."""
    return np.arange(BLOCKS, dtype=np.int32), [planes(x) for x in np.split(counts, BLOCKS)]


def planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: small counts are mostly zeros, which compress to nothing."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(data: bytes | pa.Buffer, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def merged_array(parts: DataFrame, op: Callable, kind: type) -> np.ndarray:
    """Combine rows (block int, data binary: planes of numbers) of equal blocks, in two steps; the result is as large as one array, whatever the input."""

    def fold(table: pa.Table) -> pa.Table:
        out = None
        for x in table.column("data"):
            one = unplanes(x.as_buffer(), kind)
            out = one if out is None else op(out, one)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "data": [planes(out)]})

    some = parts.select("block", "data", F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part")).groupBy("block", "part").applyInArrow(fold, "block int, data binary")
    rows = some.groupBy("block").applyInArrow(fold, "block int, data binary").collect()
    return np.concatenate([unplanes(r["data"], kind) for r in sorted(rows, key=lambda r: r["block"])]) if rows else np.zeros(0, kind)
