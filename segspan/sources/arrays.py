"""Paired label arrays: from Python lists or tables to runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.runs import SIDE, painted, rle


def pairs(spark: SparkSession, gt: Sequence[Sequence[int]], pred: Sequence[Sequence[int]], masks: Sequence[Sequence[bool]] | None = None, predictor: str = "pred") -> DataFrame:
    """predictor, seq_id, gt, pred, mask from equally long lists of arrays."""
    if len(gt) != len(pred) or (masks is not None and len(masks) != len(gt)):
        raise ValueError("reference, prediction and mask lists must have the same length")
    rows = []
    for k, (g, p) in enumerate(zip(gt, pred, strict=True)):
        if len(g) != len(p):
            raise ValueError(f"sequence {k}: {len(g)} reference and {len(p)} predicted positions")
        rows.append((predictor, str(k), [int(x) for x in g], [int(x) for x in p], [bool(x) for x in masks[k]] if masks is not None else None))
    return spark.createDataFrame(rows, "predictor string, seq_id string, gt array<int>, pred array<int>, mask array<boolean>")


def runs(table: DataFrame) -> DataFrame:
    """Runs of both sides of array pairs. Pairs of different length are an error."""
    same = F.when(F.size("gt") == F.size("pred"), F.col("gt")).otherwise(F.raise_error(F.lit("array pair of different length")).cast("array<int>"))
    table = table.withColumn("chunk_id", F.lit(0)).withColumn("gt", same)
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("labels"))
    both = table.select("predictor", "seq_id", "chunk_id", F.inline(F.array(side("gt"), side("pred"))))
    return rle(both, "labels", SIDE)


def masks(table: DataFrame) -> DataFrame:
    """seq_id, lo, hi of masked stretches."""
    some = table.where("mask is not null").withColumn("m", F.transform("mask", lambda x: x.cast("int")))
    return rle(some, "m", ["seq_id"]).where("label = 1").select("seq_id", "lo", "hi").distinct()


def painted_confusion(runs: DataFrame, by: str = "predictor") -> DataFrame:
    """by, gt, pred, n: positions of each pair of labels. Runs of both sides are painted to array pairs, which exist in a task's batches only.

    `runs` tile both sides of each seq_id and chunk_id. Pairs of different length are an error, and so are null labels.
    """
    side = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("lo", "hi", "label"))).alias(s)
    both = runs.groupBy(*dict.fromkeys([by, "seq_id", "chunk_id"])).agg(side("pred"), side("gt")).select(by, "pred", "gt")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = (batch.select([0, 2, 1]) for batch in painted(batches))
        return confusion(painted(turned))

    kinds = [f"{by} {runs.schema[by].dataType.simpleString()}", "gt bigint", "pred bigint", "n bigint"]
    label = runs.schema["label"].dataType
    return both.mapInArrow(counted, ", ".join(kinds)).groupBy(by, F.col("gt").cast(label).alias("gt"), F.col("pred").cast(label).alias("pred")).agg(F.sum("n").alias("n"))


def confusion(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(by, gt, pred, n) of each batch of (by, gt, pred), where gt and pred are dense arrays."""
    for batch in batches:
        n, m = (batch.column(k).value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for k in (1, 2))
        if (n != m).any():
            raise ValueError("array pair of different length")
        if not n.sum():
            continue
        sides = [batch.column(k).flatten() for k in (1, 2)]
        if any(x.null_count for x in sides):
            raise ValueError("array pair with a null label")
        names = batch.column(0).dictionary_encode(null_encoding="encode")
        known, codes = [], [np.repeat(names.indices.to_numpy(), n)]
        for x in (x.to_numpy() for x in sides):
            low, high = int(x.min()), int(x.max())
            if high - low < 1 << 10:
                known.append(np.arange(low, high + 1))
                codes.append(x - low)
            else:
                values, code = np.unique(x, return_inverse=True)
                known.append(values)
                codes.append(code)
        shape = (len(names.dictionary), len(known[0]), len(known[1]))
        cells, counts = np.ravel_multi_index(codes, shape), None
        if np.prod(shape, dtype=np.float64) <= 1 << 22:
            counts = np.bincount(cells, minlength=int(np.prod(shape)))
            cells = np.flatnonzero(counts)
            counts = counts[cells]
        else:
            cells, counts = np.unique(cells, return_counts=True)
        a, g, p = np.unravel_index(cells, shape)
        yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(a)), *(pa.array(x.astype(np.int64)) for x in (known[0][g], known[1][p], counts))], names=[batch.schema.names[0], "gt", "pred", "n"])
