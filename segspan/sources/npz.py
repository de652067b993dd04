"""Label arrays from .npz archives: one row an array."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ROWS = "file string, nth long, name string, labels array<int>"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The arrays of each archive, one batch an array: a task holds an archive and one of its arrays."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for nth, name in enumerate(archive.namelist()):
                    x = np.lib.format.read_array(io.BytesIO(archive.read(name)), allow_pickle=False)
                    if x.ndim != 1:
                        raise ValueError(f"{name} in {path} has {x.ndim} dimensions, not one")
                    if x.dtype.kind not in "iub" and not (np.mod(x, 1) == 0).all():
                        raise ValueError(f"{name} in {path} has values that are no whole numbers")
                    labels = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([nth]), pa.array([name.removesuffix(".npy")]), labels], names=["file", "nth", "name", "labels"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, nth, name, labels of every array of an archive, or of all archives of a folder, in their order.

    Archives are read by Spark, so any store will do, and each by a task of its own. Arrays of objects are refused.
    """
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)
    return archives.select("path", "content").mapInArrow(_members, ROWS)


def pairs(spark: SparkSession, gt: str, pred: str, masks: str | None = None, predictor: str = "pred") -> DataFrame:
    """predictor, seq_id, gt, pred, mask: the arrays of two (three) archives side by side, in their order.

    A single archive pairs with a single archive whatever they are called; folders pair archives of one name. Arrays
    without a partner are an error.
    """
    one = lambda path: path.lower().endswith(".npz")
    whole = all(one(p) for p in (gt, pred, masks) if p)
    key = F.lit("").alias("file") if whole else F.col("file")
    side = lambda path, name: read(spark, path).select(key, "nth", F.col("labels").alias(name))
    rows = side(gt, "gt").join(side(pred, "pred"), ["file", "nth"], "full")
    if masks:
        rows = rows.join(side(masks, "mask"), ["file", "nth"], "full").withColumn("mask", F.transform("mask", lambda x: x != 0))
    else:
        rows = rows.withColumn("mask", F.lit(None).cast("array<boolean>"))
    missing = F.col("gt").isNull() | F.col("pred").isNull() | (F.col("mask").isNull() if masks else F.lit(False))
    known = lambda c: F.when(missing, F.raise_error(F.concat(F.lit("no partner for array "), F.col("nth").cast("string"), F.lit(" of "), F.col("file"))).cast("array<int>")).otherwise(F.col(c)).alias(c)
    seq = F.when(F.col("file") == "", F.col("nth").cast("string")).otherwise(F.concat_ws("/", "file", F.col("nth").cast("string")))
    return rows.select(F.lit(predictor).alias("predictor"), seq.alias("seq_id"), known("gt"), known("pred"), "mask")
