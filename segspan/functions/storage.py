"""Frames written once where plans use them many times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("segspan.tables.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="segspan-")
        atexit.register(shutil.rmtree, own, True)
        own = f"file://{own}"
        spark.conf.set("segspan.tables.dir", own)
    return own


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/segspan-{spark.sparkContext.applicationId}"


def materialized(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: plans that read it many times stay small, with statistics,
    pruning and pushed filters; lost executors lose nothing. `clear` deletes all tables of the session."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that ends with `name`."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}/{name}"


def clear(spark: SparkSession) -> None:
    """Delete the tables of this session; frames that read them can't be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
