"""Tables written between the steps of an operator, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the session names none (tests, one machine)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("segspan.scratch.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="segspan-")
        atexit.register(shutil.rmtree, own, True)
        own = "file://" + own
        spark.conf.set("segspan.scratch.dir", own)
    return own


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB instead of 64 MB, unless the session says otherwise: each task holds some of them in both processes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "8m")


class Scratch:
    """A folder for one run of an operator; written tables survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        small_batches(spark)

    def put(self, name: str, df: DataFrame, schema: str | None = None, by: str | None = None) -> DataFrame:
        """Write the frame and read it again. With `by`, a folder for each of its values, each of which can be dropped alone."""
        out = df.write.mode("overwrite")
        (out.partitionBy(by) if by else out).parquet(f"{self.path}/{name}")
        self.names.add(name)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/{name}")

    def bytes(self, name: str) -> int:
        """Size of a written table on disk."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def free(self) -> None:
        """Let Spark delete the shuffle files of steps whose results are written: it does so when the driver's JVM collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        self.names.discard(name)
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Write the frame as the last table: all others and all shuffle files go."""
        out = self.put(name, df)
        for other in self.names - {name}:
            self.drop(other)
        self.free()
        return out
