"""Segmentations and annotations derived from the lineitem table, for queries that check themselves.

A slot is an (order, line number) with the least part, supplier and quantity. The reference has one section
a slot; two predictors distort it by a rule on the quantity (the second with the quantity shifted by 3).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.runs import SIDE, interval_union

#: Positions of every axis.
AXIS = 330


#: Rows of lineitem of a task. Tasks grow in number with the table, not in size: a row becomes some five sections, sorted a few times.
TASK_ROWS = 100_000


def tasks(spark: SparkSession, sf_dir: str) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // TASK_ROWS))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by sequence, once: all that is keyed by a sequence, and more, then stays in its task."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = line.select(F.col("l_orderkey").cast("string").alias("seq_id"), F.col("l_linenumber").cast("long").alias("k"), "l_partkey", "l_suppkey", "l_quantity").repartition(tasks(spark, sf_dir), "seq_id")
    rows = line.groupBy("seq_id", "k").agg(F.min("l_partkey").alias("a"), F.min("l_suppkey").alias("b"), F.min(F.col("l_quantity").cast("long")).alias("q"))
    return rows.withColumn("o", F.col("seq_id").cast("long"))


def raw_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predictor, seq_id, o, side, lo, hi; predicted sections may overlap."""
    own = slots(spark, sf_dir)
    s = F.col("k") * 40 + F.col("a") % 10
    rows = own.withColumn("s", s).withColumn("e", s + 3 * (2 + F.col("b") % 7) - 1)
    names = F.explode(F.array(F.struct(F.lit("p1").alias("predictor"), F.lit(0).alias("shift")), F.struct(F.lit("p2").alias("predictor"), F.lit(3).alias("shift"))))
    both = rows.withColumn("p", names).select("p.predictor", "seq_id", "o", "k", "a", "b", "s", "e", ((F.col("q") + F.col("p.shift")) % 10).alias("r"))
    span = lambda lo, hi, side="pred": F.struct(F.lit(side).alias("side"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    s, e, a, b, r = (F.col(c) for c in "seabr")
    gt = span(s, e, "gt")
    one = lambda lo, hi: F.array(gt, span(lo, hi))
    rule: Column = (
        F.when(r <= 3, one(s, e)).when(r == 4, one(s + 1 + a % 3, e)).when(r == 5, one(s - 1 - a % 3, e)).when(r == 6, one(s, e + 1 + b % 4)).when(r == 8, F.array(gt, span(s, s + 1), span(s + 4, e))).when(r == 9, one(s, 40 * (F.col("k") + 1) + 9)).otherwise(F.array(gt))
    )
    found = both.select("predictor", "seq_id", "o", F.inline(rule))
    extra = own.where("o % 5 = 0").select("seq_id", "o").distinct().select(F.explode(F.array(F.lit("p1"), F.lit("p2"))).alias("predictor"), "seq_id", "o", F.lit("pred").alias("side"), F.lit(5).alias("lo"), F.lit(10).alias("hi"))
    return found.unionByName(extra)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_sections(spark, sf_dir).select("predictor", "seq_id", F.lit(0).alias("chunk_id"), "side", "lo", "hi")
    return interval_union(raw, SIDE)


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side keys with n."""
    o = slots(spark, sf_dir).select("seq_id").distinct()
    sides = F.explode(F.array(*[F.struct(F.lit(p).alias("predictor"), F.lit(s).alias("side")) for p in ("p1", "p2") for s in ("gt", "pred")]))
    return o.withColumn("x", sides).select("x.predictor", "seq_id", F.lit(0).alias("chunk_id"), "x.side", F.lit(AXIS).alias("n"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(spark, sf_dir).where("o % 4 = 0").select("seq_id", F.lit(120).alias("lo"), F.lit(139).alias("hi")).distinct()


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of the reference (source gt) and both predictors."""
    raw = raw_sections(spark, sf_dir)
    gt = F.col("side") == "gt"
    rows = raw.where((gt & (F.col("predictor") == "p1")) | (~gt & (F.col("o") % 11 != 3))).withColumn("source", F.when(gt, "gt").otherwise(F.col("predictor")))
    t = F.floor(F.col("o") / 14)
    off = F.floor(t / 3) * 1000 + (t % 3) * 50 + 1 + F.when((F.col("side") == "pred") & (F.col("o") % 13 == 5), 500).otherwise(0)
    rows = rows.withColumn("off", off).withColumn("gff_id", F.concat(F.when(F.col("side") == "gt", "gt").otherwise("pr"), F.col("o").cast("string")))
    place = [F.concat(F.lit("chr"), (F.col("o") % 7).cast("string")).alias("seqid"), F.when(F.floor(F.col("o") / 7) % 2 == 0, "+").otherwise("-").alias("strand")]
    exon = rows.select("source", (F.col("o") * 1000 + 1 + F.col("lo")).alias("ord"), *place, F.lit("exon").alias("type"), (F.col("lo") + F.col("off")).alias("start"), (F.col("hi") + F.col("off")).alias("stop"), F.lit(None).cast("string").alias("gff_id"), F.col("gff_id").alias("parent"))
    span = rows.groupBy("source", "seq_id", "o", "off", "gff_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mrna = span.select("source", (F.col("o") * 1000).alias("ord"), *place, F.lit("mRNA").alias("type"), (F.col("lo") + F.col("off")).alias("start"), (F.col("hi") + F.col("off")).alias("stop"), "gff_id", F.lit(None).cast("string").alias("parent"))
    return mrna.unionByName(exon).select("source", "ord", "seqid", "type", "start", "stop", "strand", "gff_id", "parent")
