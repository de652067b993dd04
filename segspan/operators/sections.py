"""Section families: overlap join, boundary residuals, four strictness levels, greedy one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..config import BIAS, RELIABILITY
from ..functions.scalars import distribution, iou, overlap, ratio, total
from .runs import KEYS


def pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Every overlapping (reference, predicted) section of a sequence: indexes, ends, overlap, residuals, IoU.

    Both sides are sorted and disjoint, so a section that starts can only meet the section of the other side that
    started last: one window over the sections of a sequence finds all pairs, without a join.
    """
    side = lambda df, name: df.select(*KEYS, F.lit(name).alias("side"), "idx", "lo", "hi")
    upto = W.partitionBy(*KEYS).orderBy("lo", "side").rowsBetween(W.unboundedPreceding, -1)
    last = lambda name: F.last(F.when(F.col("side") == name, F.struct("idx", "lo", "hi")), ignorenulls=True).over(upto)
    rows = side(gt, "gt").unionByName(side(pred, "pred")).withColumn("_g", last("gt")).withColumn("_p", last("pred"))
    own, is_gt = F.struct("idx", "lo", "hi"), F.col("side") == "gt"
    rows = rows.select(*KEYS, "lo", F.when(is_gt, own).otherwise(F.col("_g")).alias("g"), F.when(is_gt, F.col("_p")).otherwise(own).alias("p"))
    both = rows.where("g.hi >= lo and p.hi >= lo").select(*KEYS, *[F.col(f"{s}.{x}").alias(f"{s}_{x}") for s in "gp" for x in ("idx", "lo", "hi")])
    c = [F.col(x) for x in ("g_lo", "g_hi", "p_lo", "p_hi")]
    return both.select("*", overlap(*c).alias("bases"), (F.col("p_lo") - F.col("g_lo")).alias("r5"), (F.col("p_hi") - F.col("g_hi")).alias("r3"), iou(*c).alias("iou"))


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs sorted by stretch, then by overlap (largest first), reference and prediction: those that find both free."""
    stretch, gs, ps = None, set(), set()
    for batch in batches:
        keep = []
        for key, g, p in zip(zip(*(batch.column(k).to_pylist() for k in range(len(KEYS) + 1)), strict=True), batch.column("g_idx").to_pylist(), batch.column("p_idx").to_pylist(), strict=True):
            if key != stretch:
                stretch, gs, ps = key, set(), set()
            keep.append(g not in gs and p not in ps)
            if keep[-1]:
                gs.add(g)
                ps.add(p)
        yield batch.filter(pa.array(keep, pa.bool_()))


def matches(found: DataFrame) -> DataFrame:
    """The greedy one-to-one matching of each sequence: largest overlap first, ties by reference, then prediction.

    In the order of sections, pairs that share one are neighbours; stretches of such neighbours are matched on their
    own, in one pass over sorted rows, so that a long sequence spans tasks.
    """
    w = W.partitionBy(*KEYS).orderBy("g_idx", "p_idx")
    linked = (F.lag("g_idx").over(w) == F.col("g_idx")) | (F.lag("p_idx").over(w) == F.col("p_idx"))
    cols = ["g_idx", "p_idx", "bases", "g_lo", "g_hi", "p_lo", "p_hi"]
    rows = found.select(*KEYS, *[F.col(c).cast("int").alias(c) for c in cols], F.when(linked, 0).otherwise(1).alias("_new"))
    rows = rows.select(*KEYS, F.sum("_new").over(w).alias("_stretch"), *cols)
    key = [*KEYS, "_stretch"]
    rows = rows.repartition(*[F.col(k) for k in key]).sortWithinPartitions(*key, F.desc("bases"), "g_idx", "p_idx")
    return rows.mapInArrow(_greedy, rows.schema).drop("_stretch")


def perfect(gt: DataFrame, pred: DataFrame) -> DataFrame:
    return gt.select(*KEYS, "lo", "hi").join(pred.select(*KEYS, "lo", "hi"), [*KEYS, "lo", "hi"], "left_semi")


LEVELS = ("neighborhood", "internal", "full_coverage", "perfect_boundary")


def discovery(sequences: DataFrame, gt: DataFrame, pred: DataFrame, found: DataFrame) -> DataFrame:
    """Per sequence and level: tp, fn, fp. Sequences without sections count too.

    Matched sections that fail `internal` or `full_coverage` are misses but no false positives: fp stays the
    number of unmatched predictions.
    """
    c = {x: F.col(x) for x in ("g_lo", "g_hi", "p_lo", "p_hi")}
    hits = matches(found).select(
        *KEYS,
        F.lit(1).alias("neighborhood"),
        ((c["p_lo"] >= c["g_lo"]) & (c["p_hi"] <= c["g_hi"])).cast("int").alias("internal"),
        ((c["p_lo"] <= c["g_lo"]) & (c["p_hi"] >= c["g_hi"])).cast("int").alias("full_coverage"),
        # A section with the same ends on both sides meets no other one, so the matching has it.
        ((c["p_lo"] == c["g_lo"]) & (c["p_hi"] == c["g_hi"])).cast("int").alias("perfect_boundary"),
    )
    # One aggregate over everything that is counted, by sequence: no joins.
    names = ["_g", "_p", *LEVELS]
    one = lambda df, *has: df.select(*KEYS, *[F.lit(int(n in has)).alias(n) for n in names])
    rows = one(sequences).unionByName(one(gt, "_g")).unionByName(one(pred, "_p")).unionByName(hits.select(*KEYS, F.lit(0).alias("_g"), F.lit(0).alias("_p"), *LEVELS))
    wide = rows.groupBy(*KEYS).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    free = F.col("_p") - F.col("neighborhood")
    level = lambda x: F.struct(F.lit(x).alias("level"), F.col(x).alias("tp"), (F.col("_g") - F.col(x)).alias("fn"), (F.col("_p") - F.col(x) if x == "perfect_boundary" else free).alias("fp"))
    return wide.select(*KEYS, F.inline(F.array(*[level(x) for x in LEVELS])))


def discovery_scores(per_sequence: DataFrame, by: list[str]) -> DataFrame:
    s = per_sequence.groupBy(*by, "level").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fn", "fp")])
    return s.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def terminal_flags(sequences: DataFrame, gt: DataFrame, found: DataFrame) -> DataFrame:
    """Per sequence: does a prediction end with the first reference section, does one start with the last?"""
    last = gt.groupBy(*KEYS).agg(F.max("idx").alias("_last"))
    hit = found.join(last, KEYS).groupBy(*KEYS).agg(
        F.max(((F.col("g_idx") == 0) & (F.col("p_hi") == F.col("g_hi"))).cast("int")).alias("first_3_prime"),
        F.max(((F.col("g_idx") == F.col("_last")) & (F.col("p_lo") == F.col("g_lo"))).cast("int")).alias("last_5_prime"),
    )
    return sequences.select(*KEYS).join(hit, KEYS, "left").fillna(0)


def iou_stats(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(*distribution("iou"))


def iou_survival(found: DataFrame, by: list[str]) -> DataFrame:
    """For each IoU that occurs: the share of pairs with at least it."""
    n = found.groupBy(*by, "iou").agg(F.count(F.lit(1)).alias("n"))
    down, every = W.partitionBy(*by).orderBy(F.desc("iou")), W.partitionBy(*by)
    return n.select(*by, "iou", "n", (F.sum("n").over(down) / F.sum("n").over(every)).alias("share_at_least"))


def residuals(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by, "r5", "r3").agg(F.count(F.lit(1)).alias("n"))


def bias_matrix(counts: DataFrame, by: list[str], half: int = BIAS) -> DataFrame:
    """Counts for all residuals from -half to half on both ends, zeros included; larger ones are left out."""
    spark = counts.sparkSession
    axis = spark.range(-half, half + 1)
    grid = axis.select(F.col("id").cast("int").alias("r5")).crossJoin(axis.select(F.col("id").cast("int").alias("r3")))
    return counts.select(*by).distinct().crossJoin(F.broadcast(grid)).join(counts, [*by, "r5", "r3"], "left").fillna(0, ["n"])


def reliability_matrix(counts: DataFrame, n_gt: DataFrame, by: list[str], half: int = RELIABILITY) -> DataFrame:
    """For tolerances 0 to half on both ends: pairs within both, per reference section (may be above 1)."""
    spark = counts.sparkSession
    axis = spark.range(half + 1)
    grid = axis.select(F.col("id").cast("int").alias("t5")).crossJoin(axis.select(F.col("id").cast("int").alias("t3")))
    small = counts.where((F.abs("r5") <= half) & (F.abs("r3") <= half)).groupBy(*by, F.abs("r5").alias("a5"), F.abs("r3").alias("a3")).agg(F.sum("n").alias("n"))
    hits = small.join(F.broadcast(grid), (F.col("a5") <= F.col("t5")) & (F.col("a3") <= F.col("t3"))).groupBy(*by, "t5", "t3").agg(F.sum("n").alias("hits"))
    full = n_gt.crossJoin(F.broadcast(grid)).join(hits, [*by, "t5", "t3"], "left").fillna(0, ["hits"])
    return full.select(*by, "t5", "t3", F.col("hits").cast("long").alias("hits"), F.when(F.col("n_gt") > 0, F.col("hits") / F.col("n_gt")).otherwise(F.col("hits").cast("double")).alias("recall"))
