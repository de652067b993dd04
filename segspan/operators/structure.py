"""Whole-chain families: chain agreement, match classes, shifts, soft exon scores, segment-count differences, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import POSITION_BINS, LabelConfig
from ..functions.scalars import distribution, ratio
from .runs import KEYS, SIDE, binary


def _one_frame(gt: DataFrame, pred: DataFrame | None) -> DataFrame:
    """The sections of both sides; `gt` alone, with its `side`, if it holds both."""
    return gt if pred is None else gt.withColumn("side", F.lit("gt")).unionByName(pred.withColumn("side", F.lit("pred")))


def chain_facts(sequences: DataFrame, gt: DataFrame, pred: DataFrame | None = None) -> DataFrame:
    """Per sequence: both, gt_only, pred_only (equal spans), n_gt, n_pred and the outer ends of each side.

    Without `pred`, `gt` holds the sections of both sides. Unions and aggregates, and no joins, leave rows that are already
    dealt by sequence where they are.
    """
    one = lambda s: F.max(F.when(F.col("side") == s, 1))
    spans = _one_frame(gt, pred).groupBy(*KEYS, "lo", "hi").agg(one("gt").alias("g"), one("pred").alias("p"))
    none = F.lit(None).cast("int")
    rows = sequences.select(*KEYS, none.alias("lo"), none.alias("hi"), none.alias("g"), none.alias("p")).unionByName(spans)
    of = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    has_g, has_p = F.col("g").isNotNull(), F.col("p").isNotNull()
    ends = [f(F.when(c, F.col(x))).alias(f"{x}_{s}") for s, c in (("gt", has_g), ("pred", has_p)) for f, x in ((F.min, "lo"), (F.max, "hi"))]
    known = F.max(~has_g & ~has_p).alias("_known")
    facts = rows.groupBy(*KEYS).agg(of(has_g & has_p, 1).alias("both"), of(has_g & ~has_p, 1).alias("gt_only"), of(~has_g & has_p, 1).alias("pred_only"), *ends, known).where("_known").drop("_known")
    return facts.withColumn("n_gt", F.col("both") + F.col("gt_only")).withColumn("n_pred", F.col("both") + F.col("pred_only"))


def chain_outcomes(facts: DataFrame, name: str) -> DataFrame:
    """Per sequence and variant (exact, subset: prediction within the reference, superset): tp, fp, fn. An empty reference gives zeros."""
    some = F.col("n_pred") > 0
    hits = {"": (F.col("gt_only") == 0) & (F.col("pred_only") == 0), "_subset": some & (F.col("pred_only") == 0), "_superset": some & (F.col("gt_only") == 0)}

    def one(suffix: str, hit: Column) -> Column:
        tp = F.when((F.col("n_gt") > 0) & hit, 1).otherwise(0)
        miss = F.when((F.col("n_gt") > 0) & ~hit, 1).otherwise(0)
        return F.struct(F.lit(name + suffix).alias("chain"), tp.alias("tp"), miss.alias("fp"), miss.alias("fn"))

    return facts.select(*KEYS, F.inline(F.array(*[one(*x) for x in hits.items()])))


def chain_scores(outcomes: DataFrame, by: list[str]) -> DataFrame:
    s = outcomes.groupBy(*by, "chain").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    return s.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def require_introns(runs: DataFrame, config: LabelConfig) -> None:
    """Chains need introns: fail if the role is missing, or a side has several exons and no intron. Two booleans reach the driver."""
    if config.intron_label is None:
        raise ValueError("structural coherence needs an intron label")
    n = runs.groupBy(*SIDE).agg(F.sum((F.col("label") == config.exon_label).cast("int")).alias("e"), F.sum((F.col("label") == config.intron_label).cast("int")).alias("i"))
    bad = [r["side"] for r in n.where("e > 1 and i = 0").select("side").distinct().collect()]
    if bad:
        raise ValueError(f"several exons but no intron on side {', '.join(sorted(bad))}: infer introns first")


def match_class(facts: DataFrame) -> DataFrame:
    """Per sequence with a reference: one of eight classes."""
    same = F.col("n_gt") == F.col("n_pred")
    outer = (F.col("lo_gt") == F.col("lo_pred")) & (F.col("hi_gt") == F.col("hi_pred"))
    kind = (
        F.when(F.col("n_pred") == 0, "missed")
        .when((F.col("gt_only") == 0) & (F.col("pred_only") == 0), "exact")
        .when(same & outer, "boundary_shift_internal")
        .when(same, "boundary_shift_terminal")
        .when(F.col("pred_only") == 0, "missing_segments")
        .when(F.col("gt_only") == 0, "extra_segments")
        .when(F.col("both") > 0, "partial_overlap")
        .otherwise("no_overlap")
    )
    return facts.where("n_gt > 0").select(*KEYS, kind.alias("match_class"))


def class_shares(classes: DataFrame, by: list[str]) -> DataFrame:
    n = classes.groupBy(*by, "match_class").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*by)))


def boundary_shift(facts: DataFrame, gt: DataFrame, pred: DataFrame | None = None) -> DataFrame:
    """Per sequence: boundaries that differ, and by how much, if both sides have equally many sections; else 0, 0. Without `pred`, `gt` holds both sides."""
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    rows = _one_frame(gt, pred).groupBy(*KEYS, "idx").agg(*[of(s, c).alias(f"{s[0]}_{c}") for s in ("gt", "pred") for c in ("lo", "hi")])
    d5, d3 = F.abs(F.col("p_lo") - F.col("g_lo")), F.abs(F.col("p_hi") - F.col("g_hi"))
    none = F.lit(None).cast("long")
    sides = facts.select(*KEYS, "n_gt", "n_pred", none.alias("d"), none.alias("total"))
    rows = rows.select(*KEYS, none.alias("n_gt"), none.alias("n_pred"), ((d5 > 0).cast("int") + (d3 > 0).cast("int")).cast("long").alias("d"), (d5 + d3).cast("long").alias("total"))
    s = sides.unionByName(rows).groupBy(*KEYS).agg(F.max("n_gt").alias("n_gt"), F.max("n_pred").alias("n_pred"), F.sum("d").alias("d"), F.sum("total").alias("total"))
    same = lambda c: F.when(F.col("n_gt") == F.col("n_pred"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long")
    return s.where("n_gt > 0").select(*KEYS, same("d").alias("shift_count"), same("total").alias("shift_total"))


def soft_exons(facts: DataFrame) -> DataFrame:
    """Per sequence with a reference: share of its exons found exactly, and number of predicted exons it has not."""
    return facts.where("n_gt > 0").select(*KEYS, (F.col("both") / F.col("n_gt")).alias("recall"), F.col("pred_only").alias("hallucinated"))


def segment_delta(facts: DataFrame) -> DataFrame:
    return facts.where("n_gt > 0").select(*KEYS, (F.col("n_pred") - F.col("n_gt")).alias("delta"))


def stats(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    return values.groupBy(*by).agg(*distribution(column))


def length_emd(sequences: DataFrame, gt: DataFrame, pred: DataFrame | None = None) -> DataFrame:
    """Per sequence: the 1-D earth mover's distance of both sides' section lengths; 0 if a side is empty.

    Sum over consecutive lengths of |difference of the distribution functions| times their distance. Without `pred`, `gt`
    holds the sections of both sides.
    """
    sign = F.when(F.col("side") == "gt", 1.0).otherwise(-1.0)
    rows = _one_frame(gt, pred).select(*KEYS, (F.col("hi") - F.col("lo") + 1).alias("v"), sign.alias("s"))
    rows = rows.withColumn("w", F.col("s") / F.count(F.lit(1)).over(W.partitionBy(*KEYS, "s"))).groupBy(*KEYS, "v").agg(F.sum("w").alias("w"), F.max("s").alias("a"), F.min("s").alias("z"))
    up = W.partitionBy(*KEYS).orderBy("v")
    rows = rows.withColumn("part", F.abs(F.sum("w").over(up)) * (F.lead("v").over(up) - F.col("v")))
    e = rows.groupBy(*KEYS).agg(F.when((F.max("a") > 0) & (F.min("z") < 0), F.coalesce(F.sum("part"), F.lit(0.0))).otherwise(0.0).alias("emd"))
    marks = sequences.select(*KEYS, F.lit(0.0).alias("emd"), F.lit(True).alias("_known"))
    all_ = marks.unionByName(e.select(*KEYS, "emd", F.lit(False).alias("_known"))).groupBy(*KEYS).agg(F.max("emd").alias("emd"), F.max("_known").alias("_known"))
    return all_.where("_known").drop("_known")


def bin_edge(k: Column, span: Column, bins: int) -> Column:
    """First integer of bin k of `bins` equal float bins over [0, span]: bin k holds edge(k) to edge(k+1)-1."""
    return F.ceil(k * (span / F.lit(float(bins)))).cast("long")


def position_bias(pieces: DataFrame, config: LabelConfig, by: list[str], bins: int = POSITION_BINS) -> DataFrame:
    """Mismatched bases by relative position between the first and the last coding base of the reference, in 100 bins.

    A mismatch run meets the bins it touches and adds the length of each intersection; no row per base.
    """
    rows = binary(pieces, config.exon_label)
    every = W.partitionBy(*KEYS)
    rows = rows.withColumn("_first", F.min(F.when(F.col("g") == 1, F.col("lo"))).over(every)).withColumn("_last", F.max(F.when(F.col("g") == 1, F.col("hi"))).over(every))
    rows = rows.where("g <> p and hi >= _first and lo <= _last").withColumn("span", (F.col("_last") - F.col("_first") + 1).cast("double"))
    rows = rows.withColumn("a", F.greatest("lo", "_first") - F.col("_first")).withColumn("z", F.least("hi", "_last") - F.col("_first"))
    near = lambda c, d: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(F.col(c) / F.col("span") * bins).cast("int") + d))
    rows = rows.withColumn("bin", F.explode(F.sequence(near("a", -1), near("z", 1))))
    last = F.when(F.col("bin") == bins - 1, F.col("span").cast("long") - 1).otherwise(bin_edge(F.col("bin") + 1, F.col("span"), bins) - 1)
    n = F.least("z", last) - F.greatest("a", bin_edge(F.col("bin"), F.col("span"), bins)) + 1
    counts = rows.withColumn("n", n).where("n > 0").groupBy(*by, "bin").agg(F.sum("n").cast("long").alias("n"))
    grid = pieces.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return pieces.select(*by).distinct().crossJoin(F.broadcast(grid)).join(counts, [*by, "bin"], "left").fillna(0, ["n"])
