"""Transcript mapping: intron chains, loci, pair scores and classes, assignment, painting.

Everything is keyed by (seqid, strand); features of a strand other than + and - are never mapped. File
order (`ord`) breaks ties.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import LocusMatching
from ..functions.scalars import overlap
from ..functions.storage import materialized
from .assignment import TOGETHER, assigned
from .runs import interval_union
from .scan import SPAN, Running, scan

PLACE = ["seqid", "strand"]
UNMATCHED = "__unmatched_pred__"
#: Genomic bin of the locus join.
BIN = 1 << 14


def intron_chains(features: DataFrame, exon_types: Iterable[str]) -> DataFrame:
    """source, seqid, parent, chain: the set of (exon end, next exon start); empty for one exon."""
    exons = features.where(F.col("type").isin(*exon_types) & F.col("parent").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
    # The exons of a parent are packed before the shuffle, and linked within the row.
    own = exons.groupBy("source", "seqid", "parent").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_x"))
    n = F.size("_x") - 1
    link = F.zip_with(F.slice("_x", F.lit(1), n), F.slice("_x", F.lit(2), n), lambda x, y: F.struct(x["stop"].alias("d"), y["start"].alias("a")))
    return own.select("source", "seqid", "parent", F.array_sort(F.array_distinct(link)).alias("chain"))


def transcripts(features: DataFrame, chains: DataFrame, types: Iterable[str]) -> DataFrame:
    """Transcript rows with ids and coordinates on strands + and -, with their chains. Of equal ids the last in file order stays."""
    rows = features.where(F.col("type").isin(*types) & F.col("strand").isin("+", "-") & F.col("gff_id").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
    rows = rows.repartition("source", "seqid", "gff_id")  # for the window and the join
    last = rows.withColumn("_r", F.row_number().over(W.partitionBy("source", *PLACE, "gff_id").orderBy(F.desc("ord")))).where("_r = 1")
    c = chains.select("source", "seqid", F.col("parent").alias("gff_id"), "chain")
    empty = F.expr("cast(array() as array<struct<d:bigint,a:bigint>>)")
    return last.join(c, ["source", "seqid", "gff_id"], "left").select("source", *PLACE, "gff_id", "start", "stop", "ord", F.coalesce("chain", empty).alias("chain"))


def loci(spans: DataFrame, by: list[str] | None = None, span: int | None = SPAN) -> DataFrame:
    """Adds locus (numbered along its strand), l_start, l_stop: clusters of overlapping spans (sharing one position is enough).

    Strands are scanned in ranges of `span` positions, so that one chromosome takes many tasks.
    """
    by, order = by or ["source", *PLACE], ["start", "stop", "ord"]
    rows = scan(spans, by, "start", order, {"_reach": Running("max", F.col("stop"))}, span)
    rows = rows.withColumn("_new", F.coalesce(F.col("start") > F.col("_reach"), F.lit(True)))
    new = lambda c: F.when(F.col("_new"), c)
    # A locus ends where everything before the next one has ended; the last one ends where the strand does.
    wanted = {"locus": Running("sum", F.col("_new").cast("long"), upto=True), "l_start": Running("last", new(F.col("start")), upto=True), "_next": Running("last", new(F.col("_reach")), after=True), "_rest": Running("max", F.col("stop"), whole=True)}
    rows = scan(rows, by, "start", order, wanted, span)
    return rows.select(*spans.columns, "locus", "l_start", F.coalesce("_next", "_rest").alias("l_stop"))


# The names of the pair classes and the mark of predictions without a reference.
def pair_class(g: Column, p: Column) -> Column:
    """exact, contained, contains, shared_junction or overlapping. Structs with start, stop, chain."""
    single = (F.size(g["chain"]) == 0) | (F.size(p["chain"]) == 0)
    within = lambda a, b: (a["start"] >= b["start"]) & (a["stop"] <= b["stop"])
    subset = lambda a, b: F.size(F.array_except(a["chain"], b["chain"])) == 0
    span = F.when((g["start"] == p["start"]) & (g["stop"] == p["stop"]), "exact").when(within(p, g), "contained").when(within(g, p), "contains").otherwise("overlapping")
    multi = (
        F.when(subset(g, p) & subset(p, g), "exact")
        .when(subset(p, g) & within(p, g), "contained")
        .when(subset(g, p) & within(g, p), "contains")
        .when(F.size(F.array_intersect(g["chain"], p["chain"])) > 0, "shared_junction")
        .otherwise("overlapping")
    )
    return F.when(single, span).otherwise(multi)


def junction_f1(g: Column, p: Column) -> Column:
    n = F.size(F.array_intersect(g["chain"], p["chain"])).cast("double")
    precision, recall = n / F.size(p["chain"]), n / F.size(g["chain"])
    return F.when((F.size(g["chain"]) > 0) & (F.size(p["chain"]) > 0) & (n > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)


def pair_score(g: Column, p: Column) -> Column:
    """0 for disjoint spans, junction F1 for two multi-exon transcripts, else overlap by the longer span."""
    bases = overlap(g["start"], g["stop"], p["start"], p["stop"])
    longest = F.greatest(g["stop"] - g["start"], p["stop"] - p["start"]) + 1
    return F.when(bases == 0, 0.0).when((F.size(g["chain"]) > 0) & (F.size(p["chain"]) > 0), junction_f1(g, p)).otherwise(bases.cast("double") / longest)


def candidates(gt: DataFrame, pred: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Scored (reference, predicted) transcripts of each locus. `gt` comes from `loci`; pred: predictor as source.

    Loci are disjoint intervals; both sides meet on the genomic bins they touch, and of a pair that meets in
    several bins the one that holds the later start counts.
    """
    bins = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor(F.col(z) / bin_size)))
    span = gt.select(*PLACE, "locus", "l_start", "l_stop").distinct().withColumn("bin", bins("l_start", "l_stop"))
    p = pred.select(F.col("source").alias("predictor"), *PLACE, F.struct(F.col("gff_id").alias("id"), "start", "stop", "chain", "ord").alias("p"), "start", "stop").withColumn("bin", bins("start", "stop"))
    near = span.join(p, [*PLACE, "bin"]).where((F.col("start") <= F.col("l_stop")) & (F.col("stop") >= F.col("l_start")) & (F.col("bin") == F.floor(F.greatest("start", "l_start") / bin_size)))
    members = gt.select(*PLACE, "locus", F.struct(F.col("gff_id").alias("id"), "start", "stop", "chain", "ord").alias("g"))
    both = members.join(near.select(*PLACE, "locus", "predictor", "p"), [*PLACE, "locus"])
    g, pr = F.col("g"), F.col("p")
    return both.select(
        *PLACE,
        "locus",
        "predictor",
        g["id"].alias("gt_id"),
        g["start"].alias("gt_start"),
        g["stop"].alias("gt_stop"),
        g["ord"].alias("gt_ord"),
        pr["id"].alias("pred_id"),
        pr["start"].alias("pred_start"),
        pr["stop"].alias("pred_stop"),
        pr["ord"].alias("pred_ord"),
        pair_class(g, pr).alias("match_class"),
        overlap(g["start"], g["stop"], pr["start"], pr["stop"]).cast("long").alias("base_overlap"),
        junction_f1(g, pr).alias("junction_f1"),
        pair_score(g, pr).alias("score"),
    )


def best_per_locus(scored: DataFrame) -> DataFrame:
    w = W.partitionBy(*PLACE, "locus", "predictor").orderBy(F.desc("score"), "gt_start", "gt_stop", "gt_ord", "pred_ord")
    return scored.where("score > 0").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def full_discovery(scored: DataFrame, together: int = TOGETHER) -> DataFrame:
    """One-to-one pairs of each locus and predictor with the largest total score; pairs of score 0 are dropped.

    Of equally good assignments the one with the earlier pairs in (reference, prediction) order is taken, in loci of any
    size.
    """
    return assigned(scored, [*PLACE, "locus", "predictor"], "gt_id", "pred_id", "score", ["gt_start", "gt_stop", "gt_ord", "pred_ord"], together)


MAPPING = ["seqid", "strand", "gt_id", "gt_start", "gt_stop", "is_unmatched_prediction", "predictor", "pred_id", "pred_start", "pred_stop", "match_class", "base_overlap", "junction_f1"]


def unmatched(pred: DataFrame, assigned: DataFrame) -> DataFrame:
    """One sentinel row per predicted transcript that no locus took; its window is its own span."""
    taken = assigned.select(*PLACE, F.col("predictor").alias("source"), F.col("pred_id").alias("gff_id")).distinct()
    rest = pred.join(taken, ["source", *PLACE, "gff_id"], "left_anti")
    return rest.select(*PLACE, F.concat(F.lit(UNMATCHED), "gff_id").alias("gt_id"), F.col("start").alias("gt_start"), F.col("stop").alias("gt_stop"), F.lit(True).alias("is_unmatched_prediction"), F.col("source").alias("predictor"), F.col("gff_id").alias("pred_id"), F.col("start").alias("pred_start"), F.col("stop").alias("pred_stop"), F.lit("overlapping").alias("match_class"), F.lit(0).cast("long").alias("base_overlap"), F.lit(0.0).alias("junction_f1"))


def mapping(gt: DataFrame, pred: DataFrame, mode: LocusMatching = LocusMatching.FULL_DISCOVERY) -> DataFrame:
    """Flat mapping. BEST_PER_LOCUS: matches only. FULL_DISCOVERY: every reference (unmatched ones with nulls), and unmatched predictions."""
    placed = materialized(loci(gt))  # both sides of the join of candidates read it
    scored = candidates(placed, pred)
    chosen = best_per_locus(scored) if mode is LocusMatching.BEST_PER_LOCUS else full_discovery(scored)
    of = lambda rows: rows.withColumn("is_unmatched_prediction", F.lit(False)).select(*MAPPING)
    if mode is LocusMatching.BEST_PER_LOCUS:
        return of(chosen)
    chosen = materialized(chosen)  # three branches read it
    flat = of(chosen)
    missed = gt.join(flat.select(*PLACE, F.col("gt_id").alias("gff_id")).distinct(), [*PLACE, "gff_id"], "left_anti")
    null = {"predictor": "string", "pred_id": "string", "pred_start": "long", "pred_stop": "long", "match_class": "string", "base_overlap": "long", "junction_f1": "double"}
    missed = missed.select(*PLACE, F.col("gff_id").alias("gt_id"), F.col("start").alias("gt_start"), F.col("stop").alias("gt_stop"), F.lit(False).alias("is_unmatched_prediction"), *[F.lit(None).cast(t).alias(c) for c, t in null.items()])
    return flat.unionByName(missed).unionByName(unmatched(pred, chosen).select(*MAPPING))


def painted(mapped: DataFrame, features: DataFrame, predictors: DataFrame, exon_types: Iterable[str], gt_source: str = "gt") -> DataFrame:
    """Coding sections (0-based, clipped to the reference window) of both sides, per mapping row and predictor.

    Sentinels belong to their own predictor; a reference without a match keeps an empty prediction.
    """
    windows = mapped.select(*PLACE, "gt_id", "gt_start", "gt_stop", "is_unmatched_prediction").distinct()
    # Predictors may use one id for different transcripts, so a sentinel is known by its window too.
    place = [*PLACE, "gt_id", "gt_start", "gt_stop"]
    matched = mapped.where("predictor is not null").select(*place, "predictor", "pred_id")
    pairs = windows.crossJoin(F.broadcast(predictors.select("predictor").distinct())).join(matched, [*place, "predictor"], "left")
    pairs = pairs.where("not is_unmatched_prediction or pred_id is not null")
    kids = features.where(F.col("type").isin(*exon_types) & F.col("parent").isNotNull()).select("source", "seqid", "parent", "start", "stop")
    gt = pairs.where("not is_unmatched_prediction").join(kids.where(F.col("source") == gt_source).select("seqid", F.col("parent").alias("gt_id"), "start", "stop"), ["seqid", "gt_id"]).withColumn("side", F.lit("gt"))
    pred = pairs.join(kids.where(F.col("source") != gt_source).select(F.col("source").alias("predictor"), "seqid", F.col("parent").alias("pred_id"), "start", "stop"), ["predictor", "seqid", "pred_id"]).withColumn("side", F.lit("pred"))
    cols = ["predictor", *PLACE, "gt_id", "gt_start", "gt_stop", "side", "start", "stop"]
    both = gt.select(cols).unionByName(pred.select(cols)).where("start <= gt_stop and stop >= gt_start")
    clipped = both.select("predictor", *PLACE, "gt_id", "side", (F.greatest("start", "gt_start") - F.col("gt_start")).cast("int").alias("lo"), (F.least("stop", "gt_stop") - F.col("gt_start")).cast("int").alias("hi"))
    return interval_union(clipped, ["predictor", *PLACE, "gt_id", "side"])


def pair_windows(mapped: DataFrame, predictors: DataFrame) -> DataFrame:
    """predictor, seqid, strand, gt_id, n: the axes of `painted`."""
    windows = mapped.select(*PLACE, "gt_id", "gt_start", "gt_stop", "is_unmatched_prediction").distinct()
    own = mapped.where("is_unmatched_prediction").select(*PLACE, "gt_id", "gt_start", "gt_stop", "predictor", F.lit(True).alias("own"))
    rows = windows.crossJoin(F.broadcast(predictors.select("predictor").distinct())).join(own, [*PLACE, "gt_id", "gt_start", "gt_stop", "predictor"], "left")
    return rows.where("not is_unmatched_prediction or own").select("predictor", *PLACE, "gt_id", (F.col("gt_stop") - F.col("gt_start") + 1).cast("int").alias("n"))
