"""Per-base families from the overlay: confusion, mismatch taxonomy, transitions, reading frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..config import LabelConfig
from ..functions.scalars import ratio, scores, total
from .runs import KEYS, binary
from .scan import WHOLE, Running, scan


def length() -> Column:
    return F.col("hi") - F.col("lo") + 1


def label_confusion(pieces: DataFrame, by: list[str]) -> DataFrame:
    return pieces.groupBy(*by, "gt", "pred").agg(F.sum(length()).cast("long").alias("n"))


def nucleotide(pieces: DataFrame, config: LabelConfig, by: list[str]) -> DataFrame:
    """tn, fp, fn, tp of coding against the rest, with precision, recall and F1 (0 where undefined)."""
    g, p = F.col("gt") == config.exon_label, F.col("pred") == config.exon_label
    counts = pieces.groupBy(*by).agg(total(~g & ~p, length()).alias("tn"), total(~g & p, length()).alias("fp"), total(g & ~p, length()).alias("fn"), total(g & p, length()).alias("tp"))
    return counts.select("*", *scores())


def indel(pieces: DataFrame, config: LabelConfig, span: int | None = WHOLE) -> DataFrame:
    """keys, kind, lo, hi: every mismatch run, named by whether agreed coding lies right before and after it."""
    agreed = F.col("g") * F.col("p")
    rows = scan(binary(pieces, config.exon_label, span), KEYS, "lo", ["lo"], {"_left": Running("last", agreed), "_right": Running("next", agreed)}, span)
    left, right = (F.coalesce(c, F.lit(0)) == 1 for c in ("_left", "_right"))
    ins = F.when(left & right, "joined").when(right, "5_prime_extensions").when(left, "3_prime_extensions").otherwise("whole_insertions")
    gone = F.when(left & right, "split").when(right, "5_prime_deletions").when(left, "3_prime_deletions").otherwise("whole_deletions")
    return rows.withColumn("kind", F.when(F.col("p") == 1, ins).otherwise(gone)).where("g <> p").select(*KEYS, "kind", "lo", "hi")


def indel_counts(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(length()).cast("long").alias("bases"), F.percentile(length(), 0.5).alias("median_length"))


def indel_length_histogram(found: DataFrame, bins: int = 30) -> DataFrame:
    """Lengths by equal bins of log10, over the range of each predictor."""
    x = F.log10(length())
    span = found.groupBy("predictor").agg(F.min(x).alias("_a"), F.max(x).alias("_z"))
    at = F.when(F.col("_z") > F.col("_a"), F.least(F.floor((x - F.col("_a")) / (F.col("_z") - F.col("_a")) * bins), F.lit(bins - 1))).otherwise(0)
    return found.join(span, "predictor").groupBy("predictor", "kind", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stable_counts(runs: DataFrame, by: list[str]) -> DataFrame:
    """Windows of two positions inside one reference run, by label."""
    return runs.where("side = 'gt'").groupBy(*by, "label").agg(F.sum(F.expr("hi - lo")).cast("long").alias("n"))


def transitions(runs: DataFrame, pieces: DataFrame) -> DataFrame:
    """One row per window (lo-1, lo) where a side changes: keys, kind, ctx, row, col.

    kind `gt`: the reference changes and the prediction had its old label; row and col are the new labels of
    reference and prediction. Else the prediction changes falsely, from row to col, under ctx: `late` makes up
    for the reference's last change, `premature` is ahead of its next one, `spurious` is neither.
    """
    at = W.partitionBy(*KEYS)
    w = at.orderBy("lo")
    rows = pieces.withColumn("g0", F.lag("gt").over(w)).withColumn("p0", F.lag("pred").over(w))
    # The labels before and after the reference run of the window's left position, carried along the pieces from its borders.
    border = F.col("g0").isNotNull() & (F.col("g0") != F.col("gt"))
    rows = rows.withColumn("r_before", F.last(F.when(border, F.col("g0")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    back = at.orderBy(F.desc("lo")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("r_after", F.last(F.when(border, F.col("gt")), ignorenulls=True).over(back)).where("g0 is not null")
    changes, moves = F.col("g0") != F.col("gt"), F.col("p0") != F.col("pred")
    kept = changes & (F.col("p0") == F.col("g0"))
    false = moves & (~changes | (F.col("p0") != F.col("g0")))
    late = ~changes & (F.col("p0") == F.coalesce("r_before", "g0")) & (F.col("pred") == F.col("g0"))
    early = ~changes & (F.col("p0") == F.col("g0")) & (F.col("pred") == F.coalesce("r_after", "g0"))
    kind = F.when(kept, "gt").when(false & late, "late").when(false & early, "premature").when(false, "spurious")
    return rows.withColumn("kind", kind).where("kind is not null").select(*KEYS, "kind", F.col("g0").alias("ctx"), F.when(kept, F.col("gt")).otherwise(F.col("p0")).alias("row"), F.col("pred").alias("col"))


def transition_counts(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by, "kind", "ctx", "row", "col").agg(F.count(F.lit(1)).alias("n"))


def late_total(counts: DataFrame, by: list[str]) -> DataFrame:
    """n of all late transitions."""
    return counts.groupBy(*by).agg(total(F.col("kind") == "late", F.col("n")).alias("n"))


def false_by_target(counts: DataFrame, by: list[str]) -> DataFrame:
    """kind, target, n: premature and spurious transitions by the label they go to."""
    return counts.where("kind in ('premature', 'spurious')").groupBy(*by, "kind", F.col("col").alias("target")).agg(F.sum("n").cast("long").alias("n"))


def dense_transitions(counts: DataFrame, config: LabelConfig, by: list[str]) -> DataFrame:
    """All label pairs under all contexts, zeros included: five labels at most a side."""
    spark = counts.sparkSession
    ls = sorted(config.labels)
    grid = spark.createDataFrame([(k, c, r, o) for k in ("gt", "late", "premature", "spurious") for c in ls for r in ls for o in ls], "kind string, ctx int, row int, col int")
    keys = counts.select(*by).distinct()
    return keys.crossJoin(F.broadcast(grid)).join(counts, [*by, "kind", "ctx", "row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def frames(pieces: DataFrame, config: LabelConfig, strict: bool = True, span: int | None = WHOLE) -> DataFrame:
    """keys, lo, hi, frame for stretches coding on both sides: |coding bases so far, pred - gt| modulo 3.

    Sequences without coding on a side, or under 3 predicted bases, have none. A reference whose coding length
    is no multiple of 3 is an error.
    """
    g, p = ((F.col(c) == config.exon_label).cast("int") * length() for c in ("gt", "pred"))
    running = lambda c: {f"_c{c}": Running("sum", F.col(f"_{c}"), upto=True), f"_t{c}": Running("sum", F.col(f"_{c}"), whole=True)}
    rows = scan(pieces.withColumn("_g", g).withColumn("_p", p), KEYS, "lo", ["lo"], running("g") | running("p"), span)
    rows = rows.where((F.col("_tg") > 0) & (F.col("_tp") >= 3))
    frame = F.abs(F.col("_cp") - F.col("_cg")) % 3
    if strict:
        frame = F.when(F.col("_tg") % 3 == 0, frame).otherwise(F.raise_error(F.lit("the reference's coding length is no multiple of 3")).cast("long"))
    return rows.where("_g > 0 and _p > 0").select(*KEYS, "lo", "hi", frame.cast("int").alias("frame"))


def frame_shares(found: DataFrame, by: list[str]) -> DataFrame:
    n = found.groupBy(*by, "frame").agg(F.sum(length()).cast("long").alias("n"))
    return n.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy(*by))))


