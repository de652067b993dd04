"""Incremental evaluation: mergeable state of every additive family.

The state of a family is a small table of counts, moments and histograms that add up: what one batch of sequences
contributes, and what all of them have contributed, are the same kind of table. Results are made from the state alone,
so a stream that has carried any number of sequences answers as one evaluation of all of them would.

Each micro-batch writes its own rows under its number, and a batch that is replayed writes the same rows again, so
results are exactly-once. `compact` adds the rows of finished batches up; readers see either the sum or its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import LabelConfig
from ..functions.scalars import ratio, scores
from ..functions.storage import materialized
from ..operators import perbase, runs, sections, structure
from ..sources import arrays

BY = ["predictor"]


@dataclass(frozen=True)
class Family:
    """`keys` besides the predictor; `measures` by how they merge (sum, min or max); `result` from the merged state."""

    keys: tuple[str, ...]
    measures: dict[str, str]
    result: Callable[[DataFrame], DataFrame]

    def merged(self, states: DataFrame) -> DataFrame:
        """One row a key from rows of any number of batches. Sums of whole numbers stay whole."""
        kinds = dict(states.dtypes)
        of = {"sum": F.sum, "min": F.min, "max": F.max}
        return states.groupBy(*BY, *self.keys).agg(*[of[how](c).cast(kinds[c]).alias(c) for c, how in self.measures.items()])


MOMENTS = {"n": "sum", "s": "sum", "q": "sum", "lo": "min", "hi": "max"}


def moments(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, s (sum), q (sum of squares), lo, hi: they merge, and `distribution` is made from them."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def from_moments(state: DataFrame) -> DataFrame:
    """count, mean, mae, rmse, std, min, max, as of all values at once."""
    n = F.nullif(F.col("n"), F.lit(0))
    mean = F.col("s") / n
    of = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / n - mean * mean))
    return state.select(*BY, F.col("n").alias("count"), of(mean, "mean"), of(mean, "mae"), of(F.sqrt(F.col("q") / n), "rmse"), of(spread, "std"), of(F.col("lo"), "min"), of(F.col("hi"), "max"))


def median_of(histogram: DataFrame, by: list[str], value: str, n: str) -> DataFrame:
    """by, median: exact, from counts of values."""
    up, every = W.partitionBy(*by).orderBy(value), W.partitionBy(*by)
    rows = histogram.withColumn("_upto", F.sum(n).over(up)).withColumn("_all", F.sum(n).over(every))
    at = lambda k: F.min(F.when(F.col("_upto") >= k, F.col(value)))
    low, high = at(F.floor((F.col("_all") + 1) / 2)), at(F.floor(F.col("_all") / 2) + 1)
    return rows.groupBy(*by).agg(((low + high) / 2).alias("median"))


def _indel_counts(state: DataFrame) -> DataFrame:
    by = [*BY, "kind"]
    sums = state.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.sum(F.col("n") * F.col("length")).cast("long").alias("bases"))
    return sums.join(median_of(state, by, "length", "n").withColumnRenamed("median", "median_length"), by)


def _shares(key: str) -> Callable[[DataFrame], DataFrame]:
    return lambda state: state.withColumn("share", ratio(F.col("n"), F.sum("n").over(W.partitionBy(*BY))))


def _precision_recall(state: DataFrame) -> DataFrame:
    return state.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def _same(state: DataFrame) -> DataFrame:
    return state


COUNT = {"n": "sum"}
TRIPLE = {"tp": "sum", "fp": "sum", "fn": "sum"}
#: Every family whose result is made of sums, extremes and histograms.
FAMILIES = {
    "nucleotide": Family((), {"tn": "sum", **TRIPLE}, lambda s: s.select("*", *scores())),
    "transitions": Family(("kind", "ctx", "row", "col"), COUNT, _same),
    "stable": Family(("label",), COUNT, _same),
    "indel_counts": Family(("kind", "length"), COUNT, _indel_counts),
    "region_discovery": Family(("level",), TRIPLE, _precision_recall),
    "iou_stats": Family((), MOMENTS, from_moments),
    "residuals": Family(("r5", "r3"), COUNT, _same),
    "terminal_flags": Family(("first_3_prime", "last_5_prime"), COUNT, _same),
    "frames": Family(("frame",), COUNT, _shares("frame")),
    "chains": Family(("chain",), TRIPLE, _precision_recall),
    "match_class": Family(("match_class",), COUNT, _shares("match_class")),
    "segment_delta": Family((), MOMENTS, from_moments),
    "boundary_shift": Family(("shift_count", "shift_total"), COUNT, _same),
    "soft_exons": Family(("found", "of", "hallucinated"), COUNT, _same),
    "length_emd": Family((), MOMENTS, from_moments),
    "position_bias": Family(("bin",), COUNT, _same),
}


def states(labelled: DataFrame, config: LabelConfig) -> dict[str, DataFrame]:
    """What the sequences of `labelled` (runs of both sides) contribute to each family."""
    count = F.count(F.lit(1)).alias("n")
    pieces = runs.overlay(labelled)
    cut = runs.sections(labelled, config.exon_label)
    g, p = cut.where("side = 'gt'"), cut.where("side = 'pred'")
    sequences = labelled.select(*runs.KEYS).distinct()
    pairs = sections.pairs(g, p)
    exons = structure.chain_facts(sequences, g, p)
    outcomes = structure.chain_outcomes(exons.where("n_gt > 0"), "exon_chain")
    if config.intron_label is not None:
        intron = runs.sections(labelled, config.intron_label)
        introns = structure.chain_facts(sequences, intron.where("side = 'gt'"), intron.where("side = 'pred'"))
        outcomes = structure.chain_outcomes(introns, "intron_chain").unionByName(outcomes)
    return {
        "nucleotide": perbase.nucleotide(pieces, config, BY).select(*BY, "tn", "fp", "fn", "tp"),
        "transitions": perbase.transition_counts(perbase.transitions(labelled, pieces), BY),
        "stable": perbase.stable_counts(labelled, BY),
        "indel_counts": perbase.indel(pieces, config).groupBy(*BY, "kind", perbase.length().cast("long").alias("length")).agg(count),
        "region_discovery": sections.discovery_scores(sections.discovery(sequences, g, p, pairs), BY).select(*BY, "level", "tp", "fp", "fn"),
        "iou_stats": moments(pairs, "iou", BY),
        "residuals": sections.residuals(pairs, BY),
        "terminal_flags": sections.terminal_flags(sequences, g, pairs).groupBy(*BY, "first_3_prime", "last_5_prime").agg(count),
        "frames": perbase.frame_shares(perbase.frames(pieces, config, strict=False), BY).select(*BY, "frame", "n"),
        "chains": structure.chain_scores(outcomes, BY).select(*BY, "chain", "tp", "fp", "fn"),
        "match_class": structure.match_class(exons).groupBy(*BY, "match_class").agg(count),
        "segment_delta": moments(structure.segment_delta(exons), "delta", BY),
        "boundary_shift": structure.boundary_shift(exons, g, p).groupBy(*BY, "shift_count", "shift_total").agg(count),
        "soft_exons": exons.where("n_gt > 0").groupBy(*BY, F.col("both").alias("found"), F.col("n_gt").alias("of"), F.col("pred_only").alias("hallucinated")).agg(count),
        "length_emd": moments(structure.length_emd(sequences, g, p), "emd", BY),
        "position_bias": structure.position_bias(pieces, config, BY),
    }


def merge(name: str, parts: Iterable[DataFrame]) -> DataFrame:
    """The state of a family from those of disjoint sets of sequences."""
    return FAMILIES[name].merged(reduce(DataFrame.unionByName, parts))


def result(name: str, state: DataFrame) -> DataFrame:
    return FAMILIES[name].result(state)


def start(pairs: DataFrame, config: LabelConfig, state: str, checkpoint: str, families: Iterable[str] | None = None) -> StreamingQuery:
    """Write the state of each micro-batch of a stream of (predictor, seq_id, gt, pred) to `state`/family/part=N.

    A sequence has to arrive whole, and in one batch only.
    """
    names = list(families or FAMILIES)

    def add(batch: DataFrame, number: int) -> None:
        labelled = materialized(runs.check_labels(arrays.runs(batch), config))
        found = states(labelled, config)
        for name in names:
            found[name].coalesce(1).write.mode("overwrite").parquet(f"{state}/{name}/part={number}")

    return pairs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _parts(spark: SparkSession, state: str, name: str) -> tuple[int, list[int]]:
    """(number of the last batch in the newest sum, -1 for none; numbers of the batches after it)."""
    fs, at = _files(spark, f"{state}/{name}")
    done = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    sums = [int(x.removeprefix("sum=")) for x in done if x.startswith("sum=")]
    upto = max(sums, default=-1)
    return upto, sorted(n for x in done if x.startswith("part=") and (n := int(x.removeprefix("part="))) > upto)


def read(spark: SparkSession, state: str, name: str, upto: int | None = None) -> DataFrame:
    """The merged state of a family, of batches up to a number."""
    base, parts = _parts(spark, state, name)
    paths = [f"{state}/{name}/sum={base}"] * (base >= 0) + [f"{state}/{name}/part={n}" for n in parts if upto is None or n <= upto]
    return FAMILIES[name].merged(spark.read.parquet(*paths))


def compact(spark: SparkSession, state: str, upto: int) -> None:
    """Add the batches up to a number that are finished into one table a family, and delete what it holds.

    The sum is complete before readers choose it and before its parts go; stopped in between, it is done again.
    """
    fs, root = _files(spark, state)
    for name in [s.getPath().getName() for s in fs.listStatus(root)]:
        base, parts = _parts(spark, state, name)
        own = [n for n in parts if n <= upto]
        if own:
            read(spark, state, name, upto).coalesce(1).write.mode("overwrite").parquet(f"{state}/{name}/sum={own[-1]}")
            base = own[-1]
        for s in fs.listStatus(_files(spark, f"{state}/{name}")[1]):
            kind, _, n = s.getPath().getName().partition("=")
            if (kind == "part" and int(n) <= base) or (kind == "sum" and int(n) < base):
                fs.delete(s.getPath(), True)


def current(spark: SparkSession, state: str, name: str = "nucleotide") -> DataFrame:
    """The result of a family so far."""
    return result(name, read(spark, state, name))


def in_batches(labelled: DataFrame, config: LabelConfig, name: str, batches: int, batch: Column) -> DataFrame:
    """A family's result from the states of `batches` disjoint sets of sequences; `batch` numbers them from 0."""
    parts = [states(labelled.where(batch == k), config)[name] for k in range(batches)]
    return result(name, merge(name, parts))
