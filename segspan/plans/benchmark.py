"""Whole evaluations: paired arrays or annotation files in, one DataFrame per metric family out.

Families that are not asked for are never planned. `nested` brings results to the driver as a dictionary, for
those that are `small`; `write` has the executors write those that grow with the sequences.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ARRAY_DEFAULTS, GFF_DEFAULTS, LARGE_AXIS, LabelConfig, LocusMatching, Metric
from ..functions.storage import materialized
from ..operators import annotation, mapping, perbase, runs, sections, structure
from ..operators.scan import SPAN
from ..sources import arrays, gff

AGGREGATE = ["predictor"]


@dataclass
class Evaluation:
    """Lazy result frames by name, grouped by predictor, or by sequence and chunk if `individual`."""

    config: LabelConfig
    frames: dict[str, DataFrame] = field(default_factory=dict)
    mapped: DataFrame | None = None

    def nested(self, names: Iterable[str] | None = None) -> dict[str, dict[str, list[dict]]]:
        """predictor -> family -> rows, on the driver: of all families, or of those named, such as the `small` ones."""
        out: dict[str, dict[str, list[dict]]] = {}
        for name in self.frames if names is None else names:
            for row in self.frames[name].toLocalIterator():
                r = row.asDict(recursive=True)
                out.setdefault(r.pop("predictor"), {}).setdefault(name, []).append(r)
        return out

    def small(self) -> list[str]:
        """Families whose rows do not grow with the sequences: none if `individual`."""
        return [n for n, df in self.frames.items() if "seq_id" not in df.columns]

    def write(self, path: str) -> dict[str, str]:
        """Families that grow with the sequences as JSON lines, written by the executors, a folder for each family and
        predictor; family -> folder."""
        out = {}
        for name in self.frames.keys() - set(self.small()):
            out[name] = f"{path}/{name}"
            self.frames[name].write.mode("overwrite").partitionBy("predictor").json(out[name])
        return dict(sorted(out.items()))

    def scalars(self) -> DataFrame:
        """The tidy frame of all numbers: predictor, metric_group, metric_key, value."""
        parts = []
        for name, df in self.frames.items():
            numbers = [c for c, t in df.dtypes if t in ("double", "bigint", "int", "float") and c not in ("ctx", "row", "col", "label", "bin", "r5", "r3", "t5", "t3", "seq_id", "chunk_id")]
            labels = [c for c in df.columns if c not in numbers and c not in ("predictor",)]
            key = lambda n: F.concat_ws("/", *[F.col(c).cast("string") for c in labels], F.lit(n))  # noqa: E731, B023
            values = F.array(*[F.struct(key(n).alias("metric_key"), F.col(n).cast("double").alias("value")) for n in numbers])
            parts.append(df.select("predictor", F.lit(name).alias("metric_group"), F.inline(values)))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


# The scalars logged during training, as (family, level or chain, number).
ONLINE_SCALARS = [("iou_stats", "", "mean")] + [(f, x, m) for f, xs in (("region_discovery", ("full_coverage", "internal", "neighborhood", "perfect_boundary")), ("chains", ("intron_chain", "exon_chain"))) for x in xs for m in ("precision", "recall")]


def online_scalars(evaluation: Evaluation) -> DataFrame:
    """The 13 scalars worth logging at every step."""
    keys = [f"{f}|{x + '/' if x else ''}{m}" for f, x, m in ONLINE_SCALARS]
    return evaluation.scalars().where(F.concat_ws("|", "metric_group", "metric_key").isin(keys))


def families(labelled: DataFrame, config: LabelConfig, metrics: Iterable[Metric], individual: bool = False, span: int | None = None) -> dict[str, DataFrame]:
    """All frames for runs of both sides. Transitions are always there. `span`: positions of a range, for long axes."""
    metrics = set(metrics)
    by = [*AGGREGATE, "seq_id", "chunk_id"] if individual else AGGREGATE
    pieces = runs.overlay(labelled, span)
    events = perbase.transitions(labelled, pieces)
    out = {"transitions": perbase.transition_counts(events, by), "stable": perbase.stable_counts(labelled, by)}
    sequences = labelled.select(*runs.KEYS).distinct()
    cut = runs.sections(labelled, config.exon_label)
    g, p = cut.where("side = 'gt'"), cut.where("side = 'pred'")
    if Metric.NUCLEOTIDE_CLASSIFICATION in metrics:
        out["nucleotide"] = perbase.nucleotide(pieces, config, by)
    if Metric.INDEL in metrics:
        found = perbase.indel(pieces, config, span)
        out |= {"indel": found, "indel_counts": perbase.indel_counts(found, by)}
    if metrics & {Metric.REGION_DISCOVERY, Metric.BOUNDARY_EXACTNESS}:
        pairs = sections.pairs(g, p)
        if Metric.REGION_DISCOVERY in metrics:
            out["region_discovery"] = sections.discovery_scores(sections.discovery(sequences, g, p, pairs), by)
        if Metric.BOUNDARY_EXACTNESS in metrics:
            residuals = sections.residuals(pairs, by)
            n = sequences.select(*by).distinct().join(g.groupBy(*by).agg(F.count(F.lit(1)).alias("n_gt")), by, "left").fillna(0)
            out |= {
                "iou_stats": sections.iou_stats(pairs, by),
                "bias": sections.bias_matrix(residuals, by),
                "reliability": sections.reliability_matrix(residuals, n, by),
                "terminal_flags": sections.terminal_flags(sequences, g, pairs),
            }
    if Metric.FRAMESHIFT in metrics:
        out["frames"] = perbase.frame_shares(perbase.frames(pieces, config, span=span), by)
    if Metric.STRUCTURAL_COHERENCE in metrics:
        structure.require_introns(labelled, config)
        intron = runs.sections(labelled, config.intron_label)
        exons = structure.chain_facts(sequences, g, p)
        introns = structure.chain_facts(sequences, intron.where("side = 'gt'"), intron.where("side = 'pred'"))
        outcomes = structure.chain_outcomes(introns, "intron_chain").unionByName(structure.chain_outcomes(exons.where("n_gt > 0"), "exon_chain"))
        out |= {
            "chains": structure.chain_scores(outcomes, by),
            "match_class": structure.class_shares(structure.match_class(exons), by),
            "segment_delta": structure.stats(structure.segment_delta(exons), "delta", by),
            "boundary_shift": structure.boundary_shift(exons, g, p),
            "soft_exons": structure.soft_exons(exons),
        }
    if Metric.DIAGNOSTIC_DEPTH in metrics:
        out |= {"length_emd": structure.stats(structure.length_emd(sequences, g, p), "emd", by), "position_bias": structure.position_bias(pieces, config, by)}
    return out


def evaluate_runs(labelled: DataFrame, config: LabelConfig, metrics: Iterable[Metric] | None = None, masks: DataFrame | None = None, infer_introns: bool = False, individual: bool = False, large: int = LARGE_AXIS) -> Evaluation:
    """Introns are inferred on whole sequences, then masks cut them into chunks that count as sequences."""
    labelled = runs.check_labels(labelled, config)
    if infer_introns:
        labelled = runs.infer_introns(labelled, config, large)
    if masks is not None:
        axes = labelled.groupBy("seq_id").agg((F.max("hi") + 1).alias("n"))
        labelled = runs.chunked(labelled, masks, axes)
    labelled = materialized(labelled)
    # One number: axes that are long enough are cut into ranges, short ones are plain windows; results are the same.
    longest = (labelled.agg(F.max("hi")).first()[0] or 0) + 1
    if infer_introns and longest >= large:
        warnings.warn(f"introns are inferred on axes of up to {longest} positions: only gaps up to a cutoff are filled where an axis has {large} or more", stacklevel=2)
    return Evaluation(config, families(labelled, config, metrics or ARRAY_DEFAULTS, individual, SPAN if longest > SPAN else None))


def benchmark_arrays(spark: SparkSession, gt: Sequence[Sequence[int]], pred: Sequence[Sequence[int]], config: LabelConfig, metrics: Iterable[Metric] | None = None, masks: Sequence[Sequence[bool]] | None = None, infer_introns: bool = False, individual: bool = False, predictor: str = "pred") -> Evaluation:
    table = arrays.pairs(spark, gt, pred, masks, predictor)
    return evaluate_runs(arrays.runs(table), config, metrics, arrays.masks(table) if masks is not None else None, infer_introns, individual)


def _types(value: str | Sequence[str]) -> list[str]:
    types = [value] if isinstance(value, str) else list(value)
    if not types or not all(isinstance(t, str) and t for t in types):
        raise ValueError("feature types must be a name or a list of names")
    return types


def with_exon_types(features: DataFrame, exon_types: list[str], own: dict[str, list[str]]) -> DataFrame:
    """Features whose exons are all of the type `exon`: what `own` names for their source, else `exon_types`. A type `exon` that is not meant becomes `other exon`."""
    meant = F.col("type").isin(*exon_types)
    for source, types in own.items():
        meant = F.when(F.col("source") == source, F.col("type").isin(*types)).otherwise(meant)
    return features.withColumn("type", F.when(meant, "exon").when(F.col("type") == "exon", "other exon").otherwise(F.col("type")))


def benchmark_features(
    features: DataFrame,
    config: LabelConfig,
    metrics: Iterable[Metric] | None = None,
    transcript_types: str | Sequence[str] = ("mRNA", "transcript"),
    exon_types: str | Sequence[str] = "exon",
    mode: LocusMatching = LocusMatching.FULL_DISCOVERY,
    infer_introns: bool = True,
    individual: bool = False,
    gt_source: str = "gt",
    own_exon_types: dict[str, str | Sequence[str]] | None = None,
    stored: bool = False,
) -> Evaluation:
    """Per-transcript and annotation-wide families for features of a reference (source `gt`) and predictors.

    `own_exon_types` names the exon types of single sources, the reference among them; others have `exon_types`.
    `stored`: the features are a table already.
    """
    transcript_types, exon_types = _types(transcript_types), _types(exon_types)
    if own_exon_types:
        features = with_exon_types(features, exon_types, {k: _types(v) for k, v in own_exon_types.items()})
        exon_types = ["exon"]
    if not stored:
        features = materialized(features)
    t = mapping.transcripts(features, mapping.intron_chains(features, exon_types), transcript_types)
    t = materialized(t)
    gt, pred = t.where(F.col("source") == gt_source), t.where(F.col("source") != gt_source)
    mapped = materialized(mapping.mapping(gt, pred, mode))
    predictors = features.where(F.col("source") != gt_source).select(F.col("source").alias("predictor")).distinct()
    if mapped.isEmpty():
        raise ValueError("no transcript of the reference or a prediction could be mapped")
    keys = ["predictor", "seqid", "strand", "gt_id"]
    seq = F.concat_ws("|", "seqid", "strand", "gt_id").alias("seq_id")
    windows = mapping.pair_windows(mapped, predictors)
    if mode is LocusMatching.BEST_PER_LOCUS:
        windows = windows.join(mapped.select(*keys), keys, "left_semi")
    sides = F.explode(F.array(F.lit("gt"), F.lit("pred")))
    axes = windows.select("predictor", seq, F.lit(0).alias("chunk_id"), sides.alias("side"), "n")
    cover = mapping.painted(mapped, features, predictors, exon_types, gt_source).select("predictor", seq, F.lit(0).alias("chunk_id"), "side", "lo", "hi")
    labelled = runs.label_runs(axes, cover, config, introns=False)
    out = evaluate_runs(labelled, config, metrics or GFF_DEFAULTS, None, infer_introns, individual)
    out.mapped = mapped
    if not individual:
        out.frames |= {
            "global_nucleotide": annotation.nucleotide(features, exon_types, transcript_types, gt_source),
            "global_exon": annotation.key_scores(annotation.exon_keys(features, exon_types), gt_source),
            "global_exon_lenient": annotation.key_scores(annotation.lenient_keys(features, exon_types), gt_source),
            "global_transcript": annotation.transcript(mapped, predictors),
            "global_gene": annotation.gene(gt, pred, mapped),
        }
    return out


def benchmark_gff(spark: SparkSession, gt_path: str, pred_paths: dict[str, str], config: LabelConfig, exclude: Iterable[str] = (), **options) -> Evaluation:
    """Each file is scanned by one reader, and predictors are one table. Files that can't be read are an error, odd lines a warning."""
    exclude = list(exclude)
    if "gt" in pred_paths:
        raise ValueError("a predictor can't be named gt")
    unknown = set(options.get("own_exon_types") or ()) - {"gt", *pred_paths}
    if unknown:
        raise ValueError(f"exon types for {', '.join(sorted(unknown))}, which is no predictor")
    paths = {"gt": gt_path, **pred_paths}
    parts = {name: gff.observed(spark, path, name, exclude) for name, path in paths.items()}
    # One scan of each file writes the features and counts its lines.
    features = materialized(reduce(DataFrame.unionByName, [df for df, _ in parts.values()]))
    for name, (_, seen) in parts.items():
        gff.judge(paths[name], seen.get)
    return benchmark_features(features, config, stored=True, **options)
