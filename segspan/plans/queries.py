"""Registered queries: every operator over the segmentations and annotations derived from lineitem."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import FIVE_ROLES, LabelConfig, LocusMatching
from ..functions.storage import materialized, scratch
from ..operators import annotation, mapping, perbase, runs, sections, structure, tracks
from ..sources import arrays, fixtures, gff
from ..streaming import incremental
from . import oracle

BY = ["predictor"]
BINARY = LabelConfig(8, 0, 2)
EXON, MRNA = ["exon"], ["mRNA"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to fixed decimals: sums of doubles depend on their order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _runs(spark: SparkSession, sf_dir: str, introns: bool = True) -> DataFrame:
    return runs.label_runs(fixtures.axes(spark, sf_dir), fixtures.sections(spark, sf_dir), FIVE_ROLES, introns)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.overlay(_runs(spark, sf_dir))


def _both_sides(spark: SparkSession, sf_dir: str, label: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sequences, sections of both sides) of one label."""
    return fixtures.axes(spark, sf_dir).where("side = 'gt'").select(*runs.KEYS), runs.sections(_runs(spark, sf_dir), label)


def _sides(spark: SparkSession, sf_dir: str, label: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sequences, reference sections, predicted sections) of one label."""
    sequences, s = _both_sides(spark, sf_dir, label)
    return sequences, s.where("side = 'gt'"), s.where("side = 'pred'")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, p = _sides(spark, sf_dir)
    return sections.pairs(g, p)


def _facts(spark: SparkSession, sf_dir: str, label: int = 0) -> DataFrame:
    return structure.chain_facts(*_both_sides(spark, sf_dir, label))


def _annotations(spark: SparkSession, sf_dir: str, again: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, reference transcripts, predicted transcripts); `again`: the features are read more than once."""
    f = fixtures.features(spark, sf_dir)
    f = materialized(f) if again else f
    t = materialized(mapping.transcripts(f, mapping.intron_chains(f, EXON), MRNA))  # many branches read them
    return f, t.where("source = 'gt'"), t.where("source <> 'gt'")


def _predictors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p1",), ("p2",)], "predictor string")


@query
def nucleotide_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perbase.nucleotide(_pieces(spark, sf_dir), FIVE_ROLES, BY))


@query
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs painted to dense arrays and encoded again."""
    again = runs.repainted(_runs(spark, sf_dir), runs.SIDE)
    return again.groupBy("predictor", "side", "label").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(perbase.length()).cast("long").alias("bases"), F.sum(F.col("lo") * 7 + F.col("hi")).cast("long").alias("checksum"))


@query
def coding_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sections(_runs(spark, sf_dir), 0).select("predictor", "seq_id", "side", F.col("idx").cast("long").alias("idx"), "lo", "hi")


@query
def overlay_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perbase.label_confusion(_pieces(spark, sf_dir), BY)


@query
def mask_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = runs.chunked(_runs(spark, sf_dir), fixtures.masks(spark, sf_dir), fixtures.axes(spark, sf_dir))
    return rounded(perbase.nucleotide(runs.overlay(cut), FIVE_ROLES, ["predictor", "chunk_id"]))


@query
def intron_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = runs.coding_gaps(_runs(spark, sf_dir), FIVE_ROLES)
    return gaps.groupBy("predictor", "side", "seq_id").agg(F.count(F.lit(1)).alias("n"), F.min("length").cast("int").alias("shortest"), F.max("length").cast("int").alias("longest"))


@query
def intron_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.gap_cutoffs(runs.coding_gaps(_runs(spark, sf_dir), FIVE_ROLES)).select("predictor", "side", "seq_id", "cutoff")


@query
def inferred_introns(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = runs.infer_introns(_runs(spark, sf_dir, introns=False), FIVE_ROLES, axes=fixtures.axes(spark, sf_dir))
    return filled.groupBy("predictor", "side", "label").agg(F.sum(perbase.length()).cast("long").alias("bases"))


def _indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perbase.indel(_pieces(spark, sf_dir), FIVE_ROLES)


@query
def indel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indel(spark, sf_dir).drop("chunk_id")


@query
def indel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perbase.indel_counts(_indel(spark, sf_dir), BY)


@query
def indel_length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perbase.indel_length_histogram(_indel(spark, sf_dir))


@query
def section_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
    return rounded(_pairs(spark, sf_dir).select("predictor", "seq_id", *long("g_idx", "p_idx", "bases", "r5", "r3"), "iou"))


@query
def iou_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sections.iou_stats(_pairs(spark, sf_dir), BY))


@query
def iou_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sections.iou_survival(_pairs(spark, sf_dir), BY))


@query
def boundary_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.residuals(_pairs(spark, sf_dir), BY).select("predictor", F.col("r5").cast("long").alias("r5"), F.col("r3").cast("long").alias("r3"), "n")


@query
def bias_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.bias_matrix(sections.residuals(_pairs(spark, sf_dir), BY), BY)


@query
def reliability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, p = _sides(spark, sf_dir)
    n = g.groupBy("predictor").agg(F.count(F.lit(1)).alias("n_gt"))
    return rounded(sections.reliability_matrix(sections.residuals(sections.pairs(g, p), BY), n, BY))


@query
def perfect_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, p = _sides(spark, sf_dir)
    n = lambda df, name: df.groupBy("predictor").agg(F.count(F.lit(1)).alias(name))
    return n(sections.perfect(g, p), "hits").join(n(g, "n_gt"), "predictor").join(n(p, "n_pred"), "predictor")


@query
def terminal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, g, p = _sides(spark, sf_dir)
    return sections.terminal_flags(q, g, sections.pairs(g, p)).groupBy("predictor", "first_3_prime", "last_5_prime").agg(F.count(F.lit(1)).alias("n"))


@query
def region_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, g, p = _sides(spark, sf_dir)
    both = materialized(g.unionByName(p))  # four branches read it
    g, p = both.where("side = 'gt'"), both.where("side = 'pred'")
    return rounded(sections.discovery_scores(sections.discovery(q, g, p, sections.pairs(g, p)), BY))


@query
def intron_chain_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.chain_scores(structure.chain_outcomes(_facts(spark, sf_dir, 2), "intron_chain"), BY))


@query
def exon_chain_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.chain_scores(structure.chain_outcomes(_facts(spark, sf_dir), "exon_chain"), BY))


@query
def match_class_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.class_shares(structure.match_class(_facts(spark, sf_dir)), BY))


@query
def boundary_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = _both_sides(spark, sf_dir)
    return structure.boundary_shift(structure.chain_facts(q, s), s).groupBy("predictor", "shift_count", "shift_total").agg(F.count(F.lit(1)).alias("n"))


@query
def soft_exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.least(F.floor(F.col("recall") * 20), F.lit(19)).cast("int")
    return structure.soft_exons(_facts(spark, sf_dir)).groupBy("predictor", at.alias("recall_bin"), "hallucinated").agg(F.count(F.lit(1)).alias("n"))


@query
def segment_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.stats(structure.segment_delta(_facts(spark, sf_dir)), "delta", BY))


@query
def length_emd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(structure.stats(structure.length_emd(*_both_sides(spark, sf_dir)), "emd", BY), 6)


@query
def position_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.position_bias(_pieces(spark, sf_dir), FIVE_ROLES, BY)


@query
def frame_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perbase.frame_shares(perbase.frames(_pieces(spark, sf_dir), FIVE_ROLES), BY))


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    return perbase.transition_counts(perbase.transitions(r, runs.overlay(r)), BY)


@query
def gt_transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir).where("kind = 'gt'").drop("kind")


@query
def false_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir).where("kind <> 'gt'")


@query
def late_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perbase.late_total(_transitions(spark, sf_dir), BY)


@query
def false_transition_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perbase.false_by_target(_transitions(spark, sf_dir), BY)


@query
def stable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perbase.stable_counts(_runs(spark, sf_dir), BY)


@query
def intron_chain_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = mapping.intron_chains(fixtures.features(spark, sf_dir), EXON)
    text = F.array_join(F.transform("chain", lambda j: F.concat(j["d"].cast("string"), F.lit("-"), j["a"].cast("string"))), ",")
    return chains.select("source", "seqid", "parent", F.size("chain").cast("long").alias("n_introns"), text.alias("chain"))


@query
def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, p = _annotations(spark, sf_dir)
    return mapping.loci(g.unionByName(p)).groupBy("source", "seqid", "strand", "locus", "l_start", "l_stop").agg(F.count(F.lit(1)).alias("n")).drop("locus")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, p = _annotations(spark, sf_dir)
    return mapping.candidates(mapping.loci(g), p)


@query
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scored(spark, sf_dir).select("seqid", "strand", "predictor", "gt_id", "pred_id", "base_overlap", "junction_f1", "score"))


@query
def pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("predictor", "match_class").agg(F.count(F.lit(1)).alias("n"))


def _mapped(spark: SparkSession, sf_dir: str, mode: LocusMatching) -> DataFrame:
    _, g, p = _annotations(spark, sf_dir)
    return mapping.mapping(g, p, mode)


@query
def mapping_best_per_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_mapped(spark, sf_dir, LocusMatching.BEST_PER_LOCUS).select("seqid", "strand", "gt_id", "predictor", "pred_id", "match_class", "base_overlap", "junction_f1"))


@query
def mapping_full_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a match have empty names and -1."""
    rows = rounded(_mapped(spark, sf_dir, LocusMatching.FULL_DISCOVERY))
    return rows.fillna("", ["predictor", "pred_id", "match_class"]).fillna(-1, ["pred_start", "pred_stop", "base_overlap", "junction_f1"])


@query
def unmatched_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, LocusMatching.FULL_DISCOVERY).where("is_unmatched_prediction").select("seqid", "strand", "predictor", "pred_id", "gt_start", "gt_stop")


@query
def painted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, g, p = _annotations(spark, sf_dir, again=True)
    best = mapping.mapping(g, p, LocusMatching.BEST_PER_LOCUS)
    return _painted(best, f, _predictors(spark))


@query
def painted_pairs_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference with every predictor, also where it has no match, and the unmatched predictions."""
    f, g, p = _annotations(spark, sf_dir, again=True)
    cover = mapping.painted(mapping.mapping(g, p, LocusMatching.FULL_DISCOVERY), f, _predictors(spark), EXON)
    return _sums(cover)


def _painted(mapped: DataFrame, features: DataFrame, predictors: DataFrame) -> DataFrame:
    own = mapped.select("seqid", "strand", "gt_id", "predictor")
    return _sums(mapping.painted(mapped, features, predictors, EXON).join(own, ["predictor", "seqid", "strand", "gt_id"], "left_semi"))


def _sums(cover: DataFrame) -> DataFrame:
    return cover.groupBy("predictor", "side").agg(F.sum(perbase.length()).cast("long").alias("bases"), F.sum(F.expr("cast((lo + hi) * (hi - lo + 1) / 2 as long)")).alias("checksum"))


@query
def global_nucleotide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotation.nucleotide(fixtures.features(spark, sf_dir), EXON, MRNA))


@query
def global_exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotation.key_scores(annotation.exon_keys(fixtures.features(spark, sf_dir), EXON)))


@query
def global_exon_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotation.key_scores(annotation.lenient_keys(fixtures.features(spark, sf_dir), EXON)))


@query
def global_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotation.transcript(_mapped(spark, sf_dir, LocusMatching.BEST_PER_LOCUS), _predictors(spark)))


@query
def global_transcript_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotation.transcript(_mapped(spark, sf_dir, LocusMatching.FULL_DISCOVERY), _predictors(spark)))


@query
def global_gene_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, p = _annotations(spark, sf_dir)
    return rounded(annotation.gene(g, p, mapping.mapping(g, p, LocusMatching.FULL_DISCOVERY)))


@query
def global_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, g, p = _annotations(spark, sf_dir)
    return rounded(annotation.gene(g, p, mapping.mapping(g, p, LocusMatching.BEST_PER_LOCUS)))


@query
def array_pair_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides as dense arrays, counted as array pairs position by position. Runs are gathered and painted in place: no dense array is shuffled."""
    return arrays.painted_confusion(_runs(spark, sf_dir))


@query
def individual_nucleotide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(perbase.nucleotide(_pieces(spark, sf_dir), FIVE_ROLES, ["predictor", "seq_id"]))


def _one_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all orders one after the other on one axis for each predictor and side."""
    o = F.col("seq_id").cast("long") * fixtures.AXIS
    moved = {"lo": F.col("lo") + o, "hi": F.col("hi") + o, "seq_id": F.lit("all")}
    return _runs(spark, sf_dir).withColumns(moved)


#: Positions of a range of the long axes below, small enough for many ranges on small tables.
RANGE = 1 << 16


@query
def long_axis_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlay of two axes that no task holds."""
    return perbase.label_confusion(runs.overlay(_one_axis(spark, sf_dir), RANGE), BY)


@query
def long_axis_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sections of either side cover."""
    coding = _one_axis(spark, sf_dir).where("label = 0")
    return runs.interval_union(coding.select("predictor", "lo", "hi"), ["predictor"], span=RANGE)


@query
def long_axis_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loci of each source's transcripts as if all were on one strand."""
    _, g, p = _annotations(spark, sf_dir)
    placed = mapping.loci(g.unionByName(p), ["source"], 1 << 10)
    return placed.groupBy("source", "l_start", "l_stop").agg(F.count(F.lit(1)).alias("n"))


@query
def segment_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of both sides by whether the other side differs anywhere inside."""
    flagged = tracks.segments(_runs(spark, sf_dir))
    return flagged.groupBy("predictor", "side", "label", "mismatch").agg(F.count(F.lit(1)).alias("n"), F.sum(perbase.length()).cast("long").alias("bases"))


@query
def track_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four zoom levels of the long axes."""
    return tracks.run_tiles(_one_axis(spark, sf_dir), 14, 4, RANGE, fixtures.tasks(spark, sf_dir)).drop("seq_id", "chunk_id")


@query
def exon_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gff.exon_arrays(fixtures.features(spark, sf_dir).where("source = 'gt'"), MRNA).select("seq_id", *[F.col(c).cast("long").alias(c) for c in ("n", "lo", "hi")])


def _parsed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The derived annotations written as lines and parsed again."""
    f = fixtures.features(spark, sf_dir)
    write = gff.gtf_lines if kind == "gtf" else gff.lines
    out = None
    for source in ("gt", "p1", "p2"):
        one = gff.parse(write(f.where(F.col("source") == source)), kind, source)
        out = one if out is None else out.unionByName(one)
    return out.drop("ord")


@query
def gff3_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "gff3")


@query
def gtf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, "gtf")


def _files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The derived annotations written as files by the executors, a folder each, and read from there."""
    f = materialized(fixtures.features(spark, sf_dir))
    write = gff.gtf_lines if kind == "gtf" else gff.lines
    parts = []
    for source in ("gt", "p1", "p2"):
        path = scratch(spark, f"{source}.{kind}")
        write(f.where(F.col("source") == source)).orderBy("ord").select("value").write.text(path)
        parts.append(gff.observed(spark, path, source)[0])
    return reduce(DataFrame.unionByName, parts).drop("ord")


@query
def gff3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "gff3")


@query
def gtf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "gtf")


#: Families whose result is made here from the merged states of disjoint batches of sequences, and the query of all at once.
MERGED = {"nucleotide": "nucleotide_prf", "indel_counts": "indel_counts", "region_discovery": "region_discovery", "iou_stats": "iou_stats", "match_class": "match_class_dist", "segment_delta": "segment_delta_stats", "length_emd": "length_emd", "frames": "frame_percentages", "position_bias": "position_bias"}
BATCHES = 3


def _merged(family: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        labelled = materialized(_runs(spark, sf_dir))
        batch = F.pmod(F.col("seq_id").cast("long"), F.lit(BATCHES))
        return rounded(incremental.in_batches(labelled, FIVE_ROLES, family, BATCHES, batch), 6 if family == "length_emd" else 9)

    run.__name__ = f"merged_{family}"
    return run


for _family in MERGED:
    query(_merged(_family))


def oracle_sql() -> dict[str, str]:
    own = {k: v for k, v in oracle.SQL.items() if k in QUERIES}
    own |= {f"{k}_files": oracle.SQL[f"{k}_parse"] for k in ("gff3", "gtf")}
    return own | {f"merged_{k}": oracle.SQL[v] for k, v in MERGED.items()}
