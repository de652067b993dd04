"""Axes drawn here, and random ones against evaluations written per position or per set from the definitions.

In a drawing `E` is coding, `-` intron and `.` background.
"""

import math
import random

import pytest
from pyspark.sql import functions as F

from segspan.config import FIVE_ROLES, FULL_SWEEP, LabelConfig, Metric
from segspan.operators import perbase, runs, sections, structure
from segspan.plans.benchmark import benchmark_arrays, evaluate_runs
from segspan.sources import arrays

LABELS = {"E": 0, "-": 2, ".": 8}


def drawn(text):
    return [LABELS[c] for c in text]


def labelled_axes(spark, gt, pred):
    return arrays.runs(arrays.pairs(spark, gt, pred))


def spans(axis, label):
    out, k = [], 0
    while k < len(axis):
        z = k
        while z + 1 < len(axis) and axis[z + 1] == axis[k]:
            z += 1
        if axis[k] == label:
            out.append((k, z))
        k = z + 1
    return out


def random_gene(r, n=60):
    """Background, then exons with introns between them, then background."""
    out = [8] * r.randrange(6)
    for k in range(r.randrange(5)):
        out += [2] * (r.randrange(1, 6) if k else 0) + [0] * r.randrange(1, 9)
    return (out + [8] * n)[:n]


def distorted(r, axis):
    """Some ends moved, some exons dropped or joined, some invented."""
    exons = [[a + r.choice((0, 0, 0, -1, 1, 2)), z + r.choice((0, 0, 0, -1, 1, 3))] for a, z in spans(axis, 0) if r.random() > 0.15]
    if r.random() < 0.3:
        a = r.randrange(len(axis) - 5)
        exons.append([a, a + r.randrange(5)])
    out = [8] * len(axis)
    for a, z in exons:
        for k in range(max(a, 0), min(z, len(axis) - 1) + 1):
            out[k] = 0
    inside = [k for k, x in enumerate(out) if x == 0]
    if inside:
        for k in range(inside[0], inside[-1]):
            out[k] = 0 if out[k] == 0 else 2
    return out


@pytest.fixture(scope="module")
def random_pairs():
    r = random.Random(21)
    gt = [random_gene(r) for _ in range(150)]
    return gt, [distorted(r, g) for g in gt]


def mismatches(g, p):
    """(kind, lo, hi) of every stretch where exactly one side codes; agreed coding right beside it names it."""
    g, p = [x == 0 for x in g], [x == 0 for x in p]
    both = [a and b for a, b in zip(g, p, strict=True)]
    out, k = [], 0
    while k < len(g):
        z = k
        while z + 1 < len(g) and (g[z + 1], p[z + 1]) == (g[k], p[k]):
            z += 1
        if g[k] != p[k]:
            sides = (k > 0 and both[k - 1], z + 1 < len(g) and both[z + 1])
            names = ("whole_insertions", "5_prime_extensions", "3_prime_extensions", "joined") if p[k] else ("whole_deletions", "5_prime_deletions", "3_prime_deletions", "split")
            out.append((names[2 * sides[0] + sides[1]], k, z))
        k = z + 1
    return out


def test_mismatches_and_confusion(spark, random_pairs):
    gt, pred = random_pairs
    pieces = runs.overlay(labelled_axes(spark, gt, pred)).cache()
    got = sorted((int(x.seq_id), x.kind, x.lo, x.hi) for x in perbase.indel(pieces, FIVE_ROLES).collect())
    assert got == sorted((k, *m) for k, (g, p) in enumerate(zip(gt, pred, strict=True)) for m in mismatches(g, p))
    assert len({x[1] for x in got}) == 8
    counts = {int(x.seq_id): (x.tn, x.fp, x.fn, x.tp) for x in perbase.nucleotide(pieces, FIVE_ROLES, ["predictor", "seq_id"]).collect()}
    for k, (g, p) in enumerate(zip(gt, pred, strict=True)):
        cells = [2 * (a == 0) + (b == 0) for a, b in zip(g, p, strict=True)]
        assert counts[k] == tuple(cells.count(c) for c in range(4))
    pieces.unpersist()


def overlapping(g, p):
    return [(i, j, min(a[1], b[1]) - max(a[0], b[0]) + 1) for i, a in enumerate(g) for j, b in enumerate(p) if a[0] <= b[1] and b[0] <= a[1]]


def greedy(g, p):
    taken_g, taken_p, out = set(), set(), []
    for i, j, _ in sorted(overlapping(g, p), key=lambda x: (-x[2], x[0], x[1])):
        if i not in taken_g and j not in taken_p:
            taken_g.add(i)
            taken_p.add(j)
            out.append((i, j))
    return out


def test_section_pairs_and_levels(spark, random_pairs):
    gt, pred = random_pairs
    s = runs.sections(labelled_axes(spark, gt, pred), 0)
    g, p, q = s.where("side='gt'"), s.where("side='pred'"), labelled_axes(spark, gt, pred).select(*runs.KEYS).distinct()
    found = sections.pairs(g, p).cache()
    got = sorted((int(x.seq_id), x.g_idx, x.p_idx, x.bases, x.r5, x.r3, round(x.iou, 9)) for x in found.collect())
    want, levels, flags, matched = [], {}, {}, set()
    for k, (a, b) in enumerate(zip(gt, pred, strict=True)):
        gs, ps = spans(a, 0), spans(b, 0)
        for i, j, n in overlapping(gs, ps):
            (x, y), (v, w) = gs[i], ps[j]
            want.append((k, i, j, n, v - x, w - y, round(n / (max(y, w) - min(x, v) + 1), 9)))
        m = greedy(gs, ps)
        matched |= {(k, *x) for x in m}
        inside = sum(ps[j][0] >= gs[i][0] and ps[j][1] <= gs[i][1] for i, j in m)
        cover = sum(ps[j][0] <= gs[i][0] and ps[j][1] >= gs[i][1] for i, j in m)
        same = len(set(gs) & set(ps))
        free = len(ps) - len(m)
        levels[k] = {"neighborhood": (len(m), len(gs) - len(m), free), "internal": (inside, len(gs) - inside, free), "full_coverage": (cover, len(gs) - cover, free), "perfect_boundary": (same, len(gs) - same, len(ps) - same)}
        met = [(i, j) for i, j, _ in overlapping(gs, ps)]
        flags[k] = (int(any(i == 0 and ps[j][1] == gs[i][1] for i, j in met)), int(any(i == len(gs) - 1 and ps[j][0] == gs[i][0] for i, j in met)))
    assert got == sorted(want)
    assert {(int(x.seq_id), x.g_idx, x.p_idx) for x in sections.matches(found).collect()} == matched
    own: dict = {}
    for x in sections.discovery(q, g, p, found).collect():
        own.setdefault(int(x.seq_id), {})[x.level] = (x.tp, x.fn, x.fp)
    assert own == levels
    assert {int(x.seq_id): (x.first_3_prime, x.last_5_prime) for x in sections.terminal_flags(q, g, found).collect()} == flags
    found.unpersist()


def test_long_stretches_are_matched_like_short_ones(spark):
    r = random.Random(22)
    gt, pred = [], []
    for side in (gt, pred):
        for _ in range(8):
            axis = []
            while len(axis) < 300:
                axis += [0] * r.randrange(1, 12) + [8] * r.randrange(1, 3)
            side.append(axis[:300])
    s = runs.sections(labelled_axes(spark, gt, pred), 0)
    found = sections.pairs(s.where("side='gt'"), s.where("side='pred'"))
    want = {(k, *x) for k, (a, b) in enumerate(zip(gt, pred, strict=True)) for x in greedy(spans(a, 0), spans(b, 0))}
    assert {(int(x.seq_id), x.g_idx, x.p_idx) for x in sections.matches(found).collect()} == want


def test_many_sections_in_one_sequence(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("p").alias("predictor"), F.lit("s").alias("seq_id"), F.lit(0).alias("chunk_id"), F.col("id").cast("int").alias("idx"), (F.col("id") * 10).cast("int").alias("lo"))
    g = rows.withColumn("side", F.lit("gt")).withColumn("hi", F.col("lo") + 5)
    p = rows.withColumn("side", F.lit("pred")).withColumn("lo", F.col("lo") + 1).withColumn("hi", F.col("lo") + 9)
    found = sections.pairs(g, p)
    assert found.count() == 2 * n - 1  # each prediction reaches into the next section
    assert sections.matches(found).count() == n


def test_chains(spark, random_pairs):
    gt, pred = random_pairs
    labelled = labelled_axes(spark, gt, pred).cache()
    q = labelled.select(*runs.KEYS).distinct()
    side = lambda label: [runs.sections(labelled, label).where(f"side='{s}'") for s in ("gt", "pred")]
    exons = structure.chain_facts(q, *side(0)).cache()
    outcomes = structure.chain_outcomes(exons, "e").unionByName(structure.chain_outcomes(structure.chain_facts(q, *side(2)), "i"))
    got = {(int(x.seq_id), x.chain): (x.tp, x.fp, x.fn) for x in outcomes.collect()}
    classes = {int(x.seq_id): x.match_class for x in structure.match_class(exons).collect()}
    shifts = {int(x.seq_id): (x.shift_count, x.shift_total) for x in structure.boundary_shift(exons, *side(0)).collect()}
    emd = {int(x.seq_id): x.emd for x in structure.length_emd(q, *side(0)).collect()}
    soft = {int(x.seq_id): (x.recall, x.hallucinated) for x in structure.soft_exons(exons).collect()}
    for k, (g, p) in enumerate(zip(gt, pred, strict=True)):
        for name, label in (("e", 0), ("i", 2)):
            a, b = set(spans(g, label)), set(spans(p, label))
            for suffix, hit in (("", a == b), ("_subset", bool(b) and b <= a), ("_superset", bool(b) and a <= b)):
                assert got[k, name + suffix] == ((int(hit), int(not hit), int(not hit)) if a else (0, 0, 0)), (k, name, suffix)
        a, b = spans(g, 0), spans(p, 0)
        if not a:
            assert k not in classes and emd[k] == 0
            continue
        if not b:
            want = "missed"
        elif a == b:
            want = "exact"
        elif len(a) == len(b):
            want = "boundary_shift_internal" if (a[0][0], a[-1][1]) == (b[0][0], b[-1][1]) else "boundary_shift_terminal"
        elif set(b) < set(a):
            want = "missing_segments"
        elif set(a) < set(b):
            want = "extra_segments"
        else:
            want = "partial_overlap" if set(a) & set(b) else "no_overlap"
        assert classes[k] == want
        moved = [abs(x - y) for u, v in zip(a, b, strict=True) for x, y in zip(u, v, strict=True)] if len(a) == len(b) else []
        assert shifts[k] == (sum(m > 0 for m in moved), sum(moved))
        assert soft[k] == (len(set(a) & set(b)) / len(a), len(set(b) - set(a)))
        if b:
            share = lambda own, top: sum(z - x + 1 <= top for x, z in own) / len(own)
            assert math.isclose(emd[k], sum(abs(share(a, t) - share(b, t)) for t in range(61)), abs_tol=1e-9)
    assert len(set(classes.values())) >= 6
    exons.unpersist()
    labelled.unpersist()


# name: (reference, prediction, mismatches, (first 3', last 5'), IoUs)
DRAWN = {
    "moved ends": (".EEEE--EEE..", "..EEE--EEEE.", {("5_prime_deletions", 1, 1), ("3_prime_extensions", 10, 10)}, (1, 1), [3 / 4, 3 / 4]),
    "bridge": ("EEE---EEE....EE", "EEEEEEEEE.EE...", {("joined", 3, 5), ("whole_insertions", 10, 11), ("whole_deletions", 13, 14)}, (0, 0), [3 / 9, 3 / 9]),
    "gap": ("..EEEEEE..", "..EE--EE..", {("split", 4, 5)}, (1, 1), [2 / 6, 2 / 6]),
    "nothing predicted": ("..EE.EE.", "........", {("whole_deletions", 2, 3), ("whole_deletions", 5, 6)}, (0, 0), []),
    "nothing there": ("........", ".EEE..E.", {("whole_insertions", 1, 3), ("whole_insertions", 6, 6)}, (0, 0), []),
    "whole axis": ("EEEE", "EEEE", set(), (1, 1), [1.0]),
}


@pytest.mark.parametrize("name", DRAWN)
def test_drawings(spark, name):
    gt, pred, kinds, flags, ious = DRAWN[name]
    labelled = labelled_axes(spark, [drawn(gt)], [drawn(pred)])
    assert {(x.kind, x.lo, x.hi) for x in perbase.indel(runs.overlay(labelled), FIVE_ROLES).collect()} == kinds
    s = runs.sections(labelled, 0)
    g, p, q = s.where("side='gt'"), s.where("side='pred'"), labelled.select(*runs.KEYS).distinct()
    found = sections.pairs(g, p)
    f = sections.terminal_flags(q, g, found).first()
    assert (f.first_3_prime, f.last_5_prime) == flags
    assert sorted(x.iou for x in found.collect()) == pytest.approx(sorted(ious))


def test_other_labels(spark):
    """The same drawing with labels of one's own gives the same mismatches."""
    gt, pred, kinds, *_ = DRAWN["bridge"]
    own = {"E": 7, "-": 40, ".": -3}
    labelled = labelled_axes(spark, [[own[c] for c in gt]], [[own[c] for c in pred]])
    assert {(x.kind, x.lo, x.hi) for x in perbase.indel(runs.overlay(labelled), LabelConfig(-3, 7, 40)).collect()} == kinds


def test_frames(spark):
    """One intron base is predicted as coding, so the second exon is one base out of frame."""
    labelled = labelled_axes(spark, [drawn("..EEE-EEE.")], [drawn("..EEEEEEE.")])
    assert sorted((x.lo, x.hi, x.frame) for x in perbase.frames(runs.overlay(labelled), FIVE_ROLES).collect()) == [(2, 4, 0), (6, 8, 1)]
    odd = labelled_axes(spark, [drawn("..EEEE....")], [drawn("..EEE.....")])
    with pytest.raises(Exception, match="multiple of 3"):
        perbase.frames(runs.overlay(odd), FIVE_ROLES).collect()


def test_position_bias(spark):
    """A coding span of ten positions: one mismatched position is one tenth of the way along."""
    labelled = labelled_axes(spark, [drawn(".E--------E.")], [drawn(".E--E-----E.")])
    got = {x.bin: x.n for x in structure.position_bias(runs.overlay(labelled), FIVE_ROLES, ["predictor"]).where("n > 0").collect()}
    assert got == {30: 1}


def test_masks(spark):
    gt, pred = "EE..EEE...EE", "EE..EE....E."
    mask = [c == "x" for c in "....xxxx...."]
    table = arrays.pairs(spark, [drawn(gt)], [drawn(pred)], [mask])
    result = evaluate_runs(arrays.runs(table), FIVE_ROLES, [Metric.NUCLEOTIDE_CLASSIFICATION], arrays.masks(table), individual=True)
    rows = sorted((x.chunk_id, x.tn, x.fp, x.fn, x.tp) for x in result.frames["nucleotide"].collect())
    assert rows == [(0, 2, 0, 0, 2), (1, 2, 0, 1, 1)]


def test_whole_evaluation(spark):
    one, other = "..EEE--EEE..E...", "..EEE--EEE.....E"
    gt, pred = [drawn(one), drawn("EE----EE........")], [drawn(one), drawn("................")]
    result = benchmark_arrays(spark, gt, pred, FIVE_ROLES, [m for m in FULL_SWEEP if m is not Metric.FRAMESHIFT])
    nested = result.nested()["pred"]
    assert {x["level"]: (x["tp"], x["fn"]) for x in nested["region_discovery"]} == {k: (3, 2) for k in sections.LEVELS}
    assert {x["match_class"]: x["n"] for x in nested["match_class"]} == {"exact": 1, "missed": 1}
    assert result.scalars().where("metric_group = 'nucleotide' and metric_key = 'precision'").first().value == 1.0
    single = benchmark_arrays(spark, [drawn(one)], [drawn(other)], FIVE_ROLES, [Metric.NUCLEOTIDE_CLASSIFICATION], individual=True).nested()["pred"]["nucleotide"]
    assert [(x["seq_id"], x["tp"], x["fp"], x["fn"]) for x in single] == [("0", 6, 1, 1)]


def test_errors(spark):
    with pytest.raises(ValueError):
        arrays.pairs(spark, [[0]], [])
    with pytest.raises(ValueError):
        arrays.pairs(spark, [[0, 8]], [[0]])
    with pytest.raises(ValueError):
        LabelConfig(4, 4)
    labelled = labelled_axes(spark, [drawn("E..EE")], [drawn(".....")])
    with pytest.raises(ValueError, match="gt"):
        structure.require_introns(labelled, FIVE_ROLES)
    with pytest.raises(Exception, match="label without a role"):
        runs.check_labels(labelled_axes(spark, [[6]], [[0]]), FIVE_ROLES).collect()


def test_cutoffs(spark):
    """Gap lengths without a jump: twenty times the median of the lower half; with one: between both kinds."""

    def cutoff(lengths):
        rows, at = [], 0
        for n in [*lengths, 0]:
            rows.append(("p", "s", 0, "gt", at, at))
            at += n + 1
        df = spark.createDataFrame(rows, "predictor string, seq_id string, chunk_id int, side string, lo int, hi int").withColumn("label", F.lit(0))
        return runs.gap_cutoffs(runs.coding_gaps(df, FIVE_ROLES)).first().cutoff

    assert cutoff([30, 33, 36, 39]) == 20 * 31.5
    assert cutoff([30, 900, 33, 1000]) == math.floor(math.sqrt(33 * 900))


def test_gaps_that_stay_on_large_axes(spark):
    """Cutoffs are read for large axes only; given their lengths, other runs are not read for them at all."""
    def axis(gaps, n):
        a = [0, 0]
        for g in gaps:
            a += [8] * g + [0, 0]
        return [8, *a] + [8] * (n - len(a) - 1)

    labels = [axis([2, 3, 2, 60, 3], 300), axis([2, 3, 2, 60, 3], 100), axis([70], 300), axis([], 300), axis([1, 80, 1], 300)]
    labelled = labelled_axes(spark, labels, labels)
    lengths = labelled.groupBy(*runs.SIDE).agg((F.max("hi") + 1).alias("n"))
    rows = lambda df: sorted(map(tuple, df.select(*runs.SIDE, "label", "lo", "hi").collect()))
    got = rows(runs.infer_introns(labelled, FIVE_ROLES, large=300, axes=lengths))
    assert got == rows(runs.infer_introns(labelled, FIVE_ROLES, large=300))
    gaps = lambda k: sorted((lo, hi, label) for _, s, _, side, label, lo, hi in got if s == str(k) and side == "gt" and label != 0 and lo and hi < len(labels[k]) - 1)
    assert [label for _, _, label in gaps(0)] == [2, 2, 2, 8, 2] and {label for _, _, label in gaps(1)} == {2}
    assert [label for _, _, label in gaps(2)] == [2] and gaps(3) == [] and [label for _, _, label in gaps(4)] == [2, 8, 2]
    short = lengths.select(*runs.SIDE, F.lit(300).alias("n"))
    plan = runs.infer_introns(labelled, FIVE_ROLES, axes=short)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
