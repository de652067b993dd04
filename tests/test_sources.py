"""Archives of arrays, tracks, and results that executors write."""

import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from segspan.config import FIVE_ROLES, Metric
from segspan.operators import runs, tracks
from segspan.plans.benchmark import benchmark_arrays, evaluate_runs
from segspan.sources import arrays, npz


def axes(seed, sizes):
    r = random.Random(seed)
    out = []
    for n in sizes:
        axis = []
        while len(axis) < n:
            axis += [r.choice([0, 0, 2, 8, 8])] * r.choice([1, 2, 5, 40])
        out.append(axis[:n])
    return out


def test_archives_pair_like_lists(spark, tmp_path):
    sizes = [50, 1, 333, 20]
    gt, pred = axes(1, sizes), axes(2, sizes)
    np.savez(tmp_path / "gt.npz", **{f"z{9 - k}": np.array(x, np.int64) for k, x in enumerate(gt)})
    np.savez_compressed(tmp_path / "p.npz", *[np.array(x, np.int8) for x in pred])
    np.savez(tmp_path / "mask.npz", *[np.arange(n) % 7 == 0 for n in sizes])
    rows = npz.pairs(spark, str(tmp_path / "gt.npz"), str(tmp_path / "p.npz"), str(tmp_path / "mask.npz"))
    got = {x.seq_id: (x.gt, x.pred, x["mask"]) for x in rows.collect()}
    assert got == {str(k): (g, p, [i % 7 == 0 for i in range(len(g))]) for k, (g, p) in enumerate(zip(gt, pred, strict=True))}
    mine = evaluate_runs(arrays.runs(rows.drop("mask")), FIVE_ROLES, [Metric.NUCLEOTIDE_CLASSIFICATION]).frames["nucleotide"].first()
    want = benchmark_arrays(spark, gt, pred, FIVE_ROLES, [Metric.NUCLEOTIDE_CLASSIFICATION]).frames["nucleotide"].first()
    assert mine == want
    assert {x.name for x in npz.read(spark, str(tmp_path / "gt.npz")).collect()} == {"z9", "z8", "z7", "z6"}


def test_archives_of_folders_and_odd_ones(spark, tmp_path):
    for side, seed in (("gt", 1), ("pred", 2)):
        (tmp_path / side).mkdir()
        for k in range(3):
            np.savez(tmp_path / side / f"chr{k}.npz", *[np.array(x) for x in axes(seed + k, [30, 40])])
    rows = npz.pairs(spark, str(tmp_path / "gt"), str(tmp_path / "pred"))
    assert {x.seq_id for x in rows.collect()} == {f"chr{k}.npz/{i}" for k in range(3) for i in range(2)}
    np.savez(tmp_path / "one.npz", np.zeros(3, int))
    np.savez(tmp_path / "two.npz", np.zeros(3, int), np.zeros(4, int))
    with pytest.raises(Exception, match="no partner"):
        npz.pairs(spark, str(tmp_path / "one.npz"), str(tmp_path / "two.npz")).collect()
    for bad in (np.zeros((2, 2), int), np.array([0.5, 1.0]), np.array([{}], dtype=object)):
        np.savez(tmp_path / "bad.npz", bad)
        with pytest.raises(Exception, match="dimensions|whole numbers|allow_pickle"):
            npz.read(spark, str(tmp_path / "bad.npz")).collect()


@pytest.mark.parametrize("span", [None, 16])
def test_tracks(spark, span):
    gt, pred = axes(3, [300, 40, 1]), axes(4, [300, 40, 1])
    labelled = arrays.runs(arrays.pairs(spark, gt, pred)).cache()
    flagged = tracks.segments(labelled, span).cache()
    differs = [[a != b for a, b in zip(g, p, strict=True)] for g, p in zip(gt, pred, strict=True)]
    rows = flagged.collect()
    assert len(rows) == labelled.count()
    assert all(x.mismatch == any(differs[int(x.seq_id)][x.lo : x.hi + 1]) for x in rows)
    found = tracks.tiles(flagged, base_log2=3, levels=4).collect()
    for x in found:
        size = 8 << x.level
        own = [r for r in rows if (r.seq_id, r.side, r.label) == (x.seq_id, x.side, x.label)]
        inside = [(min(r.hi, (x.tile + 1) * size - 1) - max(r.lo, x.tile * size) + 1, r) for r in own]
        assert x.bases == sum(n for n, _ in inside if n > 0) and x.flagged == sum(n for n, r in inside if n > 0 and r.mismatch)
        assert x.segments == sum(r.lo // size == x.tile for r in own)
    for level in range(4):
        assert sum(x.bases for x in found if x.level == level) == 2 * 341
    assert not tracks.segments(labelled.where("lo < 0"), span).count()


@pytest.mark.parametrize("span", [None, 16, 64])
def test_tiles_of_runs_are_those_of_segments(spark, span):
    """With a span no segment is shuffled: what is grouped by the ranges stays where it lies."""
    labelled = arrays.runs(arrays.pairs(spark, axes(3, [300, 40, 1]), axes(4, [300, 40, 1]))).cache()
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    got = tracks.run_tiles(labelled, 3, 4, span)
    assert rows(got) == rows(tracks.tiles(tracks.segments(labelled, span), 3, 4))
    if span:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "hi#" in x.split("hashpartitioning(")[1].split(")")[0] and "tile#" not in x]


def test_executors_write_what_grows(spark, tmp_path):
    gt, pred = axes(5, [60] * 8), axes(6, [60] * 8)
    result = benchmark_arrays(spark, gt, pred, FIVE_ROLES, [Metric.NUCLEOTIDE_CLASSIFICATION, Metric.INDEL], individual=True)
    files = result.write(str(tmp_path / "parts"))
    assert result.small() == [] and set(files) == set(result.frames)
    back = spark.read.json(files["nucleotide"])
    assert back.count() == 8 and {x["predictor"] for x in back.collect()} == {"pred"}
    json.dumps(result.nested(["nucleotide"]))
    assert set(benchmark_arrays(spark, gt, pred, FIVE_ROLES, [Metric.INDEL]).small()) == {"transitions", "stable", "indel_counts"}


def test_long_axes_warn_and_are_cut(spark, monkeypatch):
    """Ranges and plain windows give one result; inference on long axes says what it does."""
    from segspan.plans import benchmark

    labelled = arrays.runs(arrays.pairs(spark, axes(7, [400, 90]), axes(8, [400, 90])))
    metrics = [Metric.NUCLEOTIDE_CLASSIFICATION, Metric.INDEL, Metric.FRAMESHIFT]
    of = lambda e: {n: sorted(map(str, e.frames[n].collect())) for n in ("nucleotide", "indel", "transitions")}
    want = of(evaluate_runs(labelled, FIVE_ROLES, metrics))
    monkeypatch.setattr(benchmark, "SPAN", 32)
    assert of(evaluate_runs(labelled, FIVE_ROLES, metrics)) == want
    with pytest.warns(UserWarning, match="400 positions"):
        evaluate_runs(labelled, FIVE_ROLES, metrics, infer_introns=True, large=300)


def test_dense_arrays_in_batches(spark, monkeypatch):
    """Runs painted and encoded, or counted, in batches: as by position, without a function called for each position."""
    monkeypatch.setattr(runs, "PAINTED", 50)
    table = arrays.pairs(spark, axes(7, [400, 90, 1, 0]), axes(8, [400, 90, 1, 0]))
    labelled = arrays.runs(table)
    again = runs.repainted(labelled, runs.SIDE)
    assert sorted(map(tuple, again.select(labelled.columns).collect())) == sorted(map(tuple, labelled.collect()))
    counts = arrays.painted_confusion(labelled)
    assert counts.schema["gt"].dataType == labelled.schema["label"].dataType
    want = Counter((g, p) for row in table.collect() for g, p in zip(row.gt, row.pred, strict=True))
    assert {(x.gt, x.pred): x.n for x in counts.collect()} == want
    odd = spark.createDataFrame([(1, [None, 3, 3, None, 3, 4]), (2, []), (3, None), (4, [7])], "k int, labels array<int>")
    assert sorted(map(tuple, runs.rle(odd, "labels", ["k"]).collect()), key=lambda x: (x[0], x[2])) == [(1, None, 0, 4), (1, 4, 5, 5), (4, 7, 0, 0)]
    for df in (again, counts, runs.rle(odd, "labels", ["k"])):
        assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="different length"):
        arrays.painted_confusion(labelled.where("side = 'gt' or seq_id <> '1'")).collect()


def test_wide_labels_are_counted():
    batch = pa.RecordBatch.from_pydict({"predictor": ["a", None], "gt": [[10**9, 5, 5], [-7]], "pred": [[0, 10**6, 10**6], [3]]})
    got = [tuple(x.values()) for b in arrays.confusion(iter([batch])) for x in b.to_pylist()]
    assert sorted(got, key=str) == sorted([("a", 10**9, 0, 1), ("a", 5, 10**6, 2), (None, -7, 3, 1)], key=str)
