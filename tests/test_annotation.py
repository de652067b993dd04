"""Annotation files end to end."""

import pytest

from segspan import cli
from segspan.config import FIVE_ROLES, LocusMatching, Metric
from segspan.operators import assignment, mapping
from segspan.plans.benchmark import benchmark_gff
from segspan.sources import gff, sinks


def row(seqid, kind, start, stop, strand, attributes):
    return "\t".join([seqid, ".", kind, str(start), str(stop), ".", strand, ".", attributes])


GT = "\n".join([
    "##gff-version 3",
    row("chr1", "gene", 1, 100, "+", "ID=g1"),
    row("chr1", "mRNA", 1, 100, "+", "ID=m1;Parent=g1"),
    row("chr1", "exon", 10, 30, "+", "Parent=m1,m9"),
    row("chr1", "exon", 50, 70, "+", "Parent=m1"),
    row("chr1", "mRNA", 200, 400, "-", "ID=m2"),
    row("chr1", "exon", 250, 300, "-", "Parent=m2"),
    row("chr2", "mRNA", 1, 50, "+", "ID=m3"),
    row("chr2", "exon", 5, 20, "+", "Parent=m3"),
])
PRED = "\n".join([
    row("chr1", "mRNA", 5, 90, "+", "ID=a1"),
    row("chr1", "exon", 10, 30, "+", "Parent=a1"),
    row("chr1", "exon", 50, 75, "+", "Parent=a1"),
    row("chr1", "mRNA", 500, 600, "+", "ID=a2"),
    row("chr1", "exon", 520, 560, "+", "Parent=a2"),
    row("chr1", "mRNA", 210, 380, "+", "ID=a3"),
])
GTF = "\n".join([row("chr1", "transcript", 5, 90, "+", 'gene_id "x"; transcript_id "T1";'), row("chr1", "exon", 10, 30, "+", 'gene_id "x"; transcript_id "T1";')])


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "gt.gff3").write_text(GT)
    (tmp_path / "pred.gff3").write_text(PRED)
    (tmp_path / "other.gtf").write_text(GTF)
    return tmp_path


def test_parse(spark, files):
    rows = gff.read(spark, str(files / "gt.gff3"), "gt", ["gene"]).collect()
    assert len(rows) == 7 and {r.parent for r in rows if r.type == "exon"} == {"m1", "m2", "m3"}
    assert gff.annotation_format("a.GTF.gz") == "gtf" and gff.annotation_format("gtf.gff") == "gff3"
    t = gff.read(spark, str(files / "other.gtf"), "p").collect()
    assert {(r.gff_id, r.parent) for r in t} == {("T1", "T1")}


def test_painting(spark, files):
    cover = gff.exon_arrays(gff.read(spark, str(files / "gt.gff3"), "gt"), ["mRNA"], ["gene"]).orderBy("seq_id", "lo").collect()
    assert [(r.seq_id, r.n, r.lo, r.hi) for r in cover] == [("m1_+", 100, 9, 29), ("m1_+", 100, 49, 69), ("m2_-", 201, 50, 100), ("m3_+", 50, 4, 19)]


def test_mapping_and_scores(spark, files):
    result = benchmark_gff(spark, str(files / "gt.gff3"), {"a": str(files / "pred.gff3"), "t": str(files / "other.gtf")}, FIVE_ROLES, metrics=[Metric.NUCLEOTIDE_CLASSIFICATION])
    rows = result.mapped.collect()
    got = {(r.gt_id, r.predictor, r.pred_id, r.match_class) for r in rows}
    assert ("m1", "a", "a1", "overlapping") not in got
    assert {(g, p) for g, p, _, _ in got} >= {("m1", "a"), ("m1", "t"), ("m2", None), ("m3", None)}
    assert sum(r.is_unmatched_prediction for r in rows) == 2
    nested = result.nested()
    exon = nested["a"]["global_exon"][0]
    assert (exon["tp"], exon["fp"], exon["fn"]) == (1, 2, 3)
    assert nested["a"]["global_transcript"][0]["tp"] == 1
    sinks.write_mapping(result.mapped, str(files / "map"))
    text = next((files / "map").glob("*.csv")).read_text().splitlines()
    assert len(text[0].split("\t")) == 13 and len(text) == 1 + len(rows)


def test_best_per_locus(spark, files):
    result = benchmark_gff(spark, str(files / "gt.gff3"), {"a": str(files / "pred.gff3")}, FIVE_ROLES, mode=LocusMatching.BEST_PER_LOCUS)
    assert [(r.gt_id, r.pred_id) for r in result.mapped.collect()] == [("m1", "a1")]


def test_pair_classes(spark):
    from pyspark.sql import functions as F

    kind = "struct<start:bigint,stop:bigint,chain:array<struct<d:bigint,a:bigint>>>"
    c = lambda *j: [{"d": a, "a": b} for a, b in j]
    t = lambda s, e, *j: {"start": s, "stop": e, "chain": c(*j)}
    rows = [
        (t(1, 99, (10, 20)), t(5, 80, (10, 20)), "exact"),
        (t(1, 99, (10, 20), (30, 40)), t(5, 80, (10, 20)), "contained"),
        (t(5, 80, (10, 20)), t(1, 99, (10, 20), (30, 40)), "contains"),
        (t(1, 99, (10, 20), (30, 40)), t(5, 80, (10, 20), (50, 60)), "shared_junction"),
        (t(1, 99, (10, 20)), t(5, 80, (11, 20)), "overlapping"),
        (t(1, 99), t(1, 99, (10, 20)), "exact"),
        (t(1, 99), t(5, 80), "contained"),
        (t(5, 80), t(1, 99), "contains"),
        (t(1, 50), t(20, 99), "overlapping"),
    ]
    df = spark.createDataFrame(rows, f"g {kind}, p {kind}, want string")
    assert all(r.got == r.want for r in df.select("want", mapping.pair_class(F.col("g"), F.col("p")).alias("got")).collect())


def test_exon_types_of_single_sources(spark, files):
    """The reference has `exon`, one predictor `CDS` (and misleading `exon` rows), the other is left alone."""
    odd = PRED.replace("\texon\t", "\tCDS\t") + "\n" + row("chr1", "exon", 1, 5, "+", "Parent=a1")
    (files / "cds.gff3").write_text(odd)
    paths = {"a": str(files / "pred.gff3"), "c": str(files / "cds.gff3")}
    out = benchmark_gff(spark, str(files / "gt.gff3"), paths, FIVE_ROLES, metrics=[Metric.NUCLEOTIDE_CLASSIFICATION], own_exon_types={"c": "CDS"}).nested()
    for name in ("global_exon", "global_nucleotide", "nucleotide"):
        assert out["a"][name] == out["c"][name]
    with pytest.raises(ValueError, match="no predictor"):
        benchmark_gff(spark, str(files / "gt.gff3"), paths, FIVE_ROLES, own_exon_types={"x": "CDS"})
    assert cli.own_types(["exon"], ["c:CDS", "c:UTR"]) == {"gt": ["exon"], "c": ["CDS", "UTR"]}
    with pytest.raises(SystemExit):
        cli.own_types(None, ["CDS", "c:UTR"])
    assert cli.own_types(["exon"], ["CDS", "UTR"], ["a", "b"]) == {"gt": ["exon"], "a": ["CDS", "UTR"], "b": ["CDS", "UTR"]}


def test_odd_files(spark, tmp_path):
    (tmp_path / "short.gff3").write_text(GT + "\nchr1\tx\texon\n" + row("chr1", "exon", ".", 9, "+", "Parent=m1"))
    with pytest.warns(UserWarning) as seen:
        assert gff.inspect(spark, str(tmp_path / "short.gff3")) == {"features": 9, "short": 1, "unplaced": 1}
    assert sum("short.gff3" in str(w.message) for w in seen) == 2
    (tmp_path / "no.gff3").write_text("just\nwords\n")
    for name in ("no.gff3", "missing.gff3"):
        with pytest.raises(RuntimeError, match=name):
            gff.inspect(spark, str(tmp_path / name))


def test_lines_are_counted_in_the_scan_that_reads_them(spark, files, tmp_path):
    (tmp_path / "short.gff3").write_text(GT + "\nchr1\tx\texon\n" + row("chr1", "exon", ".", 9, "+", "Parent=m1"))
    features, seen = gff.observed(spark, str(tmp_path / "short.gff3"), "gt")
    n = features.count()
    assert n == 9 and seen.get == {"features": 9, "short": 1, "unplaced": 1}
    with pytest.warns(UserWarning, match="short.gff3"):
        benchmark_gff(spark, str(tmp_path / "short.gff3"), {"a": str(files / "pred.gff3")}, FIVE_ROLES, metrics=[Metric.NUCLEOTIDE_CLASSIFICATION])
    (tmp_path / "no.gff3").write_text("just\nwords\n")
    for name in ("no.gff3", "missing.gff3"):
        with pytest.raises(RuntimeError, match=name):
            benchmark_gff(spark, str(tmp_path / name), {"a": str(files / "pred.gff3")}, FIVE_ROLES)


def test_equal_totals_go_by_order():
    pairs = [("g1", "p1", 5), ("g1", "p2", 5), ("g2", "p1", 5), ("g2", "p2", 5), ("g3", "p9", 1)]
    assert assignment.best(pairs) == [True, False, False, True, True]


def test_cli(spark, files, capsys):
    cli.main(["init-config", str(files / "c.yaml")])
    assert sinks.read_config(str(files / "c.yaml")) == FIVE_ROLES
    cli.main(["run", "--gt", str(files / "gt.gff3"), "--pred", f"a:{files / 'pred.gff3'}", "--config", str(files / "c.yaml"), "--output", str(files / "out.json")], spark)
    assert "region_discovery" in (files / "out.json").read_text()
    import json

    found = json.loads((files / "out.json").read_text())
    assert "terminal_flags" in found["files"] and "region_discovery" not in found["files"] and "region_discovery" in found["a"]
    for folder in found["files"].values():
        spark.read.json(folder).count()
    assert cli.predictor_spec("/x/y.gff3") == ("y", "/x/y.gff3")


def test_label_configurations(tmp_path):
    """Quotes, flow style, a key above, comments and document marks."""
    for text in ("---\n'background_label': 8  # no gene\n\"exon_label\": \"0\"\nintron_label: 2\n...\n", "{background_label: 8, exon_label: 0, intron_label: 2, splice_donor_label: null}", "labels:\n  background_label: 8\n  exon_label: 0\n  intron_label: 2\n  splice_acceptor_label: ~\n"):
        (tmp_path / "c.yaml").write_text(text)
        got = sinks.read_config(str(tmp_path / "c.yaml"))
        assert (got.background_label, got.exon_label, got.intron_label, got.splice_donor_label, got.splice_acceptor_label) == (8, 0, 2, None, None)
    (tmp_path / "c.yaml").write_text("background_label 8\n")
    with pytest.raises(ValueError, match="background_label 8"):
        sinks.read_config(str(tmp_path / "c.yaml"))
