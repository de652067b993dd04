"""Segmented scans: keys cut into ranges give what windows over whole keys give."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from segspan.config import FIVE_ROLES
from segspan.operators import annotation, mapping, perbase, runs
from segspan.operators.scan import WHOLE, Running, scan
from segspan.sources import arrays

ROWS = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(6)

    def axis(n):
        out = []
        while len(out) < n:
            out += [r.choice([0, 0, 2, 8, 8])] * r.choice([1, 2, 3, 5, 150])
        return out[:n]

    sizes = [900, 40, 1, 333]
    return arrays.runs(arrays.pairs(spark, [axis(n) for n in sizes], [axis(n) for n in sizes])).cache()


@pytest.mark.parametrize("span", [1, 64, 1 << 20])
def test_operators_on_ranges(labelled, span):
    whole = runs.overlay(labelled)
    pieces = runs.overlay(labelled, span)
    assert ROWS(pieces) == ROWS(whole)
    assert ROWS(runs.merged(labelled.withColumn("label", F.least("label", F.lit(2))), span=span)) == ROWS(runs.merged(labelled.withColumn("label", F.least("label", F.lit(2)))))
    assert ROWS(runs.binary(pieces, 0, span)) == ROWS(runs.binary(whole, 0))
    assert ROWS(perbase.indel(pieces, FIVE_ROLES, span)) == ROWS(perbase.indel(whole, FIVE_ROLES))
    assert ROWS(perbase.frames(pieces, FIVE_ROLES, False, span)) == ROWS(perbase.frames(whole, FIVE_ROLES, False))


@pytest.mark.parametrize("span", [7, 100, WHOLE])
def test_unions_and_loci(spark, span):
    r = random.Random(8)
    rows = [("s", r.choice(["c1", "c2"]), "+", a, a + r.choice([0, 1, 5, 5, 60]), k, f"g{k}") for k, a in enumerate(r.randrange(-50, 2000) for _ in range(400))]
    spans = spark.createDataFrame(rows, "source string, seqid string, strand string, start long, stop long, ord long, gff_id string")
    for touching in (True, False):
        want, own = set(), {}
        for x in rows:
            own.setdefault(x[1], []).append((x[3], x[4]))
        for c, v in own.items():
            v.sort()
            lo, hi = v[0]
            for a, z in v[1:]:
                if a > hi + touching:
                    want.add((c, lo, hi))
                    lo, hi = a, z
                hi = max(hi, z)
            want.add((c, lo, hi))
        got = runs.interval_union(spans.select("seqid", F.col("start").alias("lo"), F.col("stop").alias("hi")), ["seqid"], touching, span)
        assert {(x.seqid, x.lo, x.hi) for x in got.collect()} == want
    placed = mapping.loci(spans, span=span).collect()
    assert {(x.seqid, x.l_start, x.l_stop) for x in placed} == want and len(placed) == len(rows)
    for c in ("c1", "c2"):
        order = sorted({(x.l_start, x.locus) for x in placed if x.seqid == c})
        assert [x[1] for x in order] == list(range(1, len(order) + 1))
        assert all(x.l_start <= x.start and x.stop <= x.l_stop for x in placed)


def test_base_scores_on_ranges(spark):
    r = random.Random(4)
    rows = [(s, k, "c", kind, a, a + r.randrange(1, 90), "+", None, None) for k, (s, kind, a) in enumerate((r.choice(["gt", "p", "q"]), r.choice(["mRNA", "exon", "exon"]), r.randrange(3000)) for _ in range(300))]
    f = spark.createDataFrame(rows, "source string, ord long, seqid string, type string, start long, stop long, strand string, gff_id string, parent string")
    got = {x.predictor: (x.tp, x.fp, x.fn) for x in annotation.nucleotide(f, ["exon"], ["mRNA"], span=50).collect()}
    at = lambda s, kind: {x for row in rows if row[0] in s and row[3] == kind for x in range(row[4], row[5] + 1)}
    for p in ("p", "q"):
        inside, g, h = at(("gt", p), "mRNA"), at(("gt",), "exon"), at((p,), "exon")
        assert got[p] == (len(g & h & inside), len((h - g) & inside), len((g - h) & inside))


def test_values_before_and_after(spark):
    """All kinds of running values, null keys and values, and many tasks for one key."""
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", None]), x, r.choice([None, 1, 5, -3])) for x in r.sample(range(-400, 3000), 700)]
    table = spark.createDataFrame(rows, "k string, at long, v int")
    v = F.col("v")
    wanted = {f"{kind}_{after}_{upto}": Running(kind, v, upto, after) for kind in ("last", "max", "min", "sum") for after in (False, True) for upto in (False, True)}
    wanted |= {"top": Running("max", v, whole=True), "all": Running("sum", v, whole=True), "next": Running("next", F.col("at"))}
    got = scan(table, ["k"], "at", ["at"], wanted, 50)
    assert ROWS(got) == ROWS(scan(table, ["k"], "at", ["at"], wanted, WHOLE))
    w = W.partitionBy("k").orderBy("at")
    plain = table.withColumn("n", F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("x", F.lead("at").over(w))
    mine = scan(table, ["k"], "at", ["at"], {"n": Running("sum", v, True), "x": Running("last", F.col("at"), after=True)}, 50)
    assert ROWS(mine) == ROWS(plain)
    assert scan(table.where("at > 9999"), ["k"], "at", ["at"], wanted, 50).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") >= 1


def test_rows_are_shuffled_once(spark, tmp_path, capsys):
    """Totals are taken from the shuffle of the rows themselves, and joining them back needs no other one."""
    spark.range(500).selectExpr("id % 2 k", "id * 7 % 500 at").write.parquet(str(tmp_path / "t"))
    got = scan(spark.read.parquet(str(tmp_path / "t")), ["k"], "at", ["at"], {"n": Running("sum", F.lit(1))}, 40)
    got.collect()
    got.explain()
    final = capsys.readouterr().out.split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1
