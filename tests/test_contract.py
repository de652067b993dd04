"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = entry._own.QUERIES


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple("" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(OWN) & set(entry.oracle_sql())))
def test_query(spark, con, name):
    assert rows(OWN[name](spark, SF).toPandas()) == rows(con.sql(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_full_discovery(spark):
    """No pair is worse than the greedy choice, and nobody is matched twice in a locus."""
    from segspan.operators import mapping
    from segspan.plans import queries

    _, g, p = queries._annotations(spark, SF)
    scored = mapping.candidates(mapping.loci(g), p).toPandas()
    chosen = mapping.full_discovery(mapping.candidates(mapping.loci(g), p)).toPandas()
    key = ["seqid", "strand", "locus", "predictor"]
    for side in ("gt_id", "pred_id"):
        assert not chosen.duplicated([*key, side]).any()
    total = chosen.groupby(key)["score"].sum()
    for k, own in scored[scored.score > 0].sort_values("score", ascending=False).groupby(key):
        gs, ps, greedy = set(), set(), 0.0
        for r in own.itertuples():
            if r.gt_id not in gs and r.pred_id not in ps:
                gs.add(r.gt_id)
                ps.add(r.pred_id)
                greedy += r.score
        assert total[k] >= greedy - 1e-9


def test_streaming(spark, tmp_path):
    """Every family of a stream is that of one evaluation of all its sequences; replayed batches and sums change nothing."""
    import random

    from segspan.config import FIVE_ROLES
    from segspan.operators import runs
    from segspan.sources import arrays
    from segspan.streaming import incremental

    r = random.Random(3)
    axis = lambda n: [x for _ in range(n) for x in [r.choice([0, 0, 2, 8, 8])] * r.choice([1, 3, 6])]
    data = []
    for k in range(12):
        g, p = axis(30), axis(30)
        n = min(len(g), len(p))
        data.append((r.choice(["a", "b"]), str(k), g[:n], p[:n]))
    schema = "predictor string, seq_id string, gt array<int>, pred array<int>"
    for k in range(0, 12, 6):
        spark.createDataFrame(data[k : k + 6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    q = incremental.start(stream, FIVE_ROLES, state, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    whole = incremental.states(runs.check_labels(arrays.runs(spark.createDataFrame(data, schema)), FIVE_ROLES), FIVE_ROLES)
    tidy = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.select(sorted(df.columns)).collect())
    want = {name: tidy(incremental.result(name, incremental.merge(name, [df]))) for name, df in whole.items()}
    assert {name: tidy(incremental.current(spark, state, name)) for name in want} == want
    assert len(want["nucleotide"]) == 2 and want["indel_counts"]
    incremental.compact(spark, state, 0)
    incremental.compact(spark, state, 1)
    incremental.compact(spark, state, 1)
    assert sorted(os.listdir(tmp_path / "state/frames")) == ["sum=1"]
    assert {name: tidy(incremental.current(spark, state, name)) for name in ("nucleotide", "iou_stats", "indel_counts", "frames")} == {name: want[name] for name in ("nucleotide", "iou_stats", "indel_counts", "frames")}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["array_pair_confusion", "rle_runs", "gt_transition_matrix", "boundary_shift", "length_emd", "match_class_dist", "position_bias", "inferred_introns"])
def test_dealt_once(spark, name):
    """Rows are dealt by sequence once, for slots and axes; no later step shuffles them (or dense arrays of them) again."""
    plan = OWN[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "seq_id" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tasks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(entry._own.fixtures, "TASK_ROWS", 100)
    assert entry._own.fixtures.slots(spark, SF).rdd.getNumPartitions() > 50


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["global_gene", "global_gene_full", "painted_pairs", "painted_pairs_full", "mapping_full_discovery", "unmatched_predictions", "global_transcript", "global_transcript_full"])
def test_annotations_are_derived_once(spark, name):
    """All branches of a mapping read transcripts (and exons) that were written once."""
    plan = OWN[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_chains_of_odd_parents(spark):
    """One exon: an empty chain; equal links count once; exons without a parent or a coordinate are in no chain."""
    from segspan.operators import mapping

    schema = "source string, ord long, seqid string, type string, start long, stop long, strand string, gff_id string, parent string"
    rows = [("gt", k, "c", "exon", a, z, "+", None, p) for k, (a, z, p) in enumerate([(9, 12, "x"), (1, 4, "x"), (1, 4, "x"), (20, None, "x"), (5, 6, "y"), (7, 8, None)])]
    found = {r["parent"]: [tuple(j) for j in r["chain"]] for r in mapping.intron_chains(spark.createDataFrame(rows, schema), ["exon"]).collect()}
    assert found == {"x": [(4, 1), (4, 9)], "y": []}
