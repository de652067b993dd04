"""Random axes against a per-position evaluation written from the definitions."""

import random

import pytest

from segspan.config import FIVE_ROLES
from segspan.operators import assignment, perbase, runs
from segspan.sources import arrays


def axis(r, n=40):
    out = []
    while len(out) < n:
        out += [r.choice([0, 0, 2, 8, 8])] * r.randint(1, 6)
    return out[:n]


def test_transitions_and_confusion(spark):
    r = random.Random(5)
    gt, pred = [axis(r) for _ in range(60)], [axis(r) for _ in range(60)]
    labelled = arrays.runs(arrays.pairs(spark, gt, pred)).cache()
    pieces = runs.overlay(labelled)
    want: dict = {}
    for g, p in zip(gt, pred, strict=True):
        for i in range(len(g) - 1):
            if g[i] != g[i + 1] and p[i] == g[i]:
                key = ("gt", g[i], g[i + 1], p[i + 1])
            elif p[i] != p[i + 1]:
                before = next((g[k] for k in range(i - 1, -1, -1) if g[k] != g[i]), g[i]) if g[i] == g[i + 1] else g[i]
                # the label before the last change is the label just before the current stretch
                k = i
                while k > 0 and g[k - 1] == g[i]:
                    k -= 1
                before = g[k - 1] if k > 0 else g[i]
                k = i
                while k + 1 < len(g) and g[k + 1] == g[i]:
                    k += 1
                after = g[k + 1] if k + 1 < len(g) else g[i]
                stable = g[i] == g[i + 1]
                kind = "late" if stable and p[i] == before and p[i + 1] == g[i] else "premature" if stable and p[i] == g[i] and p[i + 1] == after else "spurious"
                key = (kind, g[i], p[i], p[i + 1])
            else:
                continue
            want[key] = want.get(key, 0) + 1
    got = {(x.kind, x.ctx, x.row, x.col): x.n for x in perbase.transition_counts(perbase.transitions(labelled, pieces), ["predictor"]).collect()}
    assert got == want
    pairs = {(x.gt, x.pred): x.n for x in perbase.label_confusion(pieces, ["predictor"]).collect()}
    flat: dict = {}
    for g, p in zip(gt, pred, strict=True):
        for k in zip(g, p, strict=True):
            flat[k] = flat.get(k, 0) + 1
    assert pairs == flat
    filled = runs.infer_introns(labelled, FIVE_ROLES).where("side = 'gt'").groupBy("seq_id", "label").agg({"lo": "count"}).count()
    assert filled > 0


def test_assignment():
    """Largest total; of equal ones the assignment with the earlier pairs, against all subsets of pairs."""
    r = random.Random(3)
    for k in range(1500):
        every = [(f"g{i}", f"p{j}") for i in range(r.randint(1, 4)) for j in range(r.randint(1, 4))]
        pairs = [(g, p, r.randint(1, (1, 2, 3, 10**9)[k % 4])) for g, p in r.sample(every, r.randint(1, min(8, len(every))))]
        most = None
        for m in range(1 << len(pairs)):
            own = [x for i, x in enumerate(pairs) if m >> i & 1]
            if len({x[0] for x in own}) == len({x[1] for x in own}) == len(own):
                value = sum(x[2] for x in own), [m >> i & 1 for i in range(len(pairs))]
                most = max(most or value, value)
        assert assignment.best(pairs) == [bool(x) for x in most[1]]


def test_assignment_of_many_equal_pairs():
    """The tie rule holds at any size: the diagonal has the earliest pairs of a full square."""
    pairs = [(i, j, 7) for i in range(60) for j in range(60)]
    assert [pairs[k][:2] for k, x in enumerate(assignment.best(pairs)) if x] == [(i, i) for i in range(60)]
    chain = [(i, i + d, 5) for i in range(3000) for d in (0, 1)]
    assert [chain[k][:2] for k, x in enumerate(assignment.best(chain)) if x] == [(i, i) for i in range(3000)]


@pytest.mark.parametrize("together", [1 << 16, 3])
def test_assigned_rows(spark, together):
    """Groups in tasks, and connected groups found by Spark where a key has many pairs, are solved alike."""
    r = random.Random(9)
    rows = []
    for key in range(6):
        n = (1, 2, 5, 40, 90, 90)[key]
        for _ in range(3 * n):
            g = r.randrange(n)
            rows.append((f"k{key}", f"g{g}", f"p{min(n - 1, max(0, g + r.randint(-1, 1)))}", r.choice([0.0, 0.25, 0.5, 0.5, 1.0])))
    rows = [(k, g, p, s, i) for i, ((k, g, p), s) in enumerate({(k, g, p): s for k, g, p, s in rows}.items())]
    rows += [("k9", None, "p1", 0.5, 10**6), ("k9", "g1", "p1", 0.5, 10**6 + 1), (None, "g1", None, 0.3, 10**6 + 2), (None, "g1", "x", 0.2, 10**6 + 3)]
    table = spark.createDataFrame(rows, "key string, g string, p string, score double, at long").repartition(5)
    got = {x["at"] for x in assignment.assigned(table, ["key"], "g", "p", "score", ["at"], together).collect()}
    want = set()
    for key in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == key and x[3] > 0]
        keep = assignment.best([(g, p, round(s * 10**9)) for _, g, p, s, _ in own])
        want |= {x[4] for x, k in zip(own, keep, strict=True) if k}
    assert got == want
    assert assignment.assigned(table.where("score > 9"), ["key"], "g", "p", "score", ["at"], together).count() == 0
