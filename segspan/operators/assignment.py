"""The best one-to-one assignment of scored pairs, with one tie rule at every size.

Weights are whole numbers, so results are exact. A group of rivals (pairs that are linked by shared members) is solved
by shortest augmenting paths over its own pairs only; what the solver leaves are profits and prices that prove the
result: no pair is worth more than the profit and price of its members, and all of them together are worth just what
the chosen pairs are. The same numbers say which other assignments are as good: those that use only pairs worth exactly
their profit and price, and leave out nobody with a positive one. Among these, pairs are fixed in order: each that some
best assignment with the ones fixed before has is taken.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Hashable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.graph import connected
from ..functions.storage import materialized

#: Scores count to nine decimals.
POINTS = 10**9
#: Rivals of one key up to this number of pairs go to a task together; beyond it their connected groups do, each on its own.
TOGETHER = 1 << 16

Pair = tuple[Hashable, Hashable, int]


def priced(pairs: list[Pair]) -> tuple[dict, dict, dict, dict]:
    """(partner of each left member, of each right one, profits, prices) of a best assignment."""
    around: dict = defaultdict(list)
    for g, p, w in pairs:
        around[g].append((p, w))
    profit, price = {g: max(w for _, w in own) for g, own in around.items()}, defaultdict(int)
    of_g: dict = {}
    of_p: dict = {}
    for start in around:
        near, came, heap = {start: 0}, {}, []
        settled: dict = {}
        end, end_g, end_p = profit[start], start, None
        here, step = start, 0
        while True:
            for p, w in around[here]:
                d = step + profit[here] + price[p] - w
                if d <= end and p not in settled and (p not in came or d < came[p][0]):
                    came[p] = (d, here)
                    heapq.heappush(heap, (d, len(came), p))
            while heap and (heap[0][2] in settled or heap[0][0] > came[heap[0][2]][0]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= end:
                break
            step, _, p = heapq.heappop(heap)
            settled[p] = step
            if p not in of_p:
                end, end_g, end_p = step, None, p
                break
            here = of_p[p]
            near[here] = step
            if step + profit[here] < end:
                end, end_g, end_p = step + profit[here], here, None
        for g, d in near.items():
            profit[g] -= max(0, end - d)
        for p, d in settled.items():
            price[p] += max(0, end - d)
        # Give the path's pairs to their new owners, from its end back to its start.
        p = of_g.pop(end_g, None) if end_g is not None else end_p
        while p is not None:
            g = came[p][1]
            p2 = of_g.get(g)
            of_g[g], of_p[p] = p, g
            p = None if g == start else p2
    return of_g, of_p, profit, price


def _covered(x, around: dict, of_x: dict, of_y: dict, must: dict, fixed: set) -> list | None:
    """Steps (x, y) that give x a partner without leaving out anybody who must have one, or None."""
    queue, came = [x], {}
    for u in queue:
        for y in around[u]:
            if y in fixed or y in came:
                continue
            came[y] = u
            v = of_y.get(y)
            if v is None or not must[v]:
                steps = []
                while True:
                    u = came[y]
                    steps.append((u, y))
                    if u == x:
                        return steps
                    y = of_x[u]
            queue.append(v)
    return None


def best(pairs: list[Pair]) -> list[bool]:
    """Which of the pairs (left, right, positive weight) are in the best assignment; of equally good ones, the one with the earlier pairs."""
    if len(pairs) == 1:
        return [True]
    of_g, of_p, profit, price = priced(pairs)
    won = {(g, p): w for g, p, w in pairs if of_g.get(g) == p}
    if sum(won.values()) != sum(profit.values()) + sum(price.values()) or any(w > profit[g] + price[p] for g, p, w in pairs):
        raise AssertionError("the assignment is not proven to be the best one")
    ps, gs = defaultdict(list), defaultdict(list)
    for g, p, w in pairs:
        if w == profit[g] + price[p]:
            ps[g].append(p)
            gs[p].append(g)
    fixed_g, fixed_p, keep = set(), set(), []
    for g, p, w in pairs:
        if w != profit[g] + price[p] or g in fixed_g or p in fixed_p:
            keep.append(False)
            continue
        if of_g.get(g) != p:
            before = dict(of_g), dict(of_p)
            p0, g0 = of_g.get(g), of_p.get(p)
            for d, k in ((of_p, p0), (of_g, g0)):
                d.pop(k, None)
            of_g[g], of_p[p] = p, g
            good = True
            for x, around, of_x, of_y, must, out_x, out_y in ((p0, gs, of_p, of_g, price, p, g), (g0, ps, of_g, of_p, profit, g, p)):
                if good and x is not None and x not in of_x and must[x]:
                    steps = _covered(x, around, of_x, of_y, must, (fixed_g if of_y is of_g else fixed_p) | {out_y})
                    good = steps is not None
                    for u, y in steps or []:
                        v = of_y.get(y)
                        if v is not None and of_x.get(v) == y:
                            del of_x[v]
                        of_x[u], of_y[y] = y, u
            if not good:
                of_g, of_p = before
                keep.append(False)
                continue
        fixed_g.add(g)
        fixed_p.add(p)
        keep.append(True)
    return keep


def _solver(n_keys: int, gt: int, pred: int, points: int):
    """Rows in order of their first n_keys columns, then of their rank: those of the best assignment of each group stay."""

    def solved(rows: pa.Table, starts: list[int]) -> pa.Table:
        g, p, w = (rows.column(k).to_pylist() for k in (gt, pred, points))
        keep: list[bool] = []
        for a, z in zip(starts, [*starts[1:], len(g)], strict=True):
            keep += best(list(zip(g[a:z], p[a:z], w[a:z], strict=True)))
        return rows.filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            new = None
            for k in range(n_keys):
                a, b = rows.column(k).slice(1), rows.column(k).slice(0, rows.num_rows - 1)
                other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
                new = other if new is None else pc.or_(new, other)
            starts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist())]
            # The last group may go on in the next batch.
            if len(starts) > 1:
                yield from solved(rows.slice(0, starts[-1]), starts[:-1]).to_batches()
            held = rows.slice(starts[-1]).to_batches()
        if held:
            yield from solved(pa.Table.from_batches(held), [0]).to_batches()

    return run


def assigned(scored: DataFrame, keys: list[str], left: str, right: str, score: str, order: list[str], together: int = TOGETHER) -> DataFrame:
    """The rows of `scored` that make up, for each of the keys, the one-to-one assignment of largest total score.

    Scores count to nine decimals; rows without a positive score are never taken. Of equally good assignments the one
    with the earlier rows in `order` is taken, whatever the size of the group. Pairs without a rival are taken in the
    JVM; rivals of one key are solved in a task, or, if they are more than `together` pairs, their connected groups are.
    A connected group has to fit in a task (some 200 bytes a pair).

    Defined cases: rows of equal left and right members are the same pair, of which the first of the best score counts;
    nulls in left or right are members like others; an empty table gives an empty frame.
    """
    points = F.round(F.col(score) * POINTS).cast("long")
    some = scored.where(F.col(score) > 0).withColumn("_points", points).where("_points > 0")
    n = lambda c: F.count(F.lit(1)).over(W.partitionBy(*keys, c))
    some = materialized(some.withColumn("_g", n(left)).withColumn("_p", n(right)))
    free = (F.col("_g") == 1) & (F.col("_p") == 1)
    alone, rivals = some.where(free).select(*scored.columns), some.where(~free).drop("_g", "_p")
    big = rivals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > together).drop("_n")
    rivals = rivals.withColumn("_group", F.lit("")) if big.isEmpty() else _grouped(rivals, big, keys, left, right)
    by = [*keys, "_group"]
    rows = rivals.select(*by, *[c for c in scored.columns if c not in keys], "_points")
    at = {c: k for k, c in enumerate(rows.columns)}
    rows = rows.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, *order)
    solved = rows.mapInArrow(_solver(len(by), at[left], at[right], at["_points"]), rows.schema)
    return alone.unionByName(solved.select(*scored.columns))


def _grouped(rivals: DataFrame, big: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """With the connected group of each pair of the keys in `big`, found by Spark; other keys are one group each."""
    node = lambda side: F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(side).alias("s"), F.col(left if side == "g" else right).alias("x")), {"ignoreNullFields": "false"})
    links = rivals.join(F.broadcast(big) if big.count() < 1000 else big, keys, "left_semi").select(node("g").alias("a"), node("p").alias("b"))
    groups = connected(links).select(F.col("node").alias("_node"), F.col("group").alias("_found"))
    return rivals.withColumn("_node", node("g")).join(groups, "_node", "left").withColumn("_group", F.coalesce("_found", F.lit(""))).drop("_node", "_found")
