"""Segmented scans: running values along a key whose rows do not fit in one task.

A plain window gathers all rows of its key. Here a key is cut into ranges of positions. Every range is scanned on its
own, its total becomes one row, the totals of a key are scanned in turn (a key of 10^9 positions has some hundred),
and what came before a range is joined back to its rows. The rows are shuffled once, by key and range; totals are
taken from the same shuffled rows.

Running values have to be associative: `last` (of non-null values), `max`, `min` and `sum`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Positions of a range. Shorter keys are one range.
SPAN = 1 << 20
WHOLE = None


@dataclass(frozen=True)
class Running:
    """`kind` of `value` over the rows before (`upto`: also this one) or, if `after`, those after this one; if `whole`, over all rows of the key.

    `last` skips nulls. `next` is the value of the row that follows, for values that are never null.
    """

    kind: str
    value: Column
    upto: bool = False
    after: bool = False
    whole: bool = False

    def over(self, keys: list[str], order: list[str]) -> Column:
        """Within a range. Rows after this one are rows before it in the opposite order: such frames grow row by row, those
        that end at the last row would be computed anew for each."""
        by, of = W.partitionBy(*keys), {"last": F.last(self.value, ignorenulls=True), "max": F.max(self.value), "min": F.min(self.value), "sum": F.sum(self.value)}
        if self.whole:
            return of[self.kind].over(by)
        if self.kind == "next":
            return F.lead(self.value).over(by.orderBy(*order))
        at = by.orderBy(*[F.col(c).desc_nulls_last() for c in order]) if self.after else by.orderBy(*order)
        return of[self.kind].over(at.rowsBetween(W.unboundedPreceding, 0 if self.upto else -1))

    def total(self, order: Column) -> Column:
        """Of a whole range."""
        if self.kind in ("last", "next"):
            at = F.when(self.value.isNotNull(), order)
            return (F.min_by if self.after or self.kind == "next" else F.max_by)(self.value, at)
        return {"max": F.max, "min": F.min, "sum": F.sum}[self.kind](self.value)

    def far(self, name: str) -> Column:
        """Of the ranges before (after) one, or of all, from their totals."""
        after = self.after or self.kind == "next"
        return Running("last" if self.kind == "next" else self.kind, F.col(name), after=after, whole=self.whole).over(["_key"], ["_range"])

    def joined(self, near: Column, far: Column) -> Column:
        """Of the range's rows and all that came before it (after it)."""
        if self.whole:
            return far
        if self.kind in ("last", "next"):
            return F.coalesce(near, far)
        if self.kind == "sum":
            return F.when(near.isNotNull() | far.isNotNull(), F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)))
        return (F.greatest if self.kind == "max" else F.least)(near, far)


def scan(rows: DataFrame, keys: list[str], at: str, order: list[str], wanted: dict[str, Running], span: int | None = SPAN, placed: bool = False, parts: int | None = None) -> DataFrame:
    """The rows with a column for each of `wanted`, as windows over whole keys would give them.

    `at`: the position that places a row in a range; ranges follow one another in the order of `order`, whose first
    column is `at`. Ties of the whole order stand in any order, as in a window. Without a span (`WHOLE`) each key is one
    range and no totals are needed: plain windows, for keys that are known to be short.

    `placed`: with a span, `_key` and `_range`, by which the rows are dealt, are columns of the result, so that what is grouped
    by both is not shuffled again. `parts`: the tasks that ranges are dealt to. Without it Spark chooses their number by
    compressed bytes, which for some tables are a tenth of what a task then sorts.

    Defined cases: null keys are equal to one another; a null position counts as 0; values of `last` skip nulls; an empty table
    stays empty.
    """
    if span is WHOLE:
        return rows.select("*", *[x.over(keys, order).alias(n) for n, x in wanted.items()])
    # One key column that is never null, and a range that isn't either: joins then filter neither side, and both branches
    # below, which read all columns, share one shuffle.
    others = [c for c in rows.columns if c not in keys]
    place_of = F.coalesce(F.floor(F.col(at) / F.lit(span)).cast("long"), F.lit(0).cast("long"))
    spread = rows.select(F.struct(*keys).alias("_key"), place_of.alias("_range"), *others).repartition(*([parts] if parts else []), "_key", "_range")
    place, everything = F.struct(*order), F.struct(*others)
    totals = spread.groupBy("_key", "_range").agg(*[x.total(place).alias(n) for n, x in wanted.items()], F.max(everything).alias("_all")).where("_all is not null")
    totals = totals.select(F.col("_key").alias("_k"), F.col("_range").alias("_r"), *[x.far(n).alias(f"_far_{n}") for n, x in wanted.items()])
    local = spread.select("*", *[(F.lit(None) if x.whole else x.over(["_key", "_range"], order)).alias(f"_near_{n}") for n, x in wanted.items()])
    both = local.join(totals.hint("merge"), (F.col("_key") == F.col("_k")) & (F.col("_range") == F.col("_r")))
    out = [F.col(f"_key.{c}").alias(c) if c in keys else F.col(c) for c in rows.columns]
    return both.select(*(["_key", "_range"] if placed else []), *out, *[x.joined(F.col(f"_near_{n}"), F.col(f"_far_{n}")).alias(n) for n, x in wanted.items()])


def fused(rows: DataFrame, keys: list[str], same: list[str], span: int | None = SPAN, reach: bool = False, touching: bool = True) -> DataFrame:
    """Neighbours joined: keys, the columns of `same`, lo, hi.

    Runs (disjoint, in order) join where they touch and agree in `same`. With `reach`, spans that may overlap join where
    the next one starts by the end of all before it (`touching`: or right after it).
    """
    before = Running("max", F.col("hi")) if reach else Running("last", F.struct("hi", *same))
    marked = scan(rows.select(*keys, *same, "lo", "hi"), keys, "lo", ["lo", "hi"], {"_was": before, "_rest": Running("max", F.col("hi"), whole=True)}, span)
    if reach:
        was = F.col("_was")
        joins = F.col("lo") <= was + (1 if touching else 0)
    else:
        was = F.col("_was.hi")
        joins = was == F.col("lo") - 1
        for c in same:
            joins = joins & F.col(f"_was.{c}").eqNullSafe(F.col(c))
    # Only first rows go on; what was reached before the next first row is where this one's stretch ends, and the last
    # stretch ends where the key does.
    first = marked.where(~F.coalesce(joins, F.lit(False))).select(*keys, *same, "lo", was.alias("_was"), "_rest")
    ended = scan(first, keys, "lo", ["lo"], {"_end": Running("next", F.col("_was"))}, span)
    return ended.select(*keys, *same, "lo", F.coalesce("_end", "_rest").alias("hi"))
