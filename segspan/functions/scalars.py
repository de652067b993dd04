"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0 or missing."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.when(b != 0, a.cast("double") / b), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def scores(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return [p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1")]


def total(condition: Column, value: Column | int = 1) -> Column:
    """Sum of `value` where the condition holds, 0 if nowhere."""
    return F.coalesce(F.sum(F.when(condition, value).otherwise(0)), F.lit(0)).cast("long")


def distribution(x: Column | str) -> list[Column]:
    """count, mean, mae, rmse, std (of the population), min, max; all 0 without values. mae is the plain mean."""
    x = F.col(x) if isinstance(x, str) else x
    x = x.cast("double")
    of = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    return [F.count(x).alias("count"), of(F.avg(x), "mean"), of(F.avg(x), "mae"), of(F.sqrt(F.avg(x * x)), "rmse"), of(F.stddev_pop(x), "std"), of(F.min(x), "min"), of(F.max(x), "max")]


def overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo) + 1)


def iou(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return overlap(a_lo, a_hi, b_lo, b_hi) / (F.greatest(a_hi, b_hi) - F.least(a_lo, b_lo) + 1)
