"""Tracks to draw: segments with their mismatch flag, and a pyramid of tiles for any zoom.

Nothing here draws; a viewer asks for the segments of a stretch, or for the tiles of a zoom level, and gets rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .runs import KEYS, SIDE
from .scan import WHOLE, Running, scan

#: Positions of a tile of the lowest level, as a power of two.
BASE_LOG2 = 10


def _flags(labelled: DataFrame, span: int | None, parts: int | None = None) -> DataFrame:
    """side, label, lo, hi of the runs of both sides with `_differs`: do the pieces of this range differ? By the keys or, with
    a span, `_key` and `_range`, as the rows are dealt: no shuffle."""
    of = lambda side, c: Running("last", F.when(F.col("side") == side, F.col(c)), upto=True)
    wanted = {f"{s}_{c}": of(s, c) for s in ("gt", "pred") for c in ("label", "lo", "hi")} | {"_next": Running("next", F.col("lo"))}
    rows = scan(labelled.select(*KEYS, "side", "label", "lo", "hi"), KEYS, "lo", ["lo", "side"], wanted, span, placed=True, parts=parts)
    rows = rows.where(F.col("_next").isNull() | (F.col("_next") > F.col("lo")))
    differs = F.col("gt_label") != F.col("pred_label")
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_label").alias("label"), F.col(f"{s}_lo").alias("lo"), F.col(f"{s}_hi").alias("hi"))
    place = KEYS if span is WHOLE else ["_key", "_range"]
    both = rows.select(*place, differs.alias("_differs"), F.inline(F.array(side("gt"), side("pred"))))
    return both.where("lo is not null").groupBy(*place, "side", "label", "lo", "hi").agg(F.max("_differs").alias("_differs"))


def segments(labelled: DataFrame, span: int | None = WHOLE) -> DataFrame:
    """The runs of both sides, with `mismatch`: does the other side have another label anywhere in the segment?

    The pieces of the overlay know which segment of each side they lie in, so a flag is one aggregate of a segment's
    pieces, and no segment is joined by position.
    """
    flags = _flags(labelled, span)
    if span is not WHOLE:
        flags = flags.select("_key.*", "side", "label", "lo", "hi", "_differs").groupBy(*SIDE, "label", "lo", "hi").agg(F.max("_differs").alias("_differs"))
    return flags.select(*SIDE, "label", "lo", "hi", F.coalesce("_differs", F.lit(True)).alias("mismatch"))


def _cut(lo: Column, hi: Column, mismatch: Column, base_log2: int) -> Column:
    """A segment's parts in the lowest tiles."""
    tile = lambda c: F.shiftright(c.cast("long"), base_log2)

    def part(t: Column) -> Column:
        bases = F.least(hi.cast("long"), F.shiftleft(t + 1, base_log2) - 1) - F.greatest(lo.cast("long"), F.shiftleft(t, base_log2)) + 1
        return F.struct(t.alias("tile"), bases.alias("bases"), F.when(mismatch, bases).otherwise(0).alias("flagged"), (tile(lo) == t).cast("long").alias("segments"))

    return F.transform(F.sequence(tile(lo), tile(hi)), part)


def run_tiles(labelled: DataFrame, base_log2: int = BASE_LOG2, levels: int = 8, span: int | None = WHOLE, parts: int | None = None) -> DataFrame:
    """`tiles` of the `segments` of runs. With a span no segment is shuffled but those over a range's border: all others are
    added up to tiles in the range where they lie. `parts`: the tasks that ranges are dealt to."""
    flags = _flags(labelled, span, parts)
    if span is WHOLE:
        return tiles(flags.select(*SIDE, "label", "lo", "hi", F.coalesce("_differs", F.lit(True)).alias("mismatch")), base_log2, levels)
    over = F.floor(F.col("lo") / F.lit(span)) != F.floor(F.col("hi") / F.lit(span))
    none = F.lit(None).cast("long")
    whole = F.array(F.struct(none.alias("tile"), none.alias("bases"), none.alias("flagged"), none.alias("segments")))
    parts = F.when(over, whole).otherwise(_cut(F.col("lo"), F.col("hi"), F.coalesce("_differs", F.lit(True)), base_log2))
    rows = flags.select("_key.*", "side", "label", F.when(over, F.col("lo")).alias("_lo"), F.when(over, F.col("hi")).alias("_hi"), "_differs", F.inline(parts))
    sums = [F.sum(c).alias(c) for c in ("bases", "flagged", "segments")]
    low = rows.groupBy(*SIDE, "label", "_lo", "_hi", "tile").agg(*sums, F.max("_differs").alias("_differs"))
    own = F.array(F.struct("tile", "bases", "flagged", "segments"))
    later = F.when(F.col("tile").isNull(), _cut(F.col("_lo"), F.col("_hi"), F.coalesce("_differs", F.lit(True)), base_log2)).otherwise(own)
    return _pyramid(low.select(*SIDE, "label", F.inline(later)), levels)


def tiles(flagged: DataFrame, base_log2: int = BASE_LOG2, levels: int = 8) -> DataFrame:
    """Per side, level, tile and label: covered positions (`bases`), those in flagged segments, and segments that start there.

    A tile of level 0 is 2**base_log2 positions, one of each further level two of the level below. Segments are cut at
    the borders of the lowest tiles; higher levels add lower ones up, combined before the shuffle.
    """
    tile = lambda c: F.shiftright(F.col(c).cast("long"), base_log2)
    cut = flagged.withColumn("tile", F.explode(F.sequence(tile("lo"), tile("hi"))))
    first, last = F.shiftleft("tile", base_log2), F.shiftleft(F.col("tile") + 1, base_log2) - 1
    bases = F.least(F.col("hi").cast("long"), last) - F.greatest(F.col("lo").cast("long"), first) + 1
    low = cut.groupBy(*SIDE, "label", "tile").agg(F.sum(bases).alias("bases"), F.sum(F.when(F.col("mismatch"), bases).otherwise(0)).alias("flagged"), F.sum((tile("lo") == F.col("tile")).cast("long")).alias("segments"))
    return _pyramid(low, levels)


def _pyramid(low: DataFrame, levels: int) -> DataFrame:
    """All levels from (parts of) the lowest tiles."""
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    every = low.withColumn("level", level).withColumn("tile", F.expr("shiftright(tile, level)"))
    return every.groupBy(*SIDE, "level", "tile", "label").agg(*[F.sum(c).cast("long").alias(c) for c in ("bases", "flagged", "segments")])
