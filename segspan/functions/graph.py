"""Connected groups of a graph too large for a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import materialized


def connected(links: DataFrame) -> DataFrame:
    """node, group for links (a, b); a group goes by its smallest node.

    Rounds of two steps, each of which hangs nodes onto smaller ones: all larger neighbours of a node onto the smallest
    node around it, then a node's smaller neighbours onto the smallest of them. Every group shrinks to a star in a number
    of rounds that grows with the logarithm of its size, however long its chains are. Only a count and a checksum of the
    links come to the driver.

    Defined cases: loops alone make no group; repeated links count once; no links give an empty frame.
    """
    links = materialized(links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = None
    while True:
        turned = links.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(links.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        nearest = turned.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("top"))
        hung = turned.join(nearest, "x").where("y > x").select(F.col("y").alias("hi"), F.col("top").alias("lo")).distinct()
        least = hung.groupBy("hi").agg(F.min("lo").alias("top"))
        moved = hung.join(least, "hi").where("lo <> top").select(F.col("lo").alias("hi"), F.col("top").alias("lo"))
        links = materialized(moved.unionByName(least.withColumnRenamed("top", "lo")).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == mark:
            break
        mark = now
    stars = links.select(F.col("hi").alias("node"), F.col("lo").alias("group"))
    return stars.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("group")).distinct())
