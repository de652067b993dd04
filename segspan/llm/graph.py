"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of `edges` (columns a, b); the root is the component's smallest node.

    Each step sends a node's neighbours to its smallest one; after at most a few log-many rounds every
    component is a star. Only two sums of the edge set come to the driver. Minima are combined before
    the shuffle, and a hot node is one row of the smaller join side.

    Defined cases: loops and nodes without an edge to another one are not in the result; repeated edges count once; no
    edges give an empty frame.
    """
    both = lambda e: e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.put("star-0", e)
    last, k = None, 0
    while True:
        # Large star: every larger neighbour of x goes to the smallest node around x.
        around = both(e)
        least = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = around.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: x and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e2 = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        e = scratch.put(f"star-{k}", e2)
        scratch.drop(f"star-{k - 1}")
        now = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
