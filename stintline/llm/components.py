"""Connected components by alternating large-star and small-star, as joins of tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.common import drop, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Smallest neighbours are pre-aggregated; the join back has plain shuffles on both sides, so AQE splits a hub."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).hint("rebalance")
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) -> (node, component): the smallest node that each node of an edge reaches.

    Self links, repeated links and null ends have no effect; an empty table gives an empty one. The number of
    rounds grows with the logarithm of the longest path, whatever the size of a component.
    """
    start = edges.where("u is not null and v is not null and u <> v")
    now = save(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    while True:
        large = save(_star(now, True), "cc-large")
        small = save(_star(large, False), "cc-small")
        drop(now)
        drop(large)
        now = small
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1_000_003).cast("long"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
