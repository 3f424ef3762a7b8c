"""Groups of linked rows and reachability over link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.plans.runtime import cut, discard


def _size(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).head()
    return row[0], row[1] or 0


def smallest_label(edges: DataFrame) -> DataFrame:
    """(vertex, label): the smallest vertex reachable over undirected edges (u, v), for each vertex that has an edge to another.

    Minimum propagation with shortcuts: every round hangs all larger neighbours of a vertex on its smallest neighbour, then all
    smaller ones, so a chain of n links is flat after a number of rounds that grows with log n. A hub's minimum is folded before the
    shuffle. Null ends and self loops are dropped, direction and repetition don't matter; no edges give no rows.
    """
    edges = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    before = _size(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now each edge points from larger to smaller
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, cut(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        after = _size(edges)
        if after == before:
            break
        before = after
    label = edges.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("label"))
    return label.unionByName(edges.select(F.col("v").alias("vertex"), F.col("v").alias("label")).distinct())


def within_hops(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes reached from ``start`` (node) over links (src, dst) with the least number of hops, up to ``depth``."""
    seen = cut(start.select("node", F.lit(0).alias("depth")).distinct())
    frontier = seen.select("node")
    for hop in range(1, depth + 1):
        fresh = cut(links.join(frontier.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if fresh.isEmpty():
            break
        seen = cut(seen.unionByName(fresh.withColumn("depth", F.lit(hop))))
        frontier = fresh
    return seen
