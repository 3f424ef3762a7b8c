"""Consolidating pairwise matches into groups: peel the giant component, propagate minima over the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.groups import smallest_label
from inkwell.plans.runtime import cut, ship_package, skew_join


def star_edges(features: DataFrame, item: str, feature: str) -> DataFrame:
    """(u, v): each item joined to the smallest item with the same feature. As many edges as features, however
    many items share one, where all pairs would grow with the square. A feature that any share of the items holds is spread over
    many tasks. Null items and features link nothing."""
    known = cut(features.select(item, feature).where(F.col(item).isNotNull() & F.col(feature).isNotNull()).distinct())
    low = known.groupBy(feature).agg(F.min(item).alias("v"))
    return skew_join(known, low, [feature], item).where(F.col(item) != F.col("v")).select(F.col(item).alias("u"), "v").distinct()


def peel(edges: DataFrame, rounds: int) -> tuple[tuple[DataFrame, int] | None, DataFrame]:
    """Breadth-first from the vertex of highest degree, at most ``rounds`` frontiers deep.

    Gives the vertices reached with their smallest, the root, and the edges left after the reached
    vertices are anti-joined away; edges that leave the reached part are kept, drawn from the root, so a component
    deeper than ``rounds`` is finished by the propagation and none is cut in two.
    """
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").select("u").head()
    if top is None:
        return None, edges
    reached = cut(both.sparkSession.createDataFrame([(top[0],)], "vertex bigint"))
    frontier = F.broadcast(reached)  # one vertex, with the most edges of all
    for _ in range(rounds):
        frontier = cut(both.join(frontier.withColumnRenamed("vertex", "u"), "u", "left_semi").select(F.col("v").alias("vertex")).distinct().join(reached, "vertex", "left_anti"))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    reached = cut(reached)
    root = reached.agg(F.min("vertex")).head()[0]
    inside = reached.select(F.col("vertex").alias("u"))
    untouched = edges.join(inside, "u", "left_anti").join(inside.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v")
    leaving = both.join(inside, "u", "left_semi").join(inside.withColumnRenamed("u", "v"), "v", "left_anti").select(F.lit(root).cast("bigint").alias("u"), "v")
    return (reached, root), cut(untouched.unionByName(leaving).distinct())


def connected_components(edges: DataFrame, rounds: int = 6) -> DataFrame:
    """(vertex, group_id): for each vertex of ``edges`` (u, v) the smallest vertex linked to it, directly or not.

    Null ends and self loops are dropped; repeated edges and either direction are fine; no edges give no rows.
    """
    ship_package(edges.sparkSession)
    edges = cut(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u is not null and v is not null and u <> v").distinct())
    giant, rest = peel(edges, rounds)
    labels = smallest_label(rest)
    if giant is None:
        return labels.select("vertex", F.col("label").alias("group_id"))
    labels = cut(labels)
    # the root may have been given a smaller label through edges that left the peeled part
    giant, root = giant
    moved = labels.where(F.col("vertex") == root).select("label").head()
    peeled = giant.select("vertex", F.lit(moved[0] if moved else root).cast("bigint").alias("group_id"))
    rest_labels = labels.join(giant.select("vertex"), "vertex", "left_anti").select("vertex", F.col("label").alias("group_id"))
    return peeled.unionByName(rest_labels)
