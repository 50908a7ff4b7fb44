"""Connected components of links between ids, as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links`` with ``component`` the smallest id that it reaches.

    Each round points every larger neighbour of a node at the smallest one (large star), then does the
    same on the smaller side (small star); the number of rounds grows with the logarithm of a chain's
    length. A hub's minimum is a partial aggregate; it is written before the join that hands it out, so
    that Spark can split the hub's links there. Every round is cut with a written table. Links with a null
    end and self-links are left out; without links the result is empty.
    """
    edges = links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u is not null and v is not null and u <> v").distinct()
    edges = cut(edges)
    if edges.isEmpty():
        return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
    for _ in range(max_rounds):
        if _is_stars(edges):
            break
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = cut(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m")))
        # large star: larger neighbours u > v are linked to the least of v's neighbourhood
        large = both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v")
        # small star: v and its smaller neighbours are linked to the least of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        near = large.join(low, "v")
        edges = cut(near.select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").unionByName(low.select("v", F.col("m").alias("u"))).distinct())
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def least_ids(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``nodes`` (``node, id`` and more) with ``component_id``: the smallest id of the nodes of a node's component, itself included."""
    labelled = cut(nodes.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = cut(labelled.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("members")).where("members > 1"))
    return labelled.join(least.drop("members"), "component", "left").withColumn("component_id", F.coalesce("component_id", "id")).drop("component")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one link and none is linked to a node that has one, by one aggregate in which hubs fold before they meet."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    each = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return each.where("below > 1 or below = 1 and above = 1").isEmpty()
