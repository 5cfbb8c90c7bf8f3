"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import release, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest neighbour (or the node itself)."""
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("p"))
    return both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("p").alias("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("p"))
    moved = edges.join(least, "v").where("u <> p").select(F.col("u").alias("v"), F.col("p").alias("u"))
    return moved.union(least.select("v", F.col("p").alias("u"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every linked node; the component is its smallest node.

    Nodes without links are left out, as are loops and links to null. Each round writes its edges to the
    shared folder; it is the last one when no smaller end of an edge has a smaller neighbour itself.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"), (F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).alias("ok")).where("ok").select("v", "u").distinct(),
        "edges",
    )
    while not edges.isEmpty():
        before, edges = edges, stage(_small_star(_large_star(edges)), "edges")
        release(before)
        # in stars every larger end has one edge, and is no smaller end
        ends = edges.select("v", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("u", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            break
    roots = edges.select("u").distinct()
    return edges.select(F.col("v").alias("id"), F.col("u").alias("component")).union(roots.select(F.col("u").alias("id"), F.col("u").alias("component")))
