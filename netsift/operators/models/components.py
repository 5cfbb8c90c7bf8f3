"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.operators.ordering import ensure_checkpoints


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours (above the node if ``large``, else at or below it) to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge; the root is the least node of its component.

    Alternates large and small stars until nothing changes; each round is
    checkpointed, so the plan stays short.
    """
    ensure_checkpoints(edges.sparkSession)
    nodes = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct()
    current = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct().checkpoint()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(current)
    while True:
        current = _stars(_stars(current, True), False).checkpoint()
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return nodes.join(roots, F.col("node") == F.col("_a"), "left").select("node", F.coalesce("_b", "node").alias("root"))
