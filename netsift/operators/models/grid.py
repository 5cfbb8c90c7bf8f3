"""Density clusters of points with up to three numbers, on a grid.

A grid cell is so small that any two of its points are within ``eps``. So all points of a cell with enough
weight are core points without a look at each other, and the core points of one cell are one node. Distances
are computed only between neighbouring occupied cells: for the few points of light cells, and once between
cells that both hold core points. Each cell has at most 124 neighbours, so the work for a point does not grow
with the density around it.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators.models.components import connected_components

MAX_FEATURES = 3
#: points of one cell that are compared with another cell in one task
BLOCK = 2_000
#: cell numbers stay exact below this
LARGEST = 1 << 50


def fits(points: DataFrame, eps: float) -> bool:
    """Whether the grid can be used: one to three numbers a point, none too large for the cell size."""
    if not eps > 0:
        return False
    row = points.agg(F.max(F.size("x")).alias("d"), F.max(F.array_max(F.transform("x", F.abs))).alias("far")).first()
    return row["d"] is not None and 1 <= row["d"] <= MAX_FEATURES and row["far"] / eps * math.sqrt(MAX_FEATURES) < LARGEST


def _distance(x: str, y: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def _neighbours(cells: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """``(a, b)``: occupied cells, in both directions, whose points may be within ``eps``."""
    reach = math.ceil(math.sqrt(d))
    near = [o for o in itertools.product(range(-reach - 1, reach + 2), repeat=d) if any(o) and side * math.sqrt(sum(max(abs(v) - 1, 0) ** 2 for v in o)) <= eps * (1 + 1e-9)]
    steps = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in near])
    asked = cells.select(F.col("cell").alias("a"), F.explode(steps).alias("_o")).select("a", F.zip_with("a", "_o", lambda x, y: x + y).alias("b"))
    return asked.join(cells.select(F.col("cell").alias("b")), "b").select("a", "b")


def cluster(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``(id, root, core)`` of the clustered points of ``(id, x, w)``; a border point has a row for each cluster in reach.

    ``root`` names the cluster. Distinct points are expected, each with its number of rows ``w``.
    """
    d = points.select(F.size("x")).first()[0]
    # a little under the side at which the corners of a cell are eps apart
    side = eps / math.sqrt(d) * (1 - 1e-9)
    placed = points.withColumn("cell", F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long"))).checkpoint()
    cells = placed.groupBy("cell").agg(F.sum("w").alias("weight")).checkpoint()
    pairs = _neighbours(cells, d, side, eps).checkpoint()
    other = placed.select(F.col("cell").alias("b"), F.col("id").alias("_id"), F.col("x").alias("_x"), F.col("w").alias("_w"))
    light = placed.join(cells.where(F.col("weight") < least), "cell")
    met = light.join(pairs, F.col("cell") == F.col("a")).join(other, "b").where(_distance("x", "_x") <= eps)
    near = met.groupBy("id").agg(F.sum("_w").alias("near"))
    few = light.join(near, "id", "left").select("id", (F.col("weight") + F.coalesce("near", F.lit(0)) >= least).alias("core"))
    core = placed.join(few, "id", "left").withColumn("core", F.coalesce("core", F.lit(True))).select("id", "x", "cell", "core").checkpoint()
    held = core.where("core").select("id", "x", "cell")
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min_by("x", "id").alias("first")).checkpoint()
    name = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ":")
    both = pairs.join(sizes.select(F.col("cell").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("cell").alias("b"), F.col("first").alias("first_b")), "b").checkpoint()
    # most neighbouring cells are linked by a point near the other's first one
    easy = held.join(both, F.col("cell") == F.col("a")).where(_distance("x", "first_b") <= eps).select("a", "b")
    edges = easy.select(name("a").alias("a"), name("b").alias("b")).union(sizes.select(name("cell").alias("a"), name("cell").alias("b"))).distinct().checkpoint()
    roots = connected_components(edges).checkpoint()
    # pairs that are still apart are compared in full, points far from the other cell left out
    known = [roots.select(F.col("node").alias(f"_n{i}"), F.col("root").alias(f"_r{i}")) for i in (0, 1)]
    apart = both.where(F.col("a") < F.col("b")).join(known[0], name("a") == F.col("_n0")).join(known[1], name("b") == F.col("_n1")).where("_r0 <> _r1")
    apart = apart.select("a", "b", F.ceil(F.col("n_a") / BLOCK).cast("int").alias("blocks"))

    def outside(cell: str) -> Column:
        gaps = F.zip_with("x", cell, lambda v, c: F.greatest(c * side - v, v - (c + 1) * side, F.lit(0.0)))
        return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v * v))

    left = held.join(apart, F.col("cell") == F.col("a")).where(outside("b") <= eps * (1 + 1e-9)).select("a", "b", F.pmod(F.xxhash64("id"), "blocks").alias("block"), "x")
    right = held.join(apart, F.col("cell") == F.col("b")).where(outside("a") <= eps * (1 + 1e-9))
    right = right.select("a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"), F.col("x").alias("_x"))
    more = left.join(right, ["a", "b", "block"]).where(_distance("x", "_x") <= eps).select("a", "b").distinct()
    more = more.select(name("a").alias("a"), name("b").alias("b")).checkpoint()
    if not more.isEmpty():
        roots = connected_components(edges.union(more)).checkpoint()
    cored = held.join(roots, name("cell") == F.col("node")).select("id", "cell", "x", "root")
    border = core.where("NOT core").select("id", "x", "cell")
    own = border.join(sizes.select("cell"), "cell").join(roots, name("cell") == F.col("node")).select("id", "root")
    target = cored.select(F.col("cell").alias("b"), F.col("x").alias("_x"), "root")
    # the first cell need not hold core points itself
    towards = pairs.join(sizes.select(F.col("cell").alias("b")), "b").select("a", "b")
    reached = border.join(towards, F.col("cell") == F.col("a")).join(target, "b").where(_distance("x", "_x") <= eps).select("id", "root")
    edge = own.union(reached).distinct()
    return cored.select("id", "root", F.lit(True).alias("core")).union(edge.select("id", "root", F.lit(False)))
