"""Density detectors: DBSCAN and local outlier factor."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators.models import grid
from netsift.operators.models import neighbors as N
from netsift.operators.models.base import is_complete, load_parameters, matrix, save_parameters, squared_distances, vector
from netsift.operators.models.components import connected_components
from netsift.operators.ordering import ensure_checkpoints, quantiles, running_totals


def _points(df: DataFrame, features: Sequence[str], id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), vector(df, features).alias("x")).where(is_complete("x"))


def _within(a: np.ndarray, b: np.ndarray, eps: float):
    """(start, boolean block) of distances up to ``eps``, a few rows of ``a`` at a time."""
    step = max(1, 8_000_000 // max(len(b), 1))
    for start in range(0, len(a), step):
        yield start, np.sqrt(squared_distances(a[start : start + step], b)) <= eps


def _local_groups(x: np.ndarray, eps: float) -> np.ndarray:
    """Component number of each row, rows within ``eps`` being linked (breadth first, no pair list)."""
    group = np.full(len(x), -1)
    for seed in range(len(x)):
        if group[seed] >= 0:
            continue
        group[seed] = seed
        front = np.array([seed])
        while len(front):
            open_rows = np.flatnonzero(group < 0)
            if not len(open_rows):
                break
            hit = np.zeros(len(open_rows), dtype=bool)
            for _, near in _within(x[front], x[open_rows], eps):
                hit |= near.any(axis=0)
            front = open_rows[hit]
            group[front] = seed
    return group


@dataclass
class Dbscan:
    """Clusters of core points (``min_samples`` rows within ``eps``, the row itself included).

    Equal vectors are first reduced to one weighted point, so copies cost
    nothing. Up to three features are clustered on a grid (:mod:`grid`). With
    more, points are sent to the cells around pivots with a border of ``eps``;
    each cell links its core points, and the cells' clusters are joined by
    connected components.
    """

    features: Sequence[str]
    id_col: str
    eps: float = 0.5
    min_samples: int = 5
    cell_rows: int = N.CELL_ROWS

    def fit(self, df: DataFrame) -> FittedDbscan:
        ensure_checkpoints(df.sparkSession)
        eps, least = self.eps, self.min_samples
        rows = _points(df, self.features, self.id_col)
        # one point per distinct vector, named by its least row id
        points = rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")).select("id", "x", "w").checkpoint()
        n = points.count()
        if n == 0:
            raise ValueError("no complete rows to fit")
        if grid.fits(points, eps):
            return self._fitted(points, grid.cluster(points, eps, least).checkpoint())
        centres = N.choose_pivots(points, n, self.cell_rows)
        placed = points.withColumn("_c", N.home_cell(centres)).select("id", "x", "w", F.col("_c.cell").alias("home"), "_c.d")
        pivots = N.build_pivots(placed.withColumnRenamed("home", "cell"), centres)
        spread = placed.select("id", "x", "w", "home", F.explode(N.halo_cells(centres, pivots.radius, eps)).alias("cell"))
        spread = spread.withColumn("own", F.col("home") == F.col("cell")).drop("home")
        id_type = points.schema["id"].dataType.simpleString()

        def weigh(part: pd.DataFrame) -> pd.DataFrame:
            own = part[part["own"]]
            x, w = matrix(part["x"]), part["w"].to_numpy()
            near = np.zeros(len(own), dtype=np.int64)
            if len(own):
                for start, block in _within(matrix(own["x"]), x, eps):
                    near[start : start + len(block)] = block @ w
            return pd.DataFrame({"id": own["id"].to_numpy(), "core": near >= least})

        core = spread.groupBy("cell").applyInPandas(weigh, f"id {id_type}, core boolean").checkpoint()
        marked = spread.join(core, "id")

        def link(part: pd.DataFrame) -> pd.DataFrame:
            cores = part[part["core"]].sort_values("id")
            empty = pd.DataFrame({"id": part["id"].iloc[:0], "part": pd.Series(dtype=object), "core": pd.Series(dtype=bool)})
            if not len(cores):
                return empty
            cx, ids = matrix(cores["x"]), cores["id"].to_numpy()
            group = _local_groups(cx, eps)
            cell = int(part["cell"].iloc[0])
            names = np.array([f"{cell}:{ids[g]}" for g in group], dtype=object)
            out = [pd.DataFrame({"id": ids, "part": names, "core": True})]
            border = part[~part["core"] & part["own"]]
            if len(border):
                bx, bid = matrix(border["x"]), border["id"].to_numpy()
                for start, block in _within(bx, cx, eps):
                    q, c = np.nonzero(block)
                    out.append(pd.DataFrame({"id": bid[start + q], "part": names[c], "core": False}).drop_duplicates())
            return pd.concat(out)

        parts = marked.groupBy("cell").applyInPandas(link, f"id {id_type}, part string, core boolean").checkpoint()
        # parts that share a core point are one cluster
        cores = parts.where("core")
        shared = cores.groupBy("id").agg(F.min("part").alias("a"))
        edges = cores.join(shared, "id").select("a", F.col("part").alias("b")).distinct()
        roots = connected_components(edges)
        return self._fitted(points, parts.join(roots, F.col("part") == F.col("node")).select("id", "root", "core"))

    def _fitted(self, points: DataFrame, clustered: DataFrame) -> FittedDbscan:
        """The detector for points ``(id, x, w)`` and their clusters ``(id, root, core)``."""
        # clusters are numbered by their least core row; a border point takes the first of its clusters
        first = clustered.where("core").groupBy("root").agg(F.min("id").alias("first"))
        numbered = running_totals(first.withColumn("_one", F.lit(1)), "first", {"_n": "_one"})
        labelled = clustered.join(numbered.select("root", (F.col("_n") - 1).cast("int").alias("cluster")), "root")
        labelled = labelled.groupBy("id").agg(F.min("cluster").alias("cluster"), F.max("core").alias("core"))
        points = points.join(labelled, "id", "left").select(
            "id", "x", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core")
        )
        return FittedDbscan(list(self.features), self.id_col, self.eps, points.checkpoint())


@dataclass
class FittedDbscan:
    """``points`` has one row per distinct training vector: id, x, cluster, core."""

    features: list[str]
    id_col: str
    eps: float
    points: DataFrame
    lower_is_anomalous: bool = field(default=False, init=False)

    def labels(self, df: DataFrame) -> DataFrame:
        """Training rows with their cluster; -1 is noise."""
        rows = _points(df, self.features, self.id_col)
        known = self.points.select(F.col("x").alias("_x"), "cluster")
        return rows.join(known, F.col("x") == F.col("_x")).select(F.col("id").alias(self.id_col), "cluster")

    def transform(self, df: DataFrame) -> DataFrame:
        """Score: distance to the nearest clustered core point, 1 if there is none; anomalous above ``eps``."""
        core = self.points.where("core AND cluster >= 0").select("id", "x")
        if core.isEmpty():
            scored = df.withColumn("score", F.lit(1.0))
        else:
            near = N.knn_join(_points(df, self.features, self.id_col), core, 1)
            near = near.select(F.col("qid").alias("_qid"), F.col("distance").alias("score"))
            scored = df.join(near, F.col(self.id_col) == F.col("_qid"), "left").drop("_qid")
        return scored.withColumn("is_anomaly", F.coalesce(F.col("score") > self.eps, F.lit(False)))

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        parameters = {"kind": "dbscan", "features": self.features, "id_col": self.id_col, "eps": self.eps}
        save_parameters(SparkSession.getActiveSession(), path, parameters)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedDbscan:
        p = load_parameters(spark, path)
        return FittedDbscan(p["features"], p["id_col"], p["eps"], spark.read.parquet(f"{path}/points"))


@dataclass
class Lof:
    """Local outlier factor; scores new rows against the training rows."""

    features: Sequence[str]
    id_col: str
    k: int = 20
    contamination: float = 0.1

    def fit(self, df: DataFrame) -> FittedLof:
        ensure_checkpoints(df.sparkSession)
        points = _points(df, self.features, self.id_col).checkpoint()
        n = points.count()
        k = min(self.k, n - 1)
        if k < 1:
            raise ValueError("at least two complete rows are needed")
        pairs = N.knn_join(points, points, k, skip_self=True).checkpoint()
        reach = pairs.groupBy(F.col("qid").alias("id")).agg(F.max("distance").alias("k_distance"))
        density = local_density(pairs, reach)
        train = points.join(reach, "id").join(density, "id").checkpoint()
        factors = outlier_factors(pairs, train.select("id", "lrd"), train.select(F.col("id").alias("pid"), F.col("lrd").alias("p_lrd")))
        cut = quantiles(factors, {"lof": [1.0 - self.contamination]})["lof"][1.0 - self.contamination]
        return FittedLof(list(self.features), self.id_col, k, cut, train)


def local_density(pairs: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, lrd): inverse mean reachability distance to the neighbours."""
    limits = reach.select(F.col("id").alias("pid"), "k_distance")
    distance = F.greatest("distance", "k_distance")
    return pairs.join(limits, "pid").groupBy(F.col("qid").alias("id")).agg((1.0 / (F.avg(distance) + 1e-10)).alias("lrd"))


def outlier_factors(pairs: DataFrame, own: DataFrame, others: DataFrame) -> DataFrame:
    """(id, lof): mean density of the neighbours over the row's own."""
    theirs = pairs.join(others, "pid").groupBy(F.col("qid").alias("id")).agg(F.avg("p_lrd").alias("_m"))
    return theirs.join(own, "id").select("id", (F.col("_m") / F.col("lrd")).alias("lof"))


@dataclass
class FittedLof:
    """``train`` has id, x, k_distance and lrd of the training rows."""

    features: list[str]
    id_col: str
    k: int
    cut: float
    train: DataFrame
    lower_is_anomalous: bool = field(default=False, init=False)

    def transform(self, df: DataFrame) -> DataFrame:
        """Score: outlier factor minus its training quantile; anomalous above 0."""
        pairs = N.knn_join(_points(df, self.features, self.id_col), self.train.select("id", "x"), self.k)
        density = local_density(pairs, self.train.select("id", "k_distance"))
        factors = outlier_factors(pairs, density, self.train.select(F.col("id").alias("pid"), F.col("lrd").alias("p_lrd")))
        scores = factors.select(F.col("id").alias("_qid"), (F.col("lof") - F.lit(self.cut)).alias("score"))
        scored = df.join(scores, F.col(self.id_col) == F.col("_qid"), "left").drop("_qid")
        return scored.withColumn("is_anomaly", F.coalesce(F.col("score") > 0, F.lit(False)))

    def save(self, path: str) -> None:
        self.train.write.mode("overwrite").parquet(f"{path}/train")
        parameters = {"kind": "lof", "features": self.features, "id_col": self.id_col, "k": self.k, "cut": self.cut}
        save_parameters(SparkSession.getActiveSession(), path, parameters)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedLof:
        p = load_parameters(spark, path)
        return FittedLof(p["features"], p["id_col"], p["k"], p["cut"], spark.read.parquet(f"{path}/train"))
