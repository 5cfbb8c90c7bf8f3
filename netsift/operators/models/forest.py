"""Isolation forest: trees grown in parallel from small hashed samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators.models.base import is_complete, load_parameters, matrix, save_parameters, vector
from netsift.operators.ordering import quantiles

EULER = 0.5772156649015329
_NODES = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list]:
    """Nodes of one tree as rows of (node, feature, split, left, right, size, depth)."""
    nodes: list[list] = []
    waiting = [(np.arange(len(x)), 0, -1, False)]
    while waiting:
        rows, depth, parent, is_right = waiting.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = me
        nodes.append([me, -1, 0.0, -1, -1, len(rows), depth])
        if depth >= limit or len(rows) <= 1:
            continue
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(high > low)
        if not len(varied):
            continue
        feature = int(rng.choice(varied))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= split
        nodes[me][1], nodes[me][2] = feature, split
        waiting.append((rows[~goes_left], depth + 1, me, True))
        waiting.append((rows[goes_left], depth + 1, me, False))
    return nodes


@dataclass
class IsolationForest:
    """``id_col`` identifies rows; the sample of each tree depends on it and the seed alone."""

    features: Sequence[str]
    id_col: str
    n_trees: int = 100
    sample_size: int = 256
    contamination: float = 0.1
    seed: int = 42

    def fit(self, df: DataFrame) -> FittedIsolationForest:
        base = df.select(F.col(self.id_col).alias("_id"), vector(df, self.features).alias("_x")).where(is_complete("_x"))
        n = base.count()
        if n == 0:
            raise ValueError("no complete rows to fit")
        size = min(self.sample_size, n)
        # enough rows for every tree with near certainty; each tree then takes the first of them by hash
        rate = min(1.0, (size + 8.0 * math.sqrt(size)) / n)
        bound = int(-(2**63) + rate * (2**64 - 1))
        seed = self.seed

        def draw(t):
            return F.xxhash64(F.lit(seed), t, F.col("_id"))

        trees = F.sequence(F.lit(0), F.lit(self.n_trees - 1))
        drawn = trees if rate >= 1.0 else F.filter(trees, lambda t: draw(t) <= F.lit(bound))
        sample = base.select("_id", "_x", F.explode(drawn).alias("tree")).withColumn("_h", draw(F.col("tree")))
        limit = math.ceil(math.log2(max(size, 2)))

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            tree = int(rows["tree"].iloc[0])
            chosen = rows.sort_values(["_h", "_id"]).head(size)
            grown = _grow(matrix(chosen["_x"]), np.random.default_rng([seed, tree]), limit)
            out = pd.DataFrame(grown, columns=["node", "feature", "split", "left", "right", "size", "depth"])
            out.insert(0, "tree", tree)
            return out

        # at most n_trees * (2 * sample_size - 1) nodes
        nodes = sample.groupBy("tree").applyInPandas(build, _NODES).toPandas().sort_values(["tree", "node"])
        fitted = FittedIsolationForest(list(self.features), nodes.reset_index(drop=True), size, 0.0)
        raw = fitted.raw_scores(df).where(F.col("_raw").isNotNull()).select("_raw").persist(StorageLevel.DISK_ONLY)
        fitted.offset = quantiles(raw, {"_raw": [self.contamination]})["_raw"][self.contamination]
        raw.unpersist()
        return fitted


@dataclass
class FittedIsolationForest:
    features: list[str]
    nodes: pd.DataFrame
    sample_size: int
    offset: float
    lower_is_anomalous: bool = field(default=True, init=False)

    def raw_scores(self, df: DataFrame) -> DataFrame:
        """Adds ``_raw``: minus two to the power of minus the relative path length."""
        trees = []
        for _, t in self.nodes.groupby("tree", sort=True):
            end = t["depth"].to_numpy() + mean_path(t["size"].to_numpy())
            trees.append((t["feature"].to_numpy(), t["split"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(), end))
        forest = df.sparkSession.sparkContext.broadcast(trees)
        usual = float(mean_path(np.array([self.sample_size]))[0]) or 1.0

        @F.pandas_udf("double")
        def path_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                x = matrix(vectors)
                total = np.zeros(len(x))
                rows = np.arange(len(x))
                for feature, split, left, right, end in forest.value:
                    at = np.zeros(len(x), dtype=np.int64)
                    open_rows = rows
                    while len(open_rows):
                        f = feature[at[open_rows]]
                        open_rows = open_rows[f >= 0]
                        if not len(open_rows):
                            break
                        here = at[open_rows]
                        goes_left = x[open_rows, feature[here]] <= split[here]
                        at[open_rows] = np.where(goes_left, left[here], right[here])
                    total += end[at]
                yield pd.Series(-(2.0 ** (-(total / len(forest.value)) / usual)))

        x = vector(df, self.features)
        # a Python function sees every row, so incomplete ones get a stand-in of equal length
        width = int(self.nodes["feature"].max()) + 1
        stand_in = F.array_repeat(F.lit(0.0), F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(width)))
        return df.withColumn("_raw", F.when(is_complete(x), path_score(F.when(is_complete(x), x).otherwise(stand_in))))

    def transform(self, df: DataFrame) -> DataFrame:
        """Score below 0: anomalous. Rows with missing features get NULL and are not anomalous."""
        scored = self.raw_scores(df).withColumn("score", F.col("_raw") - F.lit(self.offset)).drop("_raw")
        return scored.withColumn("is_anomaly", F.coalesce(F.col("score") < 0, F.lit(False)))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(self.nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        parameters = {"kind": "isolation_forest", "features": self.features, "sample_size": self.sample_size, "offset": self.offset}
        save_parameters(spark, path, parameters)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedIsolationForest:
        p = load_parameters(spark, path)
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        return FittedIsolationForest(p["features"], nodes, p["sample_size"], p["offset"])
