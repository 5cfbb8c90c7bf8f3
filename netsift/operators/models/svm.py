"""One-class SVM with an approximate radial kernel."""

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


def _map(x: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    return math.sqrt(2.0 / len(phase)) * np.cos(x @ omega + phase)


@dataclass
class OneClassSvm:
    """Random Fourier features and subgradient descent; every step is one distributed sum.

    An approximation: the kernel is sampled (``components`` features) and the
    offset is set so that a share ``nu`` of the training rows is anomalous.
    """

    features: Sequence[str]
    id_col: str | None = None
    nu: float = 0.1
    components: int = 128
    steps: int = 20
    seed: int = 42

    def fit(self, df: DataFrame) -> FittedOneClassSvm:
        points = df.select(vector(df, self.features).alias("x")).where(is_complete("x")).persist(StorageLevel.MEMORY_AND_DISK)
        flat = points.select(F.size("x").alias("d"), F.explode("x").alias("v"))
        row = flat.agg(F.max("d").alias("d"), F.var_pop("v").alias("v"), F.count(F.lit(1)).alias("cells")).first()
        if not row["cells"]:
            raise ValueError("no complete rows to fit")
        d, n = row["d"], row["cells"] // row["d"]
        gamma = 1.0 / (d * row["v"]) if row["v"] else 1.0
        rng = np.random.default_rng(self.seed)
        omega = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(d, self.components))
        phase = rng.uniform(0.0, 2.0 * math.pi, size=self.components)
        m = self.components

        def sums(weights: np.ndarray | None, rho: float) -> np.ndarray:
            """Count and feature sum of the rows inside the margin (all rows without weights)."""

            def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros(m + 1)
                for frame in frames:
                    if not len(frame):
                        continue
                    z = _map(matrix(frame["x"]), omega, phase)
                    inside = z if weights is None else z[z @ weights < rho]
                    total[0] += len(inside)
                    total[1:] += inside.sum(axis=0)
                yield pd.DataFrame({"i": np.arange(m + 1), "s": total})

            got = points.mapInPandas(partial, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # m + 1 rows
            out = np.zeros(m + 1)
            for r in got:
                out[r["i"]] = r["s"]
            return out

        w = sums(None, 0.0)[1:] / n
        rho = float(w @ w)
        best_w = w.copy()
        for step in range(1, self.steps + 1):
            active = sums(w, rho)
            rate = 1.0 / (step + 1)
            w = w - rate * (w - active[1:] / (self.nu * n))
            rho = rho - rate * (active[0] / (self.nu * n) - 1.0) * float(w @ w)
            best_w = best_w + (w - best_w) * (2.0 / (step + 2))
        fitted = FittedOneClassSvm(list(self.features), omega, phase, best_w, 0.0)
        levels = fitted.transform(points.withColumnRenamed("x", "_level"), ["_level"]).select("score").persist(StorageLevel.DISK_ONLY)
        fitted.rho = quantiles(levels, {"score": [self.nu]})["score"][self.nu]
        levels.unpersist()
        points.unpersist()
        return fitted


@dataclass
class FittedOneClassSvm:
    features: list[str]
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    rho: float
    lower_is_anomalous: bool = field(default=True, init=False)

    def transform(self, df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
        """Score below 0: anomalous. Rows with missing features get NULL and are not anomalous."""
        omega, phase, weights, rho = self.omega, self.phase, self.weights, self.rho

        @F.pandas_udf("double")
        def level(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                yield pd.Series(_map(matrix(vectors), omega, phase) @ weights - rho if len(vectors) else np.zeros(0))

        x = vector(df, features or self.features)
        stand_in = F.array_repeat(F.lit(0.0), F.lit(len(omega)))
        scored = df.withColumn("score", F.when(is_complete(x), level(F.when(is_complete(x), x).otherwise(stand_in))))
        return scored.withColumn("is_anomaly", F.coalesce(F.col("score") < 0, F.lit(False)))

    def save(self, path: str) -> None:
        parameters = {
            "kind": "one_class_svm",
            "features": self.features,
            "omega": self.omega.tolist(),
            "phase": self.phase.tolist(),
            "weights": self.weights.tolist(),
            "rho": self.rho,
        }
        save_parameters(SparkSession.getActiveSession(), path, parameters)

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedOneClassSvm:
        p = load_parameters(spark, path)
        return FittedOneClassSvm(p["features"], np.array(p["omega"]), np.array(p["phase"]), np.array(p["weights"]), p["rho"])
