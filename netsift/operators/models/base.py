"""Shared parts of the detectors: feature vectors, parameters on disk."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vector(df: DataFrame, features: Sequence[str]) -> Column:
    """Features as one array of doubles; a single array column is taken as it is."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return F.col(features[0]).cast("array<double>")
    return F.array(*[F.col(c).cast("double") for c in features])


def is_complete(v: str | Column) -> Column:
    """All parts present and not NaN."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False))


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 0))


def save_parameters(spark: SparkSession, path: str, parameters: dict) -> None:
    spark.createDataFrame([(json.dumps(parameters),)], "parameters string").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters")


def load_parameters(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/parameters").first()["parameters"])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of two matrices."""
    if a.shape[1] <= 8:
        total = np.zeros((len(a), len(b)))
        for i in range(a.shape[1]):
            total += np.subtract.outer(a[:, i], b[:, i]) ** 2
        return total
    # centred first: the expanded square then loses little precision
    centre = b.mean(axis=0) if len(b) else 0.0
    a, b = a - centre, b - centre
    total = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :]
    total -= 2.0 * a @ b.T
    return np.maximum(total, 0.0, out=total)
