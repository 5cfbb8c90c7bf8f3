"""Anomaly detectors with one interface.

``get_detector(kind, **options)`` gives an estimator; its ``fit(df)`` a fitted
detector with ``transform(df)`` (adds ``score`` and ``is_anomaly``),
``save(path)`` and ``lower_is_anomalous``; ``load_detector`` reads it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators.models.base import load_parameters
from netsift.operators.models.density import Dbscan, FittedDbscan, FittedLof, Lof
from netsift.operators.models.forest import FittedIsolationForest, IsolationForest
from netsift.operators.models.svm import FittedOneClassSvm, OneClassSvm

DETECTORS = {"isolation_forest": IsolationForest, "dbscan": Dbscan, "lof": Lof, "one_class_svm": OneClassSvm}
FITTED = {
    "isolation_forest": FittedIsolationForest,
    "dbscan": FittedDbscan,
    "lof": FittedLof,
    "one_class_svm": FittedOneClassSvm,
}


def get_detector(kind: str, **options):
    if kind not in DETECTORS:
        raise ValueError(f"unknown detector type: {kind}")
    return DETECTORS[kind](**options)


def train(df: DataFrame, kind: str = "isolation_forest", **options):
    return get_detector(kind, **options).fit(df)


def score(detector, df: DataFrame) -> DataFrame:
    return detector.transform(df)


def load_detector(spark: SparkSession, path: str):
    return FITTED[load_parameters(spark, path)["kind"]].load(spark, path)


def score_with(
    df: DataFrame, model: Callable, threshold: float = 0.7, name: str = "probability", only_alerts: bool = True
) -> DataFrame:
    """Score batches with a user's function and keep the rows above ``threshold``.

    ``model`` maps a pandas frame to one number per row; it runs on Arrow
    batches inside the tasks.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def batches(frames):
        for frame in frames:
            yield frame.assign(**{name: model(frame)})

    scored = df.mapInPandas(batches, schema)
    return scored.where(F.col(name) > threshold) if only_alerts else scored
