"""Model lifecycle: update decisions, registry, history, retraining.

State is kept in append-only tables; the current state is the latest row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators import drift as D
from netsift.operators import learning as L
from netsift.operators.evaluation import detector_quality
from netsift.operators.prepare import profile

# Stages of a model version.
STAGES = ["None", "Staging", "Production", "Archived"]

VERSION_SCHEMA = (
    "name string, version int, stage string, metric_name string, metric_value double, run_id string, "
    "tags map<string,string>, event_ts timestamp"
)


def update_needed(
    state: DataFrame,
    report: DataFrame,
    now: Column,
    max_hours: float = 168,
    min_hours: float = 12,
    min_samples: int = 1000,
) -> DataFrame:
    """Decision with reasons from a one-row state (``has_model``, ``last_update``) and a drift report."""
    hours = (now.cast("timestamp").cast("double") - F.col("last_update").cast("timestamp").cast("double")) / 3600
    never = F.col("last_update").isNull()
    rested = never | (hours >= min_hours)
    reasons = F.when(~F.col("has_model"), F.array(F.lit("no_model"))).otherwise(
        F.array_compact(
            F.array(
                F.when(never, "first_training"),
                F.when(hours >= max_hours, "max_interval"),
                F.when(F.col("drift_detected") & rested, "drift"),
                F.when(F.col("performance_degradation"), "performance"),
            )
        )
    )
    # both sides are one row: a scalar subquery instead of a join without a key
    seen = ["rows", "drift_detected", "performance_degradation"]
    one = state.withColumn("_r", report.select(F.struct(*seen)).scalar()).select(*state.columns, "_r.*").withColumn("reasons", reasons)
    return one.select(
        (F.size("reasons") > 0).alias("update_needed"),
        "reasons",
        hours.alias("hours_since_update"),
        F.col("rows").alias("available_samples"),
        ((F.col("rows") < min_samples) & (F.size("reasons") == 0)).alias("too_few_samples"),
    )


# -- registry -----------------------------------------------------------------


def latest_versions(events: DataFrame) -> DataFrame:
    """Current row of each (name, version) of a registry's event table."""
    last = F.max_by(F.struct(*[c for c in events.columns if c not in ("name", "version")]), "event_ts")
    return events.groupBy("name", "version").agg(last.alias("_l")).select("name", "version", "_l.*")


def promotion_events(events: DataFrame, name: str, version: int, stage: str, now: Column) -> DataFrame:
    """Event rows that move a version to a stage and archive the others there."""
    current = latest_versions(events).where(F.col("name") == name)
    moved = F.when(F.col("version") == version, F.lit(stage)).when(F.col("stage") == stage, F.lit("Archived"))
    return (
        current.withColumn("_to", moved)
        .where(F.col("_to").isNotNull() & ((F.col("version") == version) | (F.col("stage") == stage)))
        .withColumns({"stage": F.col("_to"), "event_ts": now})
        .select(*events.columns)
    )


def versions_in_stage(events: DataFrame, stage: str | None = None) -> DataFrame:
    current = latest_versions(events)
    return current if stage is None else current.where(F.col("stage") == stage)


def best_model(runs: DataFrame, metric: str, versions: DataFrame | None = None, stage: str = "Production", top: int = 5) -> DataFrame:
    """The best run by a metric among the top five; a run with a version in ``stage`` goes first."""
    leaders = runs.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), "run_id").limit(top)
    if versions is None:
        return leaders.limit(1)
    staged = versions.where(F.col("stage") == stage).groupBy(F.col("run_id").alias("_run")).agg(
        F.max("version").alias("version"), F.first("stage").alias("stage")
    )
    joined = leaders.join(staged, F.col("run_id") == F.col("_run"), "left").drop("_run")
    return joined.orderBy(F.col("stage").isNull(), F.col(metric).desc(), "run_id").limit(1)


@dataclass
class Registry:
    """A registry in a parquet folder of events."""

    spark: SparkSession
    path: str

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSION_SCHEMA).parquet(self.path)
        except Exception as error:  # nothing registered yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], VERSION_SCHEMA)

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def register(self, name: str, run_id: str, metric: tuple[str, float] | None, tags: dict[str, str], now: Column) -> int:
        last = self.events().where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = (last or 0) + 1
        metric_name, metric_value = metric or (None, None)
        row = [(name, version, "None", metric_name, metric_value, run_id, tags)]
        columns = VERSION_SCHEMA.rsplit(",", 1)[0]
        self._append(self.spark.createDataFrame(row, columns).withColumn("event_ts", now.cast("timestamp")))
        return version

    def promote(self, name: str, version: int, stage: str, now: Column) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage: {stage}")
        self._append(promotion_events(self.events(), name, version, stage, now.cast("timestamp")))

    def versions(self, stage: str | None = None) -> DataFrame:
        return versions_in_stage(self.events(), stage)


# -- history ------------------------------------------------------------------

HISTORY_SCHEMA = "update_ts timestamp, version int, samples long, quality double, promoted boolean"


def append_history(spark: SparkSession, path: str, version: int, samples: int, quality: float | None, promoted: bool, now: Column) -> None:
    row = spark.createDataFrame([(version, samples, quality, promoted)], HISTORY_SCHEMA.split(", ", 1)[1])
    row.select(now.cast("timestamp").alias("update_ts"), "*").write.mode("append").parquet(path)


def update_status(history: DataFrame) -> DataFrame:
    """One row: number of updates, promotions, and the last one."""
    return history.agg(
        F.count(F.lit(1)).alias("updates"),
        F.count_if("promoted").alias("promotions"),
        F.max("update_ts").alias("last_update"),
        F.max_by("version", "update_ts").alias("last_version"),
        F.max_by("quality", "update_ts").alias("last_quality"),
    )


@dataclass
class RetrainResult:
    version: int
    samples: int
    quality: float
    stage: str
    profile: DataFrame


def retrain(
    labelled: DataFrame,
    features: Sequence[str],
    row_id: str,
    fit: Callable[[DataFrame], object],
    folder: str,
    now: Column,
    name: str = "detector",
    label: str = "is_anomaly",
    threshold: float = 0.85,
    seed: int = 42,
    min_per_class: int = 50,
    max_rows: int | None = None,
) -> RetrainResult | None:
    """Profile, balance, fit, evaluate, register and promote a detector; None if a class is too small.

    ``fit(df)`` returns a detector (see ``operators.models``). At
    ``threshold`` quality the version goes to Production, else to Staging; the
    drift reference becomes the training rows.
    """
    spark = labelled.sparkSession
    described = profile(labelled.select(*features))
    sample = L.balanced_sample(labelled, label, row_id, seed, min_per_class, max_rows)
    size = sample.count()
    if size == 0:
        return None
    detector = fit(sample)
    quality = detector_quality(detector.transform(sample), "score", label, lower_is_anomalous=detector.lower_is_anomalous).first()["quality"]
    registry = Registry(spark, f"{folder}/registry")
    version = registry.register(name, f"{name}-run", ("quality", quality), {"samples": str(size)}, now)
    detector.save(f"{folder}/models/{name}/{version}")
    stage = "Production" if quality >= threshold else "Staging"
    registry.promote(name, version, stage, now + F.expr("INTERVAL 1 MICROSECOND"))
    append_history(spark, f"{folder}/history", version, size, quality, stage == "Production", now)
    D.reset_baseline(sample, features, f"{folder}/drift_reference")
    return RetrainResult(version, size, quality, stage, described)
