"""Adaptive thresholds over long series: (feature, ts, value), one row per observation.

Thresholds are those *after* a value; a value is compared with the threshold
before it (``previous_threshold``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.operators.decomposition import stl_threshold
from netsift.operators.learning import keep_latest
from netsift.operators.ordering import row_chunks, row_numbers, sliced_scan, time_cuts

SLICE_SECONDS = 3600.0


def _numbered(df: DataFrame, keys: Sequence[str], ts: str, tie: str, value: str, slice_seconds: float) -> DataFrame:
    return row_numbers(df.where(F.col(value).isNotNull()), keys, ts, [tie], slice_seconds)


def moving_threshold(
    df: DataFrame,
    keys: Sequence[str] = ("feature",),
    ts: str = "ts",
    tie: str = "row_id",
    value: str = "value",
    window: int = 100,
    k: float = 3.0,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Mean plus ``k`` population deviations of the last ``window`` values; infinite after one value.

    Series are numbered, cut into chunks of rows and given the rows before, so
    a long series is many tasks.
    """
    chunks = row_chunks(_numbered(df, keys, ts, tie, value, slice_seconds), window)
    order = Window.partitionBy(*keys, "_chunk").orderBy("_rn")

    def over(frame) -> Column:
        n = F.count(value).over(frame)
        level = F.avg(value).over(frame) + F.lit(k) * F.stddev_pop(value).over(frame)
        return F.when(n == 1, F.lit(math.inf)).when(n > 1, level)

    return (
        chunks.withColumn("threshold", over(order.rowsBetween(1 - window, 0)))
        .withColumn("previous_threshold", over(order.rowsBetween(-window, -1)))
        .where("_own")
        .drop("_rn", "_chunk", "_own")
    )


def ewma_threshold(
    df: DataFrame,
    keys: Sequence[str] = ("feature",),
    ts: str = "ts",
    tie: str = "row_id",
    value: str = "value",
    alpha: float = 0.3,
    k: float = 3.0,
    state: DataFrame | None = None,
    slice_seconds: float = 24 * SLICE_SECONDS,
) -> DataFrame:
    """Exponentially weighted mean and variance, and mean plus ``k`` deviations.

    What a stretch of values does to (mean, variance) is an affine map of
    (1, m, m*m, var), so each time slice is reduced to its map, the maps are
    chained per series, and the slices then run from their own start. ``state``
    (keys, ``ewma``, ``ewmvar``) continues earlier series.
    """
    keep = 1.0 - alpha
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, ts, tie, F.col(value).cast("double").alias("_v"))
    if state is not None:
        start = state.select(*[F.col(c).alias(f"_s_{c}") for c in keys], F.col("ewma").alias("_m0"), F.col("ewmvar").alias("_s0"))
        on = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys]
        rows = rows.join(start, on, "left").drop(*[f"_s_{c}" for c in keys])
    else:
        rows = rows.withColumns({"_m0": F.lit(None).cast("double"), "_s0": F.lit(None).cast("double")})

    def smooth(first: float, values: np.ndarray) -> np.ndarray:
        return pd.Series(np.concatenate([[first], values])).ewm(alpha=alpha, adjust=False).mean().to_numpy()

    def summarise(_: int, part: pd.DataFrame) -> pd.DataFrame:
        v = part["_v"].to_numpy()
        n = len(v)
        level = smooth(0.0, v)
        gap = v - level[:-1]
        i = np.arange(1, n + 1)
        return pd.DataFrame(
            {
                "decay": [keep**n],
                "mean_add": [level[-1]],
                "var_mm": [alpha * float(np.sum(keep ** (n + i - 1.0)))],
                "var_m": [-2.0 * alpha * keep**n * float(gap.sum())],
                "var_add": [alpha * float(np.sum(keep ** (n - i + 1.0) * gap**2))],
                "first_value": [v[0]],
                "m0": [part["_m0"].iloc[0]],
                "s0": [part["_s0"].iloc[0]],
            }
        )

    def fold(parts: pd.DataFrame) -> pd.DataFrame:
        first = parts.iloc[0]
        fresh = pd.isna(first["m0"])
        m, s = (first["first_value"], 0.0) if fresh else (first["m0"], first["s0"])
        out = []
        for place, (cut, p) in enumerate(zip(parts["_cut"], parts.itertuples(index=False), strict=True)):
            out.append((cut, m, s, fresh and place == 0))
            s = p.decay * s + p.var_mm * m * m + p.var_m * m + p.var_add
            m = p.decay * m + p.mean_add
        return pd.DataFrame(out, columns=["_cut", "m", "s", "fresh"])

    def apply(part: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        m, s, fresh = float(states["m"].iloc[0]), max(float(states["s"].iloc[0]), 0.0), bool(states["fresh"].iloc[0])
        v = part["_v"].to_numpy()
        level = smooth(m, v)
        spread = smooth(s, keep * (v - level[:-1]) ** 2)
        limit = level + k * np.sqrt(spread)
        before = limit[:-1].copy()
        if fresh:
            before[0] = np.nan
        return part.assign(ewma=level[1:], ewmvar=spread[1:], threshold=limit[1:], previous_threshold=before)

    added = [T.StructField(c, T.DoubleType()) for c in ("ewma", "ewmvar", "threshold", "previous_threshold")]
    schema = T.StructType([*(rows.schema[c] for c in [*keys, ts, tie]), T.StructField("_v", T.DoubleType()), *added])
    out = sliced_scan(
        time_cuts(rows, ts, slice_seconds),
        keys,
        [tie],
        summarise,
        "decay double, mean_add double, var_mm double, var_m double, var_add double, first_value double, m0 double, s0 double",
        fold,
        "m double, s double, fresh boolean",
        apply,
        schema,
    )
    out = out.withColumn("previous_threshold", F.when(~F.isnan("previous_threshold"), F.col("previous_threshold")))
    return out.withColumnRenamed("_v", value)


def seasonal_threshold(
    df: DataFrame,
    keys: Sequence[str] = ("feature",),
    ts: str = "ts",
    tie: str = "row_id",
    value: str = "value",
    period: int = 24,
    window: int = 100,
    k: float = 3.0,
    slice_seconds: float = SLICE_SECONDS,
) -> DataFrame:
    """Trend plus season plus ``k`` deviations of the residual.

    A decomposition from the past only: trend is the mean of the last
    ``period`` values, season the mean deviation from it at the same phase over
    the last ``window`` values, residual what remains. With fewer than
    two periods trend and season are 0 and the residuals are the values (0 for
    the first). The loess-based decomposition is ``stl_threshold``.
    """
    cycles = max(window // period, 1)
    reach = 2 * window + 2 * period + 1
    chunks = row_chunks(_numbered(df, keys, ts, tie, value, slice_seconds), reach).repartition(*keys, "_chunk")
    rn = F.col("_rn")
    order = Window.partitionBy(*keys, "_chunk").orderBy("_rn")
    phase = Window.partitionBy(*keys, "_chunk", "phase").orderBy("_rn")
    early = rn < 2 * period
    shaped = (
        chunks.withColumn("phase", ((rn - 1) % period).cast("int"))
        .withColumn("_t", F.when(rn >= period, F.avg(value).over(order.rowsBetween(1 - period, 0))))
        .withColumn("_d", F.col(value) - F.col("_t"))
        .withColumn("_s", F.avg("_d").over(phase.rowsBetween(1 - cycles, 0)))
        .withColumn("_e", F.col("_d") - F.col("_s"))
        .withColumn("_raw", F.when(rn == 1, F.lit(0.0)).otherwise(F.col(value)))
    )
    last = order.rowsBetween(1 - window, 0)
    spread = F.when(early, F.stddev_pop("_raw").over(last)).otherwise(F.stddev_pop("_e").over(last))
    out = (
        shaped.withColumn("residual_std", spread)
        .withColumn("trend", F.when(early, F.lit(0.0)).otherwise(F.col("_t")))
        .withColumn("seasonal", F.when(early, F.lit(0.0)).otherwise(F.col("_s")))
        .withColumn("threshold", F.col("trend") + F.col("seasonal") + F.lit(k) * F.col("residual_std"))
        .withColumn("previous_threshold", F.lag("threshold").over(order))
        .withColumn("slope", F.coalesce(F.col("trend") - F.lag("trend").over(order), F.lit(0.0)))
        .where("_own")
    )
    return out.withColumnRenamed("_rn", "position").drop("_chunk", "_own", "_t", "_d", "_s", "_e", "_raw")


def seasonal_forecast(thresholds: DataFrame, steps: int, keys: Sequence[str] = ("feature",), period: int = 24, k: float = 3.0, value: str = "value") -> DataFrame:
    """``steps`` values ahead from :func:`seasonal_threshold`: trend, slope and the season of each phase.

    With fewer than two periods the last value and threshold are repeated.
    """
    keys = list(keys)
    last = thresholds.groupBy(*keys).agg(
        F.max("position").alias("_n"),
        F.max_by(F.struct("trend", "slope", "residual_std", "threshold", F.col(value).alias("value")), "position").alias("_l"),
    )
    renamed = last.select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_n", "_l")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys]
    seasons = thresholds.join(renamed, on).where(F.col("position") > F.col("_n") - period)
    # the i-th step repeats the season of the i-th of the last ``period`` rows
    offset = F.col("position") - F.greatest(F.col("_n") - period, F.lit(0)) - 1
    # one entry per phase
    seasons = seasons.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(offset.alias("o"), F.col("seasonal").alias("s")))).alias("_season"))
    seasons = seasons.select(*[F.col(c).alias(f"_s_{c}") for c in keys], "_season")
    same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in keys]
    ahead = last.join(seasons, same).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    length = F.least(F.lit(period), F.col("_n"))
    season = F.try_element_at("_season", ((F.col("step") - 1) % length).cast("long"))
    enough = F.col("_n") >= 2 * period
    forecast = F.when(enough, F.col("_l.trend") + F.col("_l.slope") * F.col("step") + season).otherwise(F.col("_l.value"))
    limit = F.when(enough, F.col("forecast") + F.lit(k) * F.col("_l.residual_std")).otherwise(F.col("_l.threshold"))
    return ahead.withColumn("forecast", forecast).withColumn("threshold", limit).select(*keys, "step", "forecast", "threshold")


def flag_over_threshold(df: DataFrame, value: str = "value") -> DataFrame:
    """Anomalous when above the previous threshold; the first value never is."""
    return df.withColumn("is_anomaly", F.coalesce(F.col(value) > F.col("previous_threshold"), F.lit(False)))


@dataclass(frozen=True)
class ThresholdPlan:
    """How one feature is watched: ``moving``, ``ewma``, ``seasonal`` or ``stl``, with options of that function.

    ``method`` may also be a function like those: it takes the feature's rows,
    ``tie`` and the options, and adds ``threshold`` and ``previous_threshold``.
    """

    feature: str
    method: str | Callable[..., DataFrame] = "moving"
    options: dict = field(default_factory=dict)


METHODS = {"moving": moving_threshold, "ewma": ewma_threshold, "seasonal": seasonal_threshold, "stl": stl_threshold}


def apply_thresholds(df: DataFrame, plan: Sequence[ThresholdPlan], tie: str = "row_id") -> DataFrame:
    """Thresholds and flags of a long table by feature; features without a plan are not anomalous."""
    groups: dict[tuple, list[str]] = {}
    for p in plan:
        if not callable(p.method) and p.method not in METHODS:
            raise ValueError(f"unknown method: {p.method}")
        groups.setdefault((p.method, tuple(sorted(p.options.items()))), []).append(p.feature)
    columns = ["feature", "ts", tie, "value", "threshold", "previous_threshold"]
    base = df.select("feature", "ts", tie, F.col("value").cast("double").alias("value"))
    none = F.lit(None).cast("double")
    out = base.where(~F.coalesce(F.col("feature").isin([p.feature for p in plan]), F.lit(False)))
    out = out.withColumns({"threshold": none, "previous_threshold": none})
    for (method, options), features in groups.items():
        part = (method if callable(method) else METHODS[method])(base.where(F.col("feature").isin(features)), tie=tie, **dict(options))
        out = out.unionByName(part.select(*columns))
    return flag_over_threshold(out)


# -- state --------------------------------------------------------------------


def save_threshold_state(thresholds: DataFrame, path: str, keys: Sequence[str] = ("feature",), ts: str = "ts", tie: str = "row_id", window: int = 100) -> None:
    """Keep what a later run needs: the latest state row and the last ``window`` values per key."""
    state = [c for c in ("ewma", "ewmvar", "threshold") if c in thresholds.columns]
    latest = thresholds.groupBy(*keys).agg(F.max_by(F.struct(*state), F.struct(ts, tie)).alias("_s"))
    latest.select(*keys, "_s.*").write.mode("overwrite").parquet(f"{path}/state")
    recent = keep_latest(thresholds.select(*keys, ts, tie, "value"), ts, window, keys, tie)
    recent.write.mode("overwrite").parquet(f"{path}/recent")


def load_threshold_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(state row per key, recent values) as written by :func:`save_threshold_state`."""
    return spark.read.parquet(f"{path}/state"), spark.read.parquet(f"{path}/recent")


def resume_moving_threshold(df: DataFrame, recent: DataFrame, keys: Sequence[str] = ("feature",), ts: str = "ts", tie: str = "row_id", **options) -> DataFrame:
    """:func:`moving_threshold` of new rows after the saved recent values."""
    columns = [*keys, ts, tie, "value"]
    both = df.select(*columns, F.lit(True).alias("_new")).unionByName(recent.select(*columns, F.lit(False).alias("_new")))
    return moving_threshold(both, keys, ts, tie, **options).where("_new").drop("_new")
