"""Distribution drift between a reference and a current sample."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.operators.ordering import ensure_checkpoints, running_totals

MIN_DRIFT_ROWS = 100
DRIFT_THRESHOLD = 0.1


def value_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A sample as counts: (feature, value, n). NULL and NaN are left out."""
    # rows are counted by the feature's number, which is cheaper to hash and to move than its name
    long = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("_no", "value"))
    counts = long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("_no", "value").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in features])
    return counts.select(F.get(names, F.col("_no")).alias("feature"), "value", "n")


def _steps(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature and distinct value: rows up to it on both sides, and the next value.

    Both sides are reduced to counts before they meet; the counts are written once, because several
    passes over them follow and each would read the samples again.
    """
    ensure_checkpoints(reference.sparkSession)
    both = value_table(reference, features).select("feature", "value", F.col("n").alias("r"), F.lit(0).cast("long").alias("c"))
    both = both.unionByName(value_table(current, features).select("feature", "value", F.lit(0).cast("long").alias("r"), F.col("n").alias("c")))
    counts = both.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    return running_totals(counts.checkpoint(), "value", {"rs": "r", "cs": "c"}, key="feature", next_value="next_value")


def drift_scores(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: KS statistic and Wasserstein distance over the reference range (at most 1)."""
    steps = _steps(reference, current, features)
    totals = steps.groupBy(F.col("feature").alias("_f")).agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    # one row per feature
    steps = steps.join(F.broadcast(totals), F.col("feature") == F.col("_f")).where("_r > 0 AND _c > 0")
    gap = F.abs(F.col("rs") / F.col("_r") - F.col("cs") / F.col("_c"))
    scores = steps.groupBy("feature").agg(
        F.max(gap).alias("ks"),
        F.sum(gap * F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))).alias("_w"),
        F.min(F.when(F.col("r") > 0, F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("r") > 0, F.col("value"))).alias("_hi"),
    )
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-10))
    return scores.select("feature", "ks", F.least(F.lit(1.0), F.col("_w") / span).alias("wasserstein"))


def ks_drift(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    return drift_scores(reference, current, features).select("feature", F.col("ks").alias("score"))


def wasserstein_drift(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    return drift_scores(reference, current, features).select("feature", F.col("wasserstein").alias("score"))


def drift_report(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    performance: float | Callable[[DataFrame], float] | None = None,
    baseline: float | None = None,
    threshold: float = DRIFT_THRESHOLD,
    min_rows: int = MIN_DRIFT_ROWS,
) -> DataFrame:
    """One row: rows seen, drift score and flag, drifted features, degraded performance.

    With fewer than ``min_rows`` current rows nothing is reported. A function
    given as ``performance`` is called with the current sample.
    """
    if callable(performance):
        performance = performance(current)
    rows = current.agg(F.count(F.lit(1)).alias("rows"))
    scores = ks_drift(reference, current, features).agg(
        F.max("score").alias("_score"),
        # at most one entry per feature
        F.array_sort(F.collect_list(F.when(F.col("score") > threshold, F.col("feature")))).alias("_drifted"),
    )
    enough = F.col("rows") >= min_rows
    lost = F.lit(performance).cast("double") < F.lit(baseline).cast("double") - threshold
    # one row each: a scalar subquery instead of a join without a key
    found = rows.withColumn("_s", scores.select(F.struct("_score", "_drifted")).scalar()).select("rows", "_s.*")
    return found.select(
        "rows",
        F.coalesce(F.when(enough, F.col("_score")), F.lit(0.0)).alias("drift_score"),
        F.coalesce(enough & (F.col("_score") > threshold), F.lit(False)).alias("drift_detected"),
        F.when(enough, F.col("_drifted")).otherwise(F.array().cast("array<string>")).alias("drifted_features"),
        F.coalesce(enough & lost, F.lit(False)).alias("performance_degradation"),
        F.lit(performance).cast("double").alias("current_performance"),
        F.lit(baseline).cast("double").alias("baseline_performance"),
    )


def should_retrain(report: DataFrame, now: Column, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Decision with reasons from a drift report."""
    drop = F.col("baseline_performance") - F.col("current_performance")
    reasons = F.array_compact(
        F.array(F.when(F.col("drift_detected"), "drift_detected"), F.when(drop > threshold, "performance_degradation"))
    )
    return report.select(
        (F.size(reasons) > 0).alias("retrain"),
        reasons.alias("reasons"),
        F.col("drifted_features"),
        F.when(drop > threshold, drop).alias("performance_drop"),
        F.when(F.size(reasons) > 0, now).alias("decided_at"),
    )


def reset_baseline(sample: DataFrame, features: Sequence[str], path: str) -> None:
    """Store a sample's value counts as the new reference."""
    value_table(sample, features).write.mode("overwrite").parquet(path)


def performance_trend(history: DataFrame, ts: str = "ts", value: str = "performance", last: int = 20) -> DataFrame:
    """Newest minus oldest of the last ``last`` evaluations (needs two)."""
    recent = history.orderBy(F.col(ts).desc()).limit(last)
    change = F.max_by(value, ts) - F.min_by(value, ts)
    n = F.count(F.lit(1))
    return recent.agg(n.alias("evaluations"), F.when(n >= 2, change).alias("trend"))
