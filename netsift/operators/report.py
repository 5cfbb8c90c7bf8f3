"""Report tables: counts over time, shares, top lists, histograms, rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.ordering import epoch_micros, order_values, row_numbers, seconds_to_micros


def count_over_time(df: DataFrame, seconds: float = 60, ts: str = "ts") -> DataFrame:
    """Rows per interval from the first to the last, empty intervals as 0."""
    step = seconds_to_micros(seconds)
    start = (F.floor(epoch_micros(ts) / F.lit(step)) * step).cast("long")
    counts = df.where(F.col(ts).isNotNull()).groupBy(start.alias("_us")).agg(F.count(F.lit(1)).alias("n"))
    limits = df.agg(F.min(start).alias("a"), F.max(start).alias("b")).first()
    first, last = (limits["a"], limits["b"] + 1) if limits["a"] is not None else (0, 0)
    spine = df.sparkSession.range(first, last, step).withColumnRenamed("id", "_us")
    kind = df.schema[ts].dataType
    return (
        spine.join(counts, "_us", "left")
        .select(F.timestamp_micros("_us").cast(kind).alias("interval_start"), F.coalesce("n", F.lit(0)).alias("count"))
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value; NULL is left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return counts.select("value", "count", (F.col("count") * 100.0 / total).alias("percent"))


def top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values; ties go to the smaller value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.col("count").desc(), "value").limit(n)


def top_features(df: DataFrame, n: int = 20, name: str = "feature", importance: str = "importance") -> DataFrame:
    return df.orderBy(F.col(importance).desc(), name).limit(n).select(name, importance)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin includes the maximum; empty bins 0."""
    x = F.col(column).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    low = F.lit(lo).cast("double")
    width = F.lit(((hi - lo) / bins if hi > lo else 1.0 / bins) if lo is not None else None).cast("double")
    placed = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(placed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").where(low.isNotNull()).select(
        "bin",
        (low + F.col("bin") * width).alias("bin_start"),
        (low + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def traffic_heatmap(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Counts by weekday (Monday first) and hour; missing cells 0."""
    spark = df.sparkSession
    cells = df.where(F.col(ts).isNotNull()).groupBy(F.weekday(ts).alias("weekday"), F.hour(ts).alias("_hour")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    wide = cells.groupBy("weekday").agg(
        *[F.coalesce(F.sum(F.when(F.col("_hour") == h, F.col("_n"))), F.lit(0)).alias(f"h{h:02d}") for h in range(24)]
    )
    days = spark.range(7).select(F.col("id").cast("int").alias("weekday"))
    names = F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday"))
    return days.join(wide, "weekday", "left").fillna(0).withColumn("day", names)


def rate_stats(df: DataFrame, ts: str = "ts", length: str = "length") -> DataFrame:
    """Packets, bytes, seconds observed, and average and highest per-second rate."""
    second = F.floor(epoch_micros(ts) / F.lit(1_000_000))
    per_second = df.groupBy(second.alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce(length, F.lit(0)).cast("long")).alias("_bytes"),
        F.min(epoch_micros(ts)).alias("_first"),
        F.max(epoch_micros(ts)).alias("_last"),
    )
    totals = per_second.agg(
        F.sum("_n").alias("packets"),
        F.sum("_bytes").alias("bytes"),
        ((F.max("_last") - F.min("_first")) / F.lit(1e6)).alias("seconds"),
        F.max("_n").alias("max_pps"),
        F.max("_bytes").alias("max_bps"),
    )

    def per(total: str):
        return F.when(F.col("seconds") > 0, F.col(total) / F.col("seconds")).otherwise(F.lit(0.0))

    return totals.withColumns({"avg_pps": per("packets"), "avg_bps": per("bytes")})


def latency_profile(df: DataFrame, column: str) -> DataFrame:
    """Average, extremes, p50 and p95 by index (no interpolation), and runs per second."""

    def picks(n: int) -> list[int]:
        return [n // 2, min(int(n * 0.95), n - 1)]

    n, values = order_values(df, {column: picks})[column]
    p50, p95 = (values[k] for k in picks(n)) if n else (None, None)
    x = F.col(column).cast("double")
    return df.agg(
        F.count(x).alias("runs"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max")
    ).select(
        "runs",
        "avg",
        "min",
        "max",
        F.lit(p50).cast("double").alias("p50"),
        F.lit(p95).cast("double").alias("p95"),
        F.when(F.col("avg") > 0, 1.0 / F.col("avg")).alias("throughput"),
    )


def compact_ports(df: DataFrame, key: str, port: str) -> DataFrame:
    """Ports per key as text with ranges: 1,2,3,7 gives ``1-3,7``. A key has at most 65536 ports."""
    distinct = df.where(F.col(port).isNotNull()).groupBy(key, port).agg(F.lit(1).alias("_one"))
    place = Window.partitionBy(key).orderBy(port)
    runs = (
        distinct.withColumn("_run", F.col(port) - F.row_number().over(place))
        .groupBy(key, "_run")
        .agg(F.min(port).alias("lo"), F.max(port).alias("hi"))
    )
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(
        F.concat(F.col("lo").cast("string"), F.lit("-"), F.col("hi").cast("string"))
    )
    spans = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("_spans"))
    return spans.select(key, F.array_join(F.col("_spans.t"), ",").alias("ports"))


def dashboard(packets: DataFrame, alerts: DataFrame, top: int = 10) -> dict[str, DataFrame]:
    """The tables of a traffic and alert report, by name. Persist the inputs to scan them once."""
    tables = {
        "packets_over_time": count_over_time(packets, 60),
        "protocols": value_counts(packets, "protocol"),
        "packet_sizes": histogram(packets, "length"),
        "heatmap": traffic_heatmap(packets),
        "rates": rate_stats(packets),
    }
    for column in ("src_ip", "dst_ip", "src_port", "dst_port"):
        tables[f"top_{column}"] = top_n(packets, column, top)
    if "timestamp" in alerts.columns:
        tables["alerts_over_time"] = count_over_time(alerts, 3600, "timestamp")
    for column in ("alert_type", "severity"):
        if column in alerts.columns:
            tables[f"{column}s"] = value_counts(alerts, column)
    return tables


def assign_batches(
    df: DataFrame, order: Sequence[str], size: int, sinks: Sequence[str] = (), slice_seconds: float = 3600.0
) -> DataFrame:
    """Number rows into batches of ``size`` per sink, in order.

    The first order column is a time (or a number of seconds); rows are ranked
    in slices of it and not sink by sink.
    """
    numbered = row_numbers(df, sinks, order[0], list(order[1:]), slice_seconds)
    return numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("long")).drop("_rn")
