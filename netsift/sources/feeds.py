"""Indicator feeds: plain text, rule files, pulses, blacklists, and their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.functions.network import is_ip

# Source vocabulary of pulse indicators.
PULSE_TYPES = {
    "IPv4": "ip",
    "domain": "domain",
    "hostname": "domain",
    "URL": "url",
    "FileHash-MD5": "hash",
    "FileHash-SHA1": "hash",
    "FileHash-SHA256": "hash",
}


def parse_text_feed(lines: DataFrame, feed: str) -> DataFrame:
    """Distinct indicators from a ``value`` column of feed lines.

    Blank lines and ``#`` comments are skipped; an address is an ``ip``, other
    text with a dot is a ``domain``.
    """
    text = F.trim("value")
    kind = F.when(is_ip(text), "ip").when(text.contains("."), "domain")
    return (
        lines.select(text.alias("text"), kind.alias("indicator_type"))
        .where((F.col("text") != "") & ~F.col("text").startswith("#") & F.col("indicator_type").isNotNull())
        .select(F.lit(feed).alias("feed"), "indicator_type", F.col("text").alias("value"))
        .distinct()
    )


def parse_rules_feed(lines: DataFrame, feed: str) -> DataFrame:
    """Distinct addresses in the bracketed lists of ``alert ip`` / ``drop ip`` rules."""
    text = F.trim("value")
    is_rule = ~text.startswith("#") & (text.contains("alert ip") | text.contains("drop ip"))
    lists = F.filter(F.split(text, "\\s+"), lambda t: t.startswith("[") & t.endswith("]") & (F.length(t) >= 2))
    members = F.flatten(F.transform(lists, lambda t: F.split(F.substring(t, F.lit(2), F.length(t) - 2), ",")))
    return (
        lines.where(is_rule)
        .select(F.explode(members).alias("value"))
        .select(F.trim("value").alias("value"))
        .where(is_ip("value"))
        .select(F.lit(feed).alias("feed"), F.lit("ip").alias("indicator_type"), "value")
        .distinct()
    )


def pulse_type(source_type: str | Column) -> Column:
    pairs = [F.lit(x) for kv in PULSE_TYPES.items() for x in kv]
    col = F.col(source_type) if isinstance(source_type, str) else source_type
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit("other"))


def parse_pulses(pulses: DataFrame, feed: str) -> DataFrame:
    """Distinct indicators of pulses (see ``schemas.PULSE``); no type or no value: left out."""
    return (
        pulses.select(F.explode("indicators").alias("i"))
        .where((F.col("i.type") != "") & (F.col("i.indicator") != ""))
        .select(F.lit(feed).alias("feed"), pulse_type("i.type").alias("indicator_type"), F.col("i.indicator").alias("value"))
        .distinct()
    )


def parse_blacklist(entries: DataFrame, feed: str, min_confidence: int = 90, limit: int | None = None) -> DataFrame:
    """Confident entries (``ip``, ``confidence``): all, or the ``limit`` most confident ones."""
    confident = (
        entries.where((F.col("confidence") >= min_confidence) & F.col("ip").isNotNull())
        .select(F.lit(feed).alias("feed"), F.lit("ip").alias("indicator_type"), F.col("ip").alias("value"), "confidence")
    )
    return confident if limit is None else confident.orderBy(F.col("confidence").desc(), "value").limit(limit)


def save_feed(indicators: DataFrame, path: str, now: Column) -> None:
    """Write a snapshot partitioned by feed; only the feeds in the data are replaced."""
    (
        indicators.select("feed", "indicator_type", "value", now.cast("timestamp").alias("last_updated"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("feed")
        .parquet(path)
    )


def load_feed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stale_feeds(snapshots: DataFrame, now: Column, max_age_hours: float = 24.0) -> DataFrame:
    """Last update and staleness per feed; never updated is stale."""
    age = now.cast("timestamp").cast("double") - F.col("last_updated").cast("timestamp").cast("double")
    return (
        snapshots.groupBy("feed")
        .agg(F.max("last_updated").alias("last_updated"))
        .withColumn("stale", F.coalesce(age > max_age_hours * 3600, F.lit(True)))
    )
