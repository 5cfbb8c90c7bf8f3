"""Packet streams and windowed statistics on event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators import flows
from netsift.sources.packets import parse_packet_lines, stream_packet_lines

WATERMARK = "10 minutes"


def packet_stream(spark: SparkSession, path: str, watermark: str = WATERMARK, max_files: int = 100) -> DataFrame:
    """Packets from a folder of JSON-lines files; later rows than the watermark are dropped by stateful steps."""
    return stream_packet_lines(spark, path, max_files).withWatermark("ts", watermark)


def kafka_packet_stream(
    spark: SparkSession, servers: str, topic: str, watermark: str = WATERMARK, max_offsets: int = 1_000_000
) -> DataFrame:
    """Packets as JSON values of a Kafka topic (needs Spark's Kafka connector)."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return parse_packet_lines(raw.select(F.col("value").cast("string").alias("value"))).withWatermark("ts", watermark)


def event_time(df: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Give any stream an event time; a time without zone is read as UTC session time."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def rate_windows(stream: DataFrame, width: str = "1 minute", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Packets, bytes and rates per window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    seconds = (F.unix_micros("window_end") - F.unix_micros("window_start")) / 1e6
    sums = stream.groupBy(window.alias("w")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.coalesce("length", F.lit(0)).cast("long")).alias("bytes")
    )
    flat = sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "packets", "bytes")
    return flat.withColumns({"avg_pps": F.col("packets") / seconds, "avg_bps": F.col("bytes") / seconds})


def sliding_summary(
    stream: DataFrame, width: str = "60 seconds", slide: str = "10 seconds", ts: str = "ts", protocols: Sequence[str] = flows.PROTOCOLS
) -> DataFrame:
    """Sizes, approximate distinct counts, protocol and flag shares per sliding window."""
    uniques = [F.approx_count_distinct(flows._present(c, k)).alias(n) for n, (c, k) in flows.UNIQUES.items()]
    out = stream.groupBy(F.window(ts, width, slide).alias("w")).agg(
        *flows.size_aggregates(), *uniques, *flows.protocol_aggregates(protocols), *flows.flag_aggregates()
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w"])


def flow_sessions(stream: DataFrame, gap: str = "60 seconds", bidirectional: bool = False, ts: str = "ts") -> DataFrame:
    """Flows that end when they are silent for ``gap``; the same columns as ``flow_features``."""
    keyed = flows.flow_keys(stream, bidirectional)
    sessions = keyed.groupBy(F.session_window(ts, gap).alias("session"), *flows.FLOW_KEY).agg(*flows.flow_aggregates(ts))
    return flows.flow_rates(sessions.drop("session"))
