"""Queries that run real streams over the driver's tables, one availableNow run after another.

The packet view is written in slices of time; after each the stream runs over what is new and
stops, so state passes from run to run through the checkpoint. A last packet far behind
the others moves the watermark past all of them.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.operators import intel as I
from netsift.operators import thresholds as H
from netsift.operators.ordering import ensure_checkpoints, epoch_micros
from netsift.plans.catalogue import query
from netsift.plans.rules import HOUR, _RATE_TERMS, sparse_rules
from netsift.plans.series import _EWMA, series
from netsift.plans.tables import packets, with_packets
from netsift.sources import committed
from netsift.sources.logs import write_alerts
from netsift.sources.packets import JSON_TIMES, read_packets, write_packets
from netsift.streaming import stateful
from netsift.streaming.packets import packet_stream
from netsift.streaming.sinks import enrich_each_batch, parquet_sink


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    ensure_checkpoints(spark)
    return os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"{name}-{uuid.uuid4().hex}")


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own, so that the settings of the streams do not reach the caller's."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    # state is kept in so many parts for good, and each is a task of every batch
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(max(parts, 1)))
    return own


def time_ordered_slices(df: DataFrame, ts: str, slices: int) -> list[DataFrame]:
    """The rows in slices of equal length in time."""
    low, high = df.agg(F.min(epoch_micros(ts)), F.max(epoch_micros(ts))).first()
    if low is None:
        return []
    wide = (high - low) // slices + 1
    at = F.floor((epoch_micros(ts) - low) / wide)
    return [df.where(at == k) for k in range(slices)]


def closing_packet(spark: SparkSession, source: DataFrame, ts: str = "ts") -> DataFrame:
    """One packet without an id, 400 days after the last: it only moves the watermark on."""
    fields = [F.timestamp_micros(F.max(epoch_micros(ts)) + 400 * 24 * HOUR * 1_000_000).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields]
    return source.agg(*fields)


def replay(spark: SparkSession, source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, slices: int = 2, watermark: str = "1 hour") -> DataFrame:
    """Rows that the stream built by ``build`` gives for ``source``, read back from its sink."""
    own = stream_session(spark)
    folder = shared_folder(spark, name)
    inbox, out = os.path.join(folder, "in"), os.path.join(folder, "out")
    parts = time_ordered_slices(source, "ts", slices)
    result = None
    for part in [*parts, *([closing_packet(spark, source)] if parts else [])]:
        write_packets(part, inbox)
        result = build(packet_stream(own, inbox, watermark, max_files=1_000_000))
        run = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    if result is None:
        return build(source.limit(0))
    return spark.read.schema(result.schema).parquet(out)


_HIT = """CASE WHEN rate_001 THEN 'RATE-001' WHEN rate_002 THEN 'RATE-002' WHEN ip_001 THEN 'IP-001' WHEN ip_002 THEN 'IP-002'
      WHEN payload_001 THEN 'PAYLOAD-001' WHEN payload_002 THEN 'PAYLOAD-002' WHEN payload_003 THEN 'PAYLOAD-003'
      WHEN port_001 THEN 'PORT-001' WHEN comp_001 THEN 'COMP-001' END"""


@query(
    "k5_detect_stream",
    with_packets(f"""WITH {_RATE_TERMS},
      hits AS (SELECT *, {_HIT} AS rule_id FROM r2)
    SELECT packet_id, ts AS timestamp, rule_id, 'signature' AS type, src_ip AS source, dst_ip, src_port, dst_port, protocol, length,
      CASE WHEN length(payload) > 200 THEN concat(payload[1:200], '...') ELSE payload END AS payload,
      CASE rule_id WHEN 'IP-002' THEN 'medium' WHEN 'PAYLOAD-001' THEN 'critical' WHEN 'PAYLOAD-002' THEN 'critical'
        WHEN 'RATE-002' THEN 'medium' WHEN 'PORT-001' THEN 'medium' ELSE 'high' END AS severity
    FROM hits WHERE rule_id IS NOT NULL"""),
)
def detect_stream(spark, sf_dir):
    found = replay(spark, packets(spark, sf_dir), lambda stream: stateful.detect_stream(stream, sparse_rules()), "detect")
    own = [F.col(f"packet.{c}").alias(c) for c in ("dst_ip", "src_port", "dst_port", "protocol", "length", "payload")]
    return found.select("packet_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "rule_id", "type", "source", *own, "severity")


@query(
    "k4_rate_stream",
    with_packets("""SELECT packet_id, ts, coalesce(src_ip, '') || ':' || coalesce(CAST(dst_port AS VARCHAR), '') AS track_key FROM (SELECT *,
      count(*) OVER (PARTITION BY coalesce(src_ip, ''), coalesce(CAST(dst_port AS VARCHAR), '') ORDER BY ts
        RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS n FROM packets) WHERE n >= 2"""),
)
def rate_stream(spark, sf_dir):
    def build(stream: DataFrame) -> DataFrame:
        stateful.use_rocksdb(stream.sparkSession)
        return stateful.rate_stream(stream.where("packet_id IS NOT NULL"), "ip_port", 2, 48 * HOUR)

    found = replay(spark, packets(spark, sf_dir), build, "rates", slices=3)
    return found.select("packet_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "track_key")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsift.operators import rules as R

    return R.check_signatures(packets(spark, sf_dir), [r for r in R.default_rules() if not r.rule_id.startswith(("RATE", "COMP"))]).select(
        F.concat(F.lit("A-"), F.col("packet_id").cast("string")).alias("id"), "ts", "rule_id", "severity"
    )


_PLAIN_HIT = _HIT.replace("WHEN rate_001 THEN 'RATE-001' WHEN rate_002 THEN 'RATE-002' ", "").replace("WHEN comp_001 THEN 'COMP-001' ", "")


@query(
    "k8_committed_alerts",
    with_packets(f"""WITH {_RATE_TERMS}, hits AS (SELECT *, {_PLAIN_HIT} AS rule_id FROM r2)
    SELECT CAST(packet_id % 3 AS VARCHAR) AS batch_id, 'A-' || CAST(packet_id AS VARCHAR) AS id, ts, rule_id FROM hits WHERE rule_id IS NOT NULL"""),
)
def committed_alerts(spark, sf_dir):
    """Three batches, of which one is handed over twice and one again with a row more; each counts once."""
    alerts = _alerts(spark, sf_dir)
    path = shared_folder(spark, "alerts")
    sink = committed.committed_sink(path)
    number = F.substring("id", 3, 30).cast("long") % 3
    for batch_id in (0, 1, 0, 2):
        sink(alerts.where(number == batch_id), batch_id)
    sink(alerts.where(number <= 1), 1)
    found = committed.read_committed(spark, path, alerts.schema)
    return found.select("batch_id", "id", F.col("ts").cast("timestamp_ntz").alias("ts"), "rule_id")


@query("a3_write_packets", with_packets("SELECT packet_id, ts, protocol, src_ip, dst_ip, src_port, dst_port, length, payload, syn FROM packets"))
def write_and_read_packets(spark, sf_dir):
    """Packets as JSON lines and back."""
    path = shared_folder(spark, "packets")
    write_packets(packets(spark, sf_dir), path)
    found = read_packets(spark, path)
    return found.select("packet_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "length", "payload", F.col("tcp_flags.syn").alias("syn"))


@query(
    "a5_write_alerts",
    with_packets(f"""WITH {_RATE_TERMS}, hits AS (SELECT *, {_PLAIN_HIT} AS rule_id FROM r2)
    SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, ts, rule_id FROM hits WHERE rule_id IS NOT NULL"""),
)
def write_and_read_alerts(spark, sf_dir):
    """Alerts appended as JSON lines in two goes, and read back."""
    alerts, path = _alerts(spark, sf_dir), shared_folder(spark, "alert-lines")
    for part in (F.col("rule_id") == "PORT-001", F.col("rule_id") != "PORT-001"):
        write_alerts(alerts.where(part), path)
    found = spark.read.schema(alerts.schema).options(**JSON_TIMES).json(path)
    return found.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "rule_id")


@query("k6_resumed_thresholds", f"WITH {_EWMA} SELECT feature, row_id, round(m, 4) AS ewma, round(m + 3 * sqrt(v), 4) AS threshold FROM e")
def resumed_thresholds(spark, sf_dir):
    """The first third of the series as a batch, its state saved, and a stream that goes on from there."""
    own, folder = stream_session(spark), shared_folder(spark, "thresholds")
    first, *later = time_ordered_slices(series(spark, sf_dir), "ts", 3)
    done = H.ewma_threshold(first)
    H.save_threshold_state(done, os.path.join(folder, "saved"))
    state, _ = H.load_threshold_state(own, os.path.join(folder, "saved"))
    inbox, out = os.path.join(folder, "in"), os.path.join(folder, "out")
    for part in later:
        part.write.mode("append").parquet(inbox)
        source = own.readStream.schema(part.schema).parquet(inbox)
        run = stateful.ewma_stream(source, initial=state).writeStream.format("parquet").option("path", out)
        run.option("checkpointLocation", os.path.join(folder, "state")).trigger(availableNow=True).start().awaitTermination()
    columns = ["feature", "row_id", F.round("ewma", 4).alias("ewma"), F.round("threshold", 4).alias("threshold")]
    return done.select(*columns).union(spark.read.parquet(out).select(*columns))



@query(
    "k7_refreshed_feed",
    with_packets("""WITH cut AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half, min(ts) AS low FROM packets),
      lists AS (SELECT DISTINCT src_ip AS value, 'scan' AS feed, low AS t0, CASE WHEN src_ip LIKE '8.8.%' THEN half END AS t1 FROM packets, cut WHERE packet_id % 50 = 0
        UNION ALL SELECT DISTINCT dst_ip, 'sinkhole', half, CAST(NULL AS TIMESTAMP) FROM packets, cut WHERE packet_id % 97 = 0),
      ends AS (SELECT packet_id, ts, 'src_ip' AS field, src_ip AS value FROM packets UNION ALL SELECT packet_id, ts, 'dst_ip', dst_ip FROM packets)
    SELECT packet_id, field, value, feed FROM ends JOIN lists USING (value) WHERE ts >= t0 AND (t1 IS NULL OR ts < t1)"""),
)
def refreshed_feed(spark, sf_dir):
    """Feeds that change half way. All packets are matched after the change, each with the lists of its own time."""
    source, folder = packets(spark, sf_dir), shared_folder(spark, "feeds")
    low, high = source.agg(F.min(epoch_micros("ts")), F.max(epoch_micros("ts"))).first()
    if low is None:
        low = high = 0
    at = low + (high - low) // 2

    def listed(feed: str, end: str, every: int, when: int, keep=None) -> DataFrame:
        rows = source.where(F.col("packet_id") % every == 0).select(F.col(end).alias("value")).distinct()
        rows = rows if keep is None else rows.where(keep)
        return rows.select(F.lit(feed).alias("feed"), F.timestamp_micros(F.lit(when)).alias("snapshot_at"), F.lit("ip").alias("indicator_type"), "value")

    lists = [listed("scan", "src_ip", 50, low), listed("scan", "src_ip", 50, at, ~F.col("value").startswith("8.8.")), listed("sinkhole", "dst_ip", 97, at)]
    feed_path, inbox, out = (os.path.join(folder, name) for name in ("lists", "in", "out"))
    for part in lists:
        part.write.mode("append").parquet(feed_path)
    write_packets(source, inbox)
    own = stream_session(spark)
    query_ = enrich_each_batch(
        packet_stream(own, inbox, max_files=1_000_000),
        lambda: {"periods": I.feed_periods(own.read.parquet(feed_path))},
        lambda batch, tables: I.match_ip_as_of(batch, tables["periods"]),
        parquet_sink(out),
        os.path.join(folder, "state"),
    )
    query_.awaitTermination()
    return spark.read.parquet(out).select("packet_id", "field", "value", "feed")
