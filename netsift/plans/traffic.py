"""Flow, window and report queries on the packet view."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import flows, report
from netsift.plans.catalogue import query
from netsift.plans.tables import packets, table, with_packets
from netsift.streaming import packets as live

FLAGS = ["syn", "ack", "fin", "rst", "psh", "urg"]


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _flow_sql(keys: dict[str, str]) -> str:
    flags = ", ".join(f"count(*) FILTER (WHERE protocol = 'TCP' AND {f}) AS tcp_{f}_count" for f in FLAGS)
    chosen = ", ".join(f"{v} AS {k}" for k, v in keys.items())
    return f"""WITH filled AS (SELECT coalesce(protocol, 'UNKNOWN') AS protocol, coalesce(src_ip, '0.0.0.0') AS src_ip,
        coalesce(dst_ip, '0.0.0.0') AS dst_ip, coalesce(src_port, 0) AS src_port, coalesce(dst_port, 0) AS dst_port,
        ts, length, {', '.join(FLAGS)} FROM packets),
      keyed AS (SELECT {chosen}, protocol, ts, length, {', '.join(FLAGS)} FROM filled),
      sums AS (SELECT protocol, src_ip, src_port, dst_ip, dst_port, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count,
        min(ts) AS start_time, max(ts) AS last_time, {flags}, count(*) FILTER (WHERE protocol = 'TCP') AS protocol_tcp_count,
        count(*) FILTER (WHERE protocol = 'UDP') AS protocol_udp_count, count(*) FILTER (WHERE protocol = 'ICMP') AS protocol_icmp_count
        FROM keyed GROUP BY ALL),
      timed AS (SELECT *, (epoch_us(last_time) - epoch_us(start_time)) / 1e6 AS d FROM sums)
    SELECT * EXCLUDE (d), round(d, 6) AS flow_duration, round(CASE WHEN d > 0 THEN packet_count / d ELSE 0 END, 6) AS packets_per_second,
      round(CASE WHEN d > 0 THEN byte_count / d ELSE 0 END, 6) AS bytes_per_second,
      round(CASE WHEN tcp_fin_count > 0 THEN tcp_syn_count / tcp_fin_count ELSE 0 END, 6) AS syn_fin_ratio,
      round(CASE WHEN tcp_rst_count > 0 THEN tcp_syn_count / tcp_rst_count ELSE 0 END, 6) AS syn_rst_ratio FROM timed"""


_ROUNDED = ["flow_duration", "packets_per_second", "bytes_per_second", "syn_fin_ratio", "syn_rst_ratio"]
_ONE_WAY = {"src_ip": "src_ip", "src_port": "src_port % 4", "dst_ip": "dst_ip", "dst_port": "dst_port"}
_SWAP = "(src_ip, src_port % 4) > (dst_ip, dst_port)"
_BOTH_WAYS = {
    "src_ip": f"CASE WHEN {_SWAP} THEN src_ip ELSE dst_ip END",
    "src_port": f"CASE WHEN {_SWAP} THEN src_port % 4 ELSE dst_port END",
    "dst_ip": f"CASE WHEN {_SWAP} THEN dst_ip ELSE src_ip END",
    "dst_port": f"CASE WHEN {_SWAP} THEN dst_port ELSE src_port % 4 END",
}


def few_port_packets(spark, sf_dir):
    """Packets on few source ports, so that flows have several packets."""
    return packets(spark, sf_dir).withColumn("src_port", F.col("src_port") % 4)


@query("e1_flow_features", with_packets(_flow_sql(_ONE_WAY)))
def flow_features(spark, sf_dir):
    return _round(flows.flow_features(few_port_packets(spark, sf_dir)), *_ROUNDED)


@query("e2_bidirectional_flows", with_packets(_flow_sql(_BOTH_WAYS)))
def bidirectional_flows(spark, sf_dir):
    return _round(flows.flow_features(few_port_packets(spark, sf_dir), bidirectional=True), *_ROUNDED)


_COMMON = "80, 443, 22, 21, 25, 53, 110, 143, 3306, 3389, 1433, 8080"


@query(
    "e3_advanced_flows",
    with_packets(f"""SELECT coalesce(src_ip, '0.0.0.0') AS src_ip, coalesce(src_port % 4, 0) AS src_port, coalesce(dst_ip, '0.0.0.0') AS dst_ip,
      coalesce(dst_port, 0) AS dst_port, protocol, count(*) AS packet_count,
      CAST(src_ip LIKE '192.168.%' AS INT) AS src_ip_is_private, CAST(dst_ip LIKE '10.%' AS INT) AS dst_ip_is_private,
      CAST(coalesce(src_port % 4, 0) BETWEEN 1 AND 1023 AS INT) AS src_port_is_well_known,
      CAST(coalesce(dst_port, 0) BETWEEN 1 AND 1023 AS INT) AS dst_port_is_well_known,
      CAST(coalesce(src_port % 4, 0) IN ({_COMMON}) AS INT) AS src_port_is_common,
      CAST(coalesce(dst_port, 0) IN ({_COMMON}) AS INT) AS dst_port_is_common FROM packets GROUP BY ALL"""),
)
def advanced_flows(spark, sf_dir):
    out = flows.advanced_flow_features(flows.flow_features(few_port_packets(spark, sf_dir)))
    return out.select(*flows.FLOW_KEY, "packet_count", *[c for c in out.columns if "_is_" in c])


_SIZES = """count(*) AS packet_count, round(avg(length), 6) AS avg_packet_size, round(stddev_pop(length), 6) AS std_packet_size,
  CAST(min(length) AS BIGINT) AS min_packet_size, CAST(max(length) AS BIGINT) AS max_packet_size,
  count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
  count(DISTINCT src_port) FILTER (WHERE src_port <> 0) AS unique_src_ports,
  count(DISTINCT dst_port) FILTER (WHERE dst_port <> 0) AS unique_dst_ports"""


@query(
    "e4_window_summary",
    with_packets(f"""SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS window_end,
      {_SIZES} FROM packets GROUP BY 1, 2"""),
)
def window_summary(spark, sf_dir):
    return _round(flows.window_summary(packets(spark, sf_dir), "6 hours"), "avg_packet_size", "std_packet_size")


@query(
    "e5_protocol_ratios",
    with_packets("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, """
    + ", ".join(f"round(count(*) FILTER (WHERE protocol = '{p}') / count(*), 6) AS protocol_{p.lower()}_ratio" for p in ("TCP", "UDP", "ICMP"))
    + " FROM packets GROUP BY 1"),
)
def protocol_ratios(spark, sf_dir):
    out = flows.protocol_ratios(packets(spark, sf_dir), "1 hour")
    return _round(out, *[c for c in out.columns if c.endswith("ratio")])


_FLAG_RATIOS = ", ".join(
    f"round(CASE WHEN count(*) FILTER (WHERE protocol = 'TCP') > 0 THEN count(*) FILTER (WHERE protocol = 'TCP' AND {f}) "
    f"/ count(*) FILTER (WHERE protocol = 'TCP') ELSE 0 END, 6) AS tcp_{f}_ratio"
    for f in FLAGS
)


@query("e6_flag_ratios", with_packets(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, {_FLAG_RATIOS} FROM packets GROUP BY 1"))
def flag_ratios(spark, sf_dir):
    out = flows.flag_ratios(packets(spark, sf_dir), "1 hour")
    return _round(out, *[c for c in out.columns if c.endswith("ratio")])


def _trailing_sql() -> str:
    uniques = {"unique_src_ips": "src_ip", "unique_dst_ips": "dst_ip", "unique_src_ports": "src_port", "unique_dst_ports": "dst_port"}
    parts = ["count(*) OVER w AS packet_count", "round(avg(length) OVER w, 6) AS avg_packet_size",
             "round(stddev_pop(length) OVER w, 6) AS std_packet_size", "CAST(min(length) OVER w AS BIGINT) AS min_packet_size",
             "CAST(max(length) OVER w AS BIGINT) AS max_packet_size"]
    parts += [f"count(DISTINCT {c}) FILTER (WHERE {c} IS NOT NULL) OVER w AS {n}" for n, c in uniques.items()]
    parts += [f"round(count(*) FILTER (WHERE protocol = '{p}') OVER w / count(*) OVER w, 6) AS protocol_{p.lower()}_ratio" for p in ("TCP", "UDP", "ICMP")]
    tcp = "count(*) FILTER (WHERE protocol = 'TCP') OVER w"
    parts += [f"round(CASE WHEN {tcp} > 0 THEN count(*) FILTER (WHERE protocol = 'TCP' AND {f}) OVER w / {tcp} ELSE 0 END, 6) AS tcp_{f}_ratio" for f in FLAGS]
    return "SELECT packet_id, protocol, " + ", ".join(parts) + """ FROM packets
      WINDOW w AS (PARTITION BY protocol ORDER BY ts RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW)"""


@query("f1_trailing_features", with_packets(_trailing_sql()))
def trailing_features(spark, sf_dir):
    out = flows.trailing_features(packets(spark, sf_dir), 3 * 3600, ["protocol"], "packet_id")
    return _round(out, "avg_packet_size", "std_packet_size", *[c for c in out.columns if c.endswith("ratio")])


@query(
    "e7_count_over_time",
    """WITH c AS (SELECT time_bucket(INTERVAL '1 minute', ts) AS interval_start, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT unnest(generate_series(min(interval_start), max(interval_start), INTERVAL '1 minute')) AS interval_start FROM c)
    SELECT interval_start, coalesce(n, 0) AS count FROM s LEFT JOIN c USING (interval_start)""",
)
def count_over_time(spark, sf_dir):
    return report.count_over_time(packets(spark, sf_dir), 60)


@query(
    "e8_value_counts",
    with_packets("SELECT protocol AS value, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM packets GROUP BY 1"),
)
def value_counts(spark, sf_dir):
    return _round(report.value_counts(packets(spark, sf_dir), "protocol"), "percent")


@query(
    "e9_top_n",
    with_packets("""SELECT 'src_ip' AS field, * FROM (SELECT src_ip AS value, count(*) AS count FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    UNION ALL SELECT 'dst_ip', * FROM (SELECT dst_ip, count(*) FROM packets GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
    UNION ALL SELECT 'src_port', * FROM (SELECT CAST(src_port AS VARCHAR), n FROM (SELECT src_port, count(*) AS n FROM packets WHERE src_port IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10))
    UNION ALL SELECT 'dst_port', * FROM (SELECT CAST(dst_port AS VARCHAR), n FROM (SELECT dst_port, count(*) AS n FROM packets WHERE dst_port IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10))"""),
)
def top_n(spark, sf_dir):
    p = packets(spark, sf_dir)
    parts = [
        report.top_n(p, c).select(F.lit(c).alias("field"), F.col("value").cast("string").alias("value"), "count")
        for c in ("src_ip", "dst_ip", "src_port", "dst_port")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "e10_histogram",
    with_packets("""WITH l AS (SELECT min(length) AS lo, (max(length) - min(length)) / 20 AS w FROM packets),
    c AS (SELECT CAST(least(floor((length - lo) / w), 19) AS INT) AS bin, count(*) AS n FROM packets, l GROUP BY 1),
    s AS (SELECT CAST(i AS INT) AS bin, lo, w FROM range(20) t(i), l)
    SELECT bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, coalesce(n, 0) AS count FROM s LEFT JOIN c USING (bin)"""),
)
def histogram(spark, sf_dir):
    return _round(report.histogram(packets(spark, sf_dir), "length"), "bin_start", "bin_end")


@query(
    "e11_traffic_heatmap",
    "SELECT CAST(d AS INT) AS weekday, CASE d "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(report.WEEKDAYS))
    + " END AS day, "
    + ", ".join(f"count(event_id) FILTER (WHERE hour(ts) = {h}) AS h{h:02d}" for h in range(24))
    + " FROM range(7) t(d) LEFT JOIN events ON isodow(ts) - 1 = d GROUP BY d",
)
def traffic_heatmap(spark, sf_dir):
    return report.traffic_heatmap(packets(spark, sf_dir))


@query(
    "e12_dashboard",
    with_packets("""WITH sev AS (SELECT CASE packet_id % 3 WHEN 0 THEN 'high' ELSE 'low' END AS severity, ts FROM packets),
    minutes AS (SELECT date_diff('minute', time_bucket(INTERVAL '1 minute', min(ts)), time_bucket(INTERVAL '1 minute', max(ts))) + 1 AS n, count(*) AS t FROM packets),
    hours AS (SELECT date_diff('hour', time_bucket(INTERVAL '1 hour', min(ts)), time_bucket(INTERVAL '1 hour', max(ts))) + 1 AS n, count(*) AS t FROM packets)
    SELECT 'packets_over_time' AS "table", n AS rows, t AS total FROM minutes
    UNION ALL SELECT 'alerts_over_time', n, t FROM hours
    UNION ALL SELECT 'protocols', count(DISTINCT protocol), count(*) FROM packets
    UNION ALL SELECT 'severitys', count(DISTINCT severity), count(*) FROM sev
    UNION ALL SELECT 'packet_sizes', 20, count(*) FROM packets"""),
)
def dashboard(spark, sf_dir):
    p = packets(spark, sf_dir)
    alerts = p.select(F.col("ts").alias("timestamp"), F.when(F.col("packet_id") % 3 == 0, "high").otherwise("low").alias("severity"))
    tables = report.dashboard(p, alerts)
    out = None
    for name in ("packets_over_time", "alerts_over_time", "protocols", "severitys", "packet_sizes"):
        part = tables[name].agg(F.count(F.lit(1)).alias("rows"), F.sum("count").alias("total")).select(F.lit(name).alias("table"), "rows", "total")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "e13_rate_stats",
    with_packets("""WITH s AS (SELECT floor(epoch_us(ts) / 1000000) AS s, count(*) AS n, sum(length) AS b, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS l
      FROM packets GROUP BY 1),
    t AS (SELECT CAST(sum(n) AS BIGINT) AS packets, CAST(sum(b) AS BIGINT) AS bytes, (max(l) - min(f)) / 1e6 AS seconds, max(n) AS max_pps,
      CAST(max(b) AS BIGINT) AS max_bps FROM s)
    SELECT packets, bytes, round(seconds, 6) AS seconds, max_pps, max_bps, round(packets / seconds, 6) AS avg_pps, round(bytes / seconds, 6) AS avg_bps FROM t"""),
)
def rate_stats(spark, sf_dir):
    return _round(report.rate_stats(packets(spark, sf_dir)), "seconds", "avg_pps", "avg_bps")


@query(
    "e14_latency_profile",
    """WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events)
    SELECT count(*) AS runs, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, max(value) FILTER (WHERE r = n // 2) AS p50,
      max(value) FILTER (WHERE r = CAST(floor(n * 0.95) AS BIGINT)) AS p95, round(1 / avg(value), 6) AS throughput FROM o""",
)
def latency_profile(spark, sf_dir):
    return _round(report.latency_profile(table(spark, sf_dir, "events"), "value"), "avg", "throughput")


@query(
    "e24_top_features",
    """SELECT p_name AS feature, p_retailprice AS importance FROM part ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_features(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_name AS feature", "p_retailprice AS importance")
    return report.top_features(p, 20)


# -- the windowed statistics of the streams, on the whole table

_HOURS = "INTERVAL '2 hours'"


@query(
    "k2_rate_windows",
    with_packets(f"""SELECT time_bucket({_HOURS}, ts) AS window_start, time_bucket({_HOURS}, ts) + {_HOURS} AS window_end, count(*) AS packets,
      CAST(sum(length) AS BIGINT) AS bytes, round(count(*) / 7200, 6) AS avg_pps, round(sum(length) / 7200, 6) AS avg_bps FROM packets GROUP BY 1, 2"""),
)
def rate_windows(spark, sf_dir):
    timed = live.event_time(packets(spark, sf_dir))
    out = live.rate_windows(timed, "2 hours")
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return _round(out.withColumns(plain), "avg_pps", "avg_bps")


@query(
    "k2_sliding_summary",
    with_packets("""WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(CAST(k AS INT)) AS window_start, * FROM packets, range(0, 6) t(k))
    SELECT window_start, count(*) AS packet_count, round(avg(length), 6) AS avg_packet_size, CAST(max(length) AS BIGINT) AS max_packet_size,
      round(count(*) FILTER (WHERE protocol = 'UDP') / count(*), 6) AS protocol_udp_ratio,
      round(CASE WHEN count(*) FILTER (WHERE protocol = 'TCP') > 0 THEN count(*) FILTER (WHERE protocol = 'TCP' AND syn) / count(*) FILTER (WHERE protocol = 'TCP') ELSE 0 END, 6) AS tcp_syn_ratio
    FROM w GROUP BY 1"""),
)
def sliding_summary(spark, sf_dir):
    out = live.sliding_summary(live.event_time(packets(spark, sf_dir)), "6 hours", "1 hour")
    out = out.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "packet_count", "avg_packet_size", "max_packet_size", "protocol_udp_ratio", "tcp_syn_ratio"
    )
    return _round(out, "avg_packet_size", "protocol_udp_ratio", "tcp_syn_ratio")


@query(
    "k3_flow_sessions",
    with_packets("""WITH k AS (SELECT protocol, src_ip, coalesce(src_port % 4, 0) AS src_port, dst_ip, coalesce(dst_port, 0) AS dst_port, ts, length FROM packets),
    g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 172800000000 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY protocol, src_ip, src_port, dst_ip, dst_port ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY protocol, src_ip, src_port, dst_ip, dst_port ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT protocol, src_ip, src_port, dst_ip, dst_port, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS byte_count, min(ts) AS start_time, max(ts) AS last_time,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS flow_duration FROM s GROUP BY protocol, src_ip, src_port, dst_ip, dst_port, session"""),
)
def flow_sessions(spark, sf_dir):
    out = live.flow_sessions(live.event_time(few_port_packets(spark, sf_dir)), "48 hours")
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("start_time", "last_time")}
    return _round(out.withColumns(plain).select(*flows.FLOW_KEY, "packet_count", "byte_count", "start_time", "last_time", "flow_duration"), "flow_duration")
