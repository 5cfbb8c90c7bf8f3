"""Fixed schemas of the records that the library reads and writes."""

from pyspark.sql import types as T

FLAG_NAMES = ["syn", "ack", "fin", "rst", "psh", "urg"]

TCP_FLAGS = T.StructType([T.StructField(f, T.BooleanType()) for f in FLAG_NAMES])

PACKET = T.StructType(
    [
        T.StructField("packet_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("ip_version", T.IntegerType()),
        T.StructField("ttl", T.IntegerType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("tcp_flags", TCP_FLAGS),
        T.StructField("payload", T.StringType()),
        T.StructField("payload_len", T.IntegerType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        T.StructField("length", T.IntegerType()),
    ]
)

OBSERVABLE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("source_port", T.IntegerType()),
        T.StructField("destination_ports", T.ArrayType(T.IntegerType())),
        T.StructField("alert_type", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("packet_count", T.LongType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("observables", T.ArrayType(OBSERVABLE)),
    ]
)

INDICATOR = T.StructType(
    [
        T.StructField("feed", T.StringType()),
        T.StructField("indicator_type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("last_updated", T.TimestampType()),
    ]
)

PULSE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("modified", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("references", T.ArrayType(T.StringType())),
        T.StructField(
            "indicators",
            T.ArrayType(
                T.StructType(
                    [T.StructField("type", T.StringType()), T.StructField("indicator", T.StringType())]
                )
            ),
        ),
    ]
)

ALERT_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("signature_id", T.StringType()),
        T.StructField("message", T.StringType()),
    ]
)

ATTACK_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("details", T.StringType()),
    ]
)
