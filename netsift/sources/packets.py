"""Packet logs: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.schemas import PACKET

# times are written with microseconds
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# on disk the event time is called "timestamp"
_LINE = T.StructType(
    [T.StructField("timestamp" if f.name == "ts" else f.name, f.dataType) for f in PACKET.fields]
    + [T.StructField("_bad", T.StringType())]
)


def parse_packet_lines(lines: DataFrame) -> DataFrame:
    """Packets from a ``value`` column of JSON lines; malformed lines are left out."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = lines.select(F.from_json("value", _LINE, options).alias("p"))
    good = parsed.where(F.col("p").isNotNull() & F.col("p._bad").isNull())
    return good.select(*[F.col("p.timestamp" if f == "ts" else f"p.{f}").alias(f) for f in PACKET.fieldNames()])


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return parse_packet_lines(spark.read.text(path))


def stream_packet_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return parse_packet_lines(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def write_packets(df: DataFrame, path: str, mode: str = "append") -> None:
    df.withColumnRenamed("ts", "timestamp").write.mode(mode).options(**JSON_TIMES).json(path)
