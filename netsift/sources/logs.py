"""Alert and attack logs: JSON lines mixed with pipe-delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.schemas import ALERT_LOG, ATTACK_LOG
from netsift.sources.packets import JSON_TIMES


def parse_mixed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Three named fields from JSON objects or from ``a|b|c`` lines; other lines are left out.

    The order of ``schema`` is the order of the pipe-delimited parts.
    """
    bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    line = F.trim("value")
    parts = F.split(line, "[|]", -1)
    text = F.when(
        F.size(parts) >= 3,
        F.struct(*[F.trim(F.get(parts, F.lit(i))).alias(f) for i, f in enumerate(schema.fieldNames())]),
    )
    parsed = lines.select(*[c for c in lines.columns if c != "value"], F.from_json(line, bad, options).alias("j"), text.alias("t"))
    from_json = F.col("j").isNotNull() & F.col("j._bad").isNull()
    parsed = parsed.where(from_json | F.col("t").isNotNull())
    rest = [c for c in lines.columns if c != "value"]
    fields = [F.when(from_json, F.col(f"j.{f}")).otherwise(F.col(f"t.{f}")).alias(f) for f in schema.fieldNames()]
    return parsed.select(*rest, *fields)


def read_alert_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_mixed_lines(spark.read.text(path), ALERT_LOG)


def read_attack_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_mixed_lines(spark.read.text(path), ATTACK_LOG)


def log_time(ts: str) -> Column:
    """Time of a log entry: ISO 8601 (``Z`` allowed) or ``yyyy-MM-dd HH:mm:ss``; else NULL."""
    return F.try_to_timestamp(F.col(ts))


def write_alerts(df: DataFrame, path: str) -> None:
    """Append alerts as JSON lines."""
    df.write.mode("append").options(**JSON_TIMES).json(path)
