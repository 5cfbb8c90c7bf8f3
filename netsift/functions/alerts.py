"""Alert texts and payloads: severities, envelopes, templates, notifications, cases."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.network import _col

# Severity vocabularies. The last entry is the default.
SEVERITY_MAPS = {
    "rank": ({"low": 0, "medium": 1, "high": 2, "critical": 3}, 0),
    "syslog": ({"critical": 2, "high": 3, "medium": 4, "low": 5}, 4),
    "chat_color": ({"low": "#36a64f", "medium": "#f2c744", "high": "#ff9000", "critical": "#ff0000"}, "#f2c744"),
    "pager_urgency": ({"low": "low", "medium": "low", "high": "high", "critical": "high"}, "low"),
    "case": ({"low": 1, "medium": 2, "high": 3, "critical": 3}, 2),
    "soar": ({"low": "low", "medium": "medium", "high": "high", "critical": "high"}, "medium"),
}

# Traffic light protocol level to sensitivity.
TLP_SENSITIVITY = ({0: "white", 1: "green", 2: "amber", 3: "red"}, "amber")

# Observable vocabularies.
OBSERVABLE_MAPS = {
    "case": (
        {
            "ip": "ip",
            "domain": "domain",
            "hostname": "domain",
            "url": "url",
            "md5": "hash",
            "sha1": "hash",
            "sha256": "hash",
            "email": "mail",
            "file": "file",
        },
        "other",
    ),
    "soar": (
        {
            "ip": "network",
            "domain": "network",
            "url": "network",
            "hostname": "network",
            "md5": "file",
            "sha1": "file",
            "sha256": "file",
            "file": "file",
            "email": "email",
        },
        "other",
    ),
}

TIME_FIELDS = ["timestamp", "event_time", "detection_time"]
PACKET_FIELDS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length"]
PAYLOAD_PREVIEW = 200
SHORT_FIELD = 20
SHORT_LIST = 5


def _lookup(col: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def map_severity(severity: str | Column, scheme: str, default=None) -> Column:
    """Severity text in another vocabulary; unknown or NULL gives the default."""
    table, usual = SEVERITY_MAPS[scheme]
    return _lookup(F.lower(_col(severity)), table, usual if default is None else default)


def syslog_priority(severity: str | Column, facility: int = 1) -> Column:
    return F.lit(facility * 8) + map_severity(severity, "syslog")


def map_sensitivity(tlp: str | Column, default: str = TLP_SENSITIVITY[1]) -> Column:
    return _lookup(F.coalesce(_col(tlp).cast("int"), F.lit(2)), TLP_SENSITIVITY[0], default)


def map_observable(kind: str | Column, scheme: str) -> Column:
    """Observable type in the vocabulary of a case (``case``) or automation (``soar``) system."""
    table, default = OBSERVABLE_MAPS[scheme]
    kind = _col(kind) if scheme == "case" else F.lower(_col(kind))
    return _lookup(kind, table, default)


def payload_preview(payload: str | Column, limit: int = PAYLOAD_PREVIEW) -> Column:
    """The payload as shown in an alert: long texts are shortened and marked."""
    payload = _col(payload)
    return F.when(F.length(payload) > limit, F.concat(F.left(payload, F.lit(limit)), F.lit("..."))).otherwise(payload)


def alert_envelope(
    df: DataFrame, alert_type: str | Column, data: Sequence[str], timestamp: str = "ts", keep: Sequence[str] = ()
) -> DataFrame:
    """Alerts as timestamp, type, data and a subset of the packet."""
    kind = F.lit(alert_type) if isinstance(alert_type, str) else alert_type
    packet = [F.col(c) for c in PACKET_FIELDS]
    if "payload" in df.columns:
        packet.append(payload_preview("payload").alias("payload"))
    return df.select(
        *keep,
        F.col(timestamp).alias("timestamp"),
        kind.alias("type"),
        F.struct(*[F.col(c) for c in data]).alias("data"),
        F.struct(*packet).alias("packet"),
    )


def syslog_line(alerts: DataFrame, facility: int = 1, host: str = "localhost", name: str = "line") -> DataFrame:
    """Adds a syslog line to enveloped alerts (see :func:`alert_envelope`).

    Signature alerts need ``data.severity``, ``data.name`` and
    ``data.rule_id``; others ``data.score``.
    """
    fields = alerts.schema["data"].dataType.fieldNames()

    def data(field: str, default: str) -> Column:
        return F.coalesce(F.col(f"data.{field}").cast("string"), F.lit(default)) if field in fields else F.lit(default)

    signature = F.col("type") == "signature"
    severity = F.when(signature, map_severity(data("severity", ""), "syslog")).otherwise(F.lit(SEVERITY_MAPS["syslog"][1]))
    content = F.when(
        signature, F.concat(F.lit("IDS-SIGNATURE-MATCH: "), data("name", "Unknown"), F.lit(" - "), data("rule_id", "Unknown"))
    ).otherwise(F.concat(F.lit("IDS-ANOMALY-DETECTED: Score "), data("score", "")))

    def part(field: str) -> Column:
        return F.coalesce(F.col(f"packet.{field}").cast("string"), F.lit(""))

    ends = F.concat(
        F.lit(" - "), part("src_ip"), F.lit(":"), part("src_port"), F.lit(" -> "), part("dst_ip"), F.lit(":"), part("dst_port")
    )
    line = F.concat(
        F.lit("<"),
        (F.lit(facility * 8) + severity).cast("string"),
        F.lit(">"),
        F.date_format("timestamp", "MMM dd HH:mm:ss"),
        F.lit(f" {host} ids: "),
        content,
        F.when(F.col("packet").isNotNull(), ends).otherwise(F.lit("")),
    )
    return alerts.withColumn(name, line)


def format_alert(
    alerts: DataFrame,
    ingest_time: Column,
    mapping: dict[str, str] | None = None,
    ts_format: str = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    include_raw: bool = False,
) -> DataFrame:
    """Records for a log store: renamed fields, text times, optional raw JSON."""
    if mapping:
        chosen = [(src, dst) for src, dst in mapping.items() if src in alerts.columns]
    else:
        chosen = [(c, c) for c in alerts.columns]
    out = []
    for src, dst in chosen:
        kind, col = alerts.schema[src].dataType, F.col(src)
        if dst in TIME_FIELDS and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            col = F.date_format(col, ts_format)
        elif dst in TIME_FIELDS and isinstance(kind, T.NumericType):
            col = F.date_format(F.timestamp_micros((col * F.lit(1_000_000)).cast("long")), ts_format)
        out.append(col.alias(dst))
    if include_raw:
        out.append(F.to_json(F.struct("*")).alias("raw_alert"))
    out.append(F.date_format(ingest_time, ts_format).alias("siem_ingest_time"))
    return alerts.select(*out)


def render_template(template: str, values: dict[str, str | Column]) -> Column:
    """Text with ``{name}`` placeholders filled from columns; values are not expanded again."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if re.fullmatch(r"\{\w+\}", piece):
            parts.append(F.coalesce(_col(values[piece[1:-1]]).cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def render_tags(templates: Sequence[str], values: dict[str, str | Column]) -> Column:
    return F.array(*[render_template(t, values) for t in templates])


def _field_text(col: Column, kind: T.DataType) -> Column | None:
    """Text of a scalar or of a list below five items; None for other types, NULL to skip."""
    if isinstance(kind, T.BooleanType):
        return F.initcap(col.cast("string"))
    if isinstance(kind, (T.StringType, T.NumericType)):
        return col.cast("string")
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StringType, T.NumericType)):
        quote = "'" if isinstance(kind.elementType, T.StringType) else ""
        items = F.transform(col, lambda x: F.concat(F.lit(quote), x.cast("string"), F.lit(quote)))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
        return F.when(F.size(col) < SHORT_LIST, text)
    return None


def notification_fields(df: DataFrame, data: str = "data") -> Column:
    """Array of struct(title, value, short) from a struct of extra values."""
    entries = []
    for field in df.schema[data].dataType.fields:
        text = _field_text(F.col(f"{data}.{field.name}"), field.dataType)
        if text is not None:
            entries.append(
                F.struct(F.lit(field.name).alias("title"), text.alias("value"), (F.length(text) < SHORT_FIELD).alias("short"))
            )
    if not entries:
        return F.array().cast("array<struct<title:string,value:string,short:boolean>>")
    return F.filter(F.array(*entries), lambda e: e["value"].isNotNull())


def notification_payload(df: DataFrame, channel: str, now: Column, data: str = "data") -> DataFrame:
    """Adds ``payload`` for a channel (``chat``, ``mail`` or ``pager``).

    Needs ``title``, ``message``, ``severity``, ``tags`` and a struct ``data``.
    """
    fields = notification_fields(df, data)
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    if channel == "chat":
        marked = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", ")
        text = F.concat("message", F.when(F.size(tags) > 0, F.concat(F.lit("\n*Tags:* "), marked)).otherwise(F.lit("")))
        payload = F.struct(
            map_severity("severity", "chat_color").alias("color"),
            F.col("title"),
            text.alias("text"),
            F.unix_timestamp(now.cast("timestamp")).alias("ts"),
            fields.alias("fields"),
        )
    elif channel == "mail":
        lines = F.array_join(F.transform(fields, lambda f: F.concat(f["title"], F.lit(": "), f["value"], F.lit("\n"))), "")
        tag_text = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))).otherwise(F.lit(""))
        extra = F.when(F.size(fields) > 0, F.concat(F.lit("Additional Information:\n"), lines)).otherwise(F.lit(""))
        payload = F.struct(
            F.col("title").alias("subject"),
            F.concat("title", F.lit("\n\n"), "message", F.lit("\n\n"), tag_text, F.lit("\n\n"), extra).alias("body"),
        )
    elif channel == "pager":
        key = F.concat(
            F.lit("ids-"),
            F.unix_timestamp(now.cast("timestamp")).cast("string"),
            F.lit("-"),
            F.replace(F.left("title", F.lit(20)), F.lit(" "), F.lit("-")),
        )
        details = F.map_concat(
            F.create_map(F.lit("message"), F.col("message")),
            F.map_from_entries(
                F.transform(
                    F.filter(fields, lambda f: f["title"] != "message"), lambda f: F.struct(f["title"], f["value"])
                )
            ),
        )
        payload = F.struct(
            F.lit("trigger").alias("event_action"),
            key.alias("dedup_key"),
            map_severity("severity", "pager_urgency").alias("urgency"),
            F.struct(
                F.col("title").alias("summary"),
                F.lower("severity").alias("severity"),
                tags.alias("tags"),
                details.alias("custom_details"),
            ).alias("payload"),
        )
    else:
        raise ValueError(f"unknown channel: {channel}")
    return df.withColumn("payload", payload)


def case_payload(df: DataFrame, scheme: str, default_severity: str = "medium") -> DataFrame:
    """Adds ``payload`` for a case system (``case``) or an automation system (``soar``).

    Needs ``id``, ``title``, ``description``, ``severity``, ``observables``;
    uses ``alert_type``, ``source``, ``tlp``, ``tags`` where present.
    """

    def optional(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    observables = F.coalesce("observables", F.array().cast(df.schema["observables"].dataType))
    no_tags = F.array().cast("array<string>")
    title = F.coalesce("title", F.lit("IDS Alert"))
    tlp = optional("tlp", F.lit(2))
    if scheme == "case":
        artifacts = F.transform(
            observables,
            lambda o: F.struct(
                map_observable(o["type"], "case").alias("data_type"),
                F.coalesce(o["value"], F.lit("")).alias("data"),
                F.coalesce(o["description"], F.lit("")).alias("message"),
                F.coalesce(o["tags"], no_tags).alias("tags"),
            ),
        )
        payload = F.struct(
            title.alias("title"),
            F.coalesce("description", F.lit("")).alias("description"),
            optional("alert_type", F.lit("ids")).alias("type"),
            optional("source", F.lit("IDS")).alias("source"),
            F.col("id").alias("source_ref"),
            map_severity("severity", "case").alias("severity"),
            tlp.alias("tlp"),
            optional("tags", no_tags).alias("tags"),
            artifacts.alias("artifacts"),
        )
    elif scheme == "soar":
        severity = map_severity("severity", "soar", default_severity)
        artifacts = F.transform(
            observables,
            lambda o: F.struct(
                F.coalesce(o["description"], F.lit("Observable")).alias("name"),
                F.coalesce(o["type"], F.lit("other")).alias("label"),
                severity.alias("severity"),
                map_observable(o["type"], "soar").alias("type"),
                F.concat(F.col("id"), F.lit("-"), F.coalesce(o["value"], F.lit(""))).alias("source_data_identifier"),
                F.coalesce(o["value"], F.lit("")).alias("value"),
                F.coalesce(o["tags"], no_tags).alias("tags"),
            ),
        )
        payload = F.struct(
            title.alias("name"),
            F.coalesce("description", F.lit("")).alias("description"),
            optional("alert_type", F.lit("ids_alert")).alias("label"),
            F.col("id").alias("source_data_identifier"),
            severity.alias("severity"),
            map_sensitivity(tlp).alias("sensitivity"),
            optional("tags", no_tags).alias("tags"),
            artifacts.alias("artifacts"),
        )
    else:
        raise ValueError(f"unknown scheme: {scheme}")
    return df.withColumn("payload", payload)
