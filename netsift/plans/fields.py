"""Queries over the column functions: packets, addresses, indicators, alert texts, plates."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions import alerts as A
from netsift.functions import indicators as I
from netsift.functions import network as N
from netsift.functions import plates as P
from netsift.operators import report
from netsift.plans.catalogue import query
from netsift.plans.tables import flat_packets, packets, table, with_packets

FLAGS = ["syn", "ack", "fin", "rst", "psh", "urg"]
_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}


@query(
    "b1_tcp_flags",
    "SELECT event_id, "
    + ", ".join(f"((event_id % 64)::INTEGER & {_BITS[f]}) > 0 AS {f}" for f in FLAGS)
    + " FROM events",
)
def tcp_flags(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("0x"), F.hex(F.col("event_id") % 64)).alias("flags"))
    flags = raw.select("event_id", N.decode_tcp_flags("flags").alias("f"))
    return flags.select("event_id", "f.*")


@query("b2_decode_payload", "SELECT doc_id, text AS payload, strlen(text) AS payload_len FROM documents")
def decode_payload(spark, sf_dir):
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    out = raw.select("doc_id", N.decode_payload("raw").alias("p"))
    return out.select("doc_id", "p.payload", F.col("p.payload_len").cast("long").alias("payload_len"))


@query(
    "b3_packet_features",
    with_packets(
        "SELECT packet_id, ts, protocol, length, payload_len, ttl, src_port, dst_port, "
        + ", ".join(f"CASE WHEN protocol = 'TCP' THEN CAST(coalesce({f}, false) AS INT) END AS tcp_{f}" for f in FLAGS)
        + " FROM packets"
    ),
)
def packet_features(spark, sf_dir):
    return N.packet_features(packets(spark, sf_dir))


_V4 = "regexp_matches({c}, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$')"


def _number(c: str) -> str:
    parts = [f"CAST(split_part({c}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}" for i in range(1, 5)]
    return f"CASE WHEN {_V4.format(c=c)} THEN " + " + ".join(parts) + " ELSE 0 END"


@query(
    "b4_ip_to_long",
    with_packets(f"SELECT packet_id, {_number('src_ip')} AS src, {_number('dst_ip')} AS dst, {_number('payload')} AS bad FROM packets"),
)
def ip_to_long(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "packet_id", N.ip_number("src_ip").alias("src"), N.ip_number("dst_ip").alias("dst"), N.ip_number("payload").alias("bad")
    )


@query(
    "b5_private_ip",
    with_packets("""SELECT packet_id, src_ip LIKE '192.168.%' AS src_private, dst_ip LIKE '10.%' AS dst_private FROM packets"""),
)
def private_ip(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "packet_id", N.is_private_ip("src_ip").alias("src_private"), N.is_private_ip("dst_ip").alias("dst_private")
    )


_COMMON = "80, 443, 22, 21, 25, 53, 110, 143, 3306, 3389, 1433, 8080"


@query(
    "b6_port_flags",
    with_packets(f"""SELECT packet_id, CAST(coalesce(dst_port, 0) > 0 AND coalesce(dst_port, 0) < 1024 AS INT) AS well_known,
      CAST(coalesce(dst_port, 0) IN ({_COMMON}) AS INT) AS common FROM packets"""),
)
def port_flags(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_id", N.port_flags("dst_port").alias("f")).select("packet_id", "f.*")


@query(
    "b7_safe_ratio",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END, 6) AS ratio FROM lineitem""",
)
def safe_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(N.safe_ratio("l_tax", "l_discount"), 6).alias("ratio")
    )


_TOKENS = "SELECT doc_id AS id, unnest(string_split_regex(text, '\\s+')) AS token FROM documents"


@query(
    "b8_indicator_type",
    f"""WITH tokens AS (SELECT DISTINCT token FROM (
        SELECT unnest(string_split_regex(text, '\\s+')) AS token FROM documents
        UNION ALL SELECT url FROM pages UNION ALL SELECT md5(text) FROM documents UNION ALL SELECT sha256(text) FROM documents
        UNION ALL SELECT '8.8.4.' || CAST(event_id % 300 AS VARCHAR) FROM events))
    SELECT token, CASE WHEN {_V4.format(c='token')} THEN 'ip'
      WHEN regexp_matches(token, '^[a-zA-Z0-9][-a-zA-Z0-9.]*\\.[a-zA-Z]{{2,}}$') THEN 'domain'
      WHEN regexp_matches(token, '^(http|https|ftp)://') THEN 'url'
      WHEN regexp_matches(token, '^[a-fA-F0-9]{{32}}$') THEN 'md5'
      WHEN regexp_matches(token, '^[a-fA-F0-9]{{40}}$') THEN 'sha1'
      WHEN regexp_matches(token, '^[a-fA-F0-9]{{64}}$') THEN 'sha256' ELSE 'unknown' END AS kind
    FROM tokens""",
)
def indicator_type(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tokens = docs.select(F.explode(F.split("text", "\\s+")).alias("token"))
    tokens = tokens.union(table(spark, sf_dir, "pages").select("url"))
    tokens = tokens.union(docs.select(F.md5("text"))).union(docs.select(F.sha2("text", 256)))
    addresses = table(spark, sf_dir, "events").select(F.concat(F.lit("8.8.4."), (F.col("event_id") % 300).cast("string")))
    return tokens.union(addresses).distinct().select("token", I.indicator_type("token").alias("kind"))


_PUNCT = "'.,:;()[]{}\"''' "
FOUND_SQL = """SELECT DISTINCT {id}, CASE WHEN token LIKE 'http://%' OR token LIKE 'https://%' THEN 'url' ELSE 'domain' END AS indicator_type,
      value FROM (SELECT {id}, token, trim(token, '.,:;()[]{{}}"''') AS value FROM
        (SELECT {id}, unnest(string_split_regex({text}, '\\s+')) AS token FROM {source}))
    WHERE (token LIKE 'http://%' OR token LIKE 'https://%') AND value <> ''
       OR contains(token, '.') AND NOT starts_with(token, 'http') AND contains(value, '.')"""


@query("b9_text_indicators", FOUND_SQL.format(id="doc_id", text="text", source="documents"))
def text_indicators(spark, sf_dir):
    return I.extract_indicators(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(
    "b10_url_host",
    """SELECT page_id, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host FROM pages""",
)
def url_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", I.url_host("url").alias("host"))


SEVERITY_COLUMNS = (
    "CASE event_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'critical' ELSE 'other' END"
)


@query(
    "b11_severity_maps",
    f"""WITH s AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN lower({SEVERITY_COLUMNS}) END AS sev FROM events)
    SELECT event_id, CASE sev WHEN 'critical' THEN 2 WHEN 'high' THEN 3 WHEN 'medium' THEN 4 WHEN 'low' THEN 5 ELSE 4 END + 8 AS priority,
     CASE sev WHEN 'low' THEN '#36a64f' WHEN 'medium' THEN '#f2c744' WHEN 'high' THEN '#ff9000' WHEN 'critical' THEN '#ff0000'
       ELSE '#f2c744' END AS color,
     CASE WHEN sev IN ('high', 'critical') THEN 'high' ELSE 'low' END AS urgency,
     CASE sev WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 3 ELSE 2 END AS case_severity,
     CASE sev WHEN 'low' THEN 'low' WHEN 'medium' THEN 'medium' WHEN 'high' THEN 'high' WHEN 'critical' THEN 'high' ELSE 'medium' END AS soar,
     CASE event_id % 6 WHEN 0 THEN 'white' WHEN 1 THEN 'green' WHEN 2 THEN 'amber' WHEN 3 THEN 'red' ELSE 'amber' END AS sensitivity
    FROM s""",
)
def severity_maps(spark, sf_dir):
    s = table(spark, sf_dir, "events").selectExpr("event_id", f"CASE WHEN event_id % 7 > 0 THEN {SEVERITY_COLUMNS} END AS sev")
    return s.select(
        "event_id",
        A.syslog_priority("sev").alias("priority"),
        A.map_severity("sev", "chat_color").alias("color"),
        A.map_severity("sev", "pager_urgency").alias("urgency"),
        A.map_severity("sev", "case").alias("case_severity"),
        A.map_severity("sev", "soar").alias("soar"),
        A.map_sensitivity(F.col("event_id") % 6).alias("sensitivity"),
    )


_KINDS = ["ip", "domain", "hostname", "url", "md5", "sha1", "sha256", "email", "file", "registry"]
_KIND_SQL = "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


@query(
    "b12_observable_maps",
    f"""WITH k AS (SELECT event_id, {_KIND_SQL} AS kind FROM events)
    SELECT event_id, CASE WHEN kind = 'hostname' THEN 'domain' WHEN kind IN ('md5', 'sha1', 'sha256') THEN 'hash'
      WHEN kind = 'email' THEN 'mail' WHEN kind = 'registry' THEN 'other' ELSE kind END AS case_type,
      CASE WHEN kind IN ('ip', 'domain', 'hostname', 'url') THEN 'network' WHEN kind IN ('md5', 'sha1', 'sha256', 'file') THEN 'file'
      WHEN kind = 'email' THEN 'email' ELSE 'other' END AS soar_type FROM k""",
)
def observable_maps(spark, sf_dir):
    k = table(spark, sf_dir, "events").selectExpr("event_id", f"{_KIND_SQL} AS kind")
    return k.select("event_id", A.map_observable("kind", "case").alias("case_type"), A.map_observable("kind", "soar").alias("soar_type"))


def document_packets(spark, sf_dir):
    """Packets that carry the documents as payload."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("_text"))
    return packets(spark, sf_dir).join(docs, F.col("packet_id") == F.col("doc_id")).withColumn("payload", F.col("_text")).drop("_text")


@query(
    "b13_alert_envelope",
    with_packets("""SELECT packet_id, ts AS timestamp, 'anomaly' AS type, length AS score, src_ip, dst_ip, src_port, dst_port, protocol,
      CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS payload
    FROM packets JOIN documents ON doc_id = packet_id"""),
)
def alert_envelope(spark, sf_dir):
    source = document_packets(spark, sf_dir).withColumn("score", F.col("length"))
    out = A.alert_envelope(source, "anomaly", ["score"], keep=["packet_id"])
    return out.select(
        "packet_id", "timestamp", "type", "data.score", *[f"packet.{c}" for c in ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "payload"]]
    )


@query(
    "b14_syslog_line",
    with_packets(f"""SELECT packet_id, '<' || CAST(8 + CASE lower(sev) WHEN 'critical' THEN 2 WHEN 'high' THEN 3 WHEN 'medium' THEN 4
       WHEN 'low' THEN 5 ELSE 4 END AS VARCHAR) || '>' || strftime(ts, '%b %d %H:%M:%S') || ' sensor-1 ids: IDS-SIGNATURE-MATCH: ' || protocol
       || ' - R-' || CAST(ttl AS VARCHAR) || ' - ' || src_ip || ':' || coalesce(CAST(src_port AS VARCHAR), '') || ' -> ' || dst_ip || ':'
       || coalesce(CAST(dst_port AS VARCHAR), '') AS line
    FROM (SELECT *, {SEVERITY_COLUMNS.replace('event_id', 'packet_id')} AS sev FROM packets)"""),
)
def syslog_line(spark, sf_dir):
    source = packets(spark, sf_dir).selectExpr(
        "*", f"{SEVERITY_COLUMNS.replace('event_id', 'packet_id')} AS severity", "protocol AS name", "concat('R-', ttl) AS rule_id"
    )
    out = A.alert_envelope(source, "signature", ["severity", "name", "rule_id"], keep=["packet_id"])
    return A.syslog_line(out, 1, "sensor-1").select("packet_id", "line")


@query(
    "b15_format_alert",
    with_packets("""SELECT src_ip AS src, dst_port AS port, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
      strftime(to_timestamp(packet_id) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS event_time,
      '2024-02-01 00:00:00' AS siem_ingest_time FROM packets"""),
)
def format_alert(spark, sf_dir):
    mapping = {"src_ip": "src", "dst_port": "port", "ts": "timestamp", "packet_id": "event_time", "absent": "absent"}
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return A.format_alert(packets(spark, sf_dir), now, mapping, "yyyy-MM-dd HH:mm:ss")


@query(
    "b16_render_template",
    with_packets("""SELECT packet_id, 'IDS Alert: ' || protocol AS title,
      'Source IP: ' || src_ip || ', port ' || coalesce(CAST(dst_port AS VARCHAR), '') || ' {' AS description,
      'ids,' || protocol AS tags FROM packets"""),
)
def render_template(spark, sf_dir):
    values = {"alert_type": "protocol", "source_ip": "src_ip", "port": "dst_port"}
    return packets(spark, sf_dir).select(
        "packet_id",
        A.render_template("IDS Alert: {alert_type}", values).alias("title"),
        A.render_template("Source IP: {source_ip}, port {port} {", values).alias("description"),
        F.array_join(A.render_tags(["ids", "{alert_type}"], values), ",").alias("tags"),
    )


def alert_notifications(spark, sf_dir):
    p = packets(spark, sf_dir)
    return p.select(
        "packet_id",
        F.concat(F.lit("Alert from "), "src_ip").alias("title"),
        F.col("payload").alias("message"),
        F.expr(SEVERITY_COLUMNS.replace("event_id", "packet_id")).alias("severity"),
        F.array(F.lit("ids"), "protocol").alias("tags"),
        F.struct(
            "packet_id",
            "src_ip",
            "dst_port",
            "payload",
            F.array("src_port", "ttl").alias("pair"),
            F.sequence(F.lit(1), F.lit(6)).alias("long_list"),
            F.col("tcp_flags").alias("nested"),
        ).alias("data"),
    )


@query(
    "b17_notification_payload",
    with_packets(f"""WITH base AS (SELECT *, lower({SEVERITY_COLUMNS.replace('event_id', 'packet_id')}) AS sev FROM packets),
    f AS (SELECT *, '[' || coalesce(CAST(src_port AS VARCHAR) || ', ', '') || CAST(ttl AS VARCHAR) || ']' AS pair FROM base)
    SELECT packet_id, CASE sev WHEN 'low' THEN '#36a64f' WHEN 'high' THEN '#ff9000' WHEN 'critical' THEN '#ff0000' ELSE '#f2c744' END AS color,
      payload || chr(10) || '*Tags:* `ids`, `' || protocol || '`' AS chat_text,
      'packet_id=' || CAST(packet_id AS VARCHAR) || ':true;src_ip=' || src_ip || ':true;'
        || coalesce('dst_port=' || CAST(dst_port AS VARCHAR) || ':true;', '') || 'payload=' || payload || ':'
        || CASE WHEN length(payload) < 20 THEN 'true' ELSE 'false' END || ';pair=' || pair || ':true' AS fields,
      'ids-1706745600-' || replace(substr('Alert from ' || src_ip, 1, 20), ' ', '-') AS dedup_key,
      CASE WHEN sev IN ('high', 'critical') THEN 'high' ELSE 'low' END AS urgency,
      'Alert from ' || src_ip || chr(10) || chr(10) || payload || chr(10) || chr(10) || 'Tags: ids, ' || protocol || chr(10) || chr(10)
        || 'Additional Information:' || chr(10) || 'packet_id: ' || CAST(packet_id AS VARCHAR) || chr(10) || 'src_ip: ' || src_ip || chr(10)
        || coalesce('dst_port: ' || CAST(dst_port AS VARCHAR) || chr(10), '') || 'payload: ' || payload || chr(10)
        || 'pair: ' || pair || chr(10) AS mail_body
    FROM f"""),
)
def notification_payload(spark, sf_dir):
    base = alert_notifications(spark, sf_dir)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    out = A.notification_payload(base, "chat", now).withColumnRenamed("payload", "chat")
    out = A.notification_payload(out, "pager", now).withColumnRenamed("payload", "pager")
    out = A.notification_payload(out, "mail", now)
    parts = F.transform(
        "chat.fields", lambda f: F.concat(f["title"], F.lit("="), f["value"], F.lit(":"), f["short"].cast("string"))
    )
    return out.select(
        "packet_id",
        "chat.color",
        F.col("chat.text").alias("chat_text"),
        F.array_join(parts, ";").alias("fields"),
        "pager.dedup_key",
        "pager.urgency",
        F.col("payload.body").alias("mail_body"),
    )


def observed_alerts(spark, sf_dir):
    """Alerts with observables, from the packets."""
    p = packets(spark, sf_dir)

    def seen(kind: str, value, text: str, tag: str):
        return F.struct(F.lit(kind).alias("type"), value.alias("value"), F.lit(text).alias("description"), F.array(F.lit(tag)).alias("tags"))

    return p.select(
        F.concat(F.lit("A-"), F.col("packet_id").cast("string")).alias("id"),
        F.col("packet_id").alias("seq"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("Alert on "), "protocol").alias("title"),
        F.col("payload").alias("description"),
        F.lower(F.expr(SEVERITY_COLUMNS.replace("event_id", "packet_id"))).alias("severity"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        "protocol",
        F.array(
            seen("ip", F.col("src_ip"), "Source IP", "source"),
            seen("ip", F.col("dst_ip"), "Destination IP", "destination"),
            seen("md5", F.md5("payload"), "Payload hash", "payload"),
        ).alias("observables"),
    )


@query(
    "b18_case_payload",
    with_packets(f"""WITH base AS (SELECT *, lower({SEVERITY_COLUMNS.replace('event_id', 'packet_id')}) AS sev FROM packets)
    SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, 'Alert on ' || protocol AS title,
     CASE sev WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 3 ELSE 2 END AS severity,
     'ip:' || src_ip || ',ip:' || dst_ip || ',hash:' || md5(payload) AS artifacts,
     CASE sev WHEN 'low' THEN 'low' WHEN 'medium' THEN 'medium' WHEN 'high' THEN 'high' WHEN 'critical' THEN 'high' ELSE 'medium' END AS soar_severity,
     'amber' AS sensitivity, 'network,network,file' AS soar_types FROM base"""),
)
def case_payload(spark, sf_dir):
    out = A.case_payload(observed_alerts(spark, sf_dir), "case").withColumnRenamed("payload", "c")
    out = A.case_payload(out, "soar")
    return out.select(
        "id",
        "c.title",
        "c.severity",
        F.array_join(F.transform("c.artifacts", lambda a: F.concat(a["data_type"], F.lit(":"), a["data"])), ",").alias("artifacts"),
        F.col("payload.severity").alias("soar_severity"),
        "payload.sensitivity",
        F.array_join(F.transform("payload.artifacts", lambda a: a["type"]), ",").alias("soar_types"),
    )


@query(
    "b19_assign_batches",
    with_packets("""SELECT packet_id, protocol,
      CAST(floor((row_number() OVER (PARTITION BY protocol ORDER BY ts, packet_id) - 1) / 100) AS BIGINT) AS batch FROM packets"""),
)
def assign_batches(spark, sf_dir):
    p = packets(spark, sf_dir).select("packet_id", "protocol", "ts")
    return report.assign_batches(p, ["ts", "packet_id"], 100, ["protocol"]).select("packet_id", "protocol", "batch")


@query(
    "b20_byte_features",
    """WITH h AS (SELECT item_id, encode(text) AS raw, hex(encode(text)) AS h FROM benchmark)
    SELECT item_id, CAST(octet_length(raw) AS DOUBLE) AS size, CAST(i AS INT) AS position,
      round(CASE WHEN i < octet_length(raw) THEN CAST(('0x' || substr(h, CAST(i * 2 + 1 AS BIGINT), 2))::INTEGER AS DOUBLE) / 255 ELSE 0 END, 6) AS value
    FROM h, range(1, 16) t(i)""",
)
def byte_features(spark, sf_dir):
    raw = table(spark, sf_dir, "benchmark").select("item_id", N.byte_features(F.col("text").cast("binary")).alias("b"))
    out = raw.select("item_id", F.get("b", F.lit(0)).alias("size"), F.posexplode("b").alias("position", "value"))
    return out.where("position > 0").select("item_id", "size", "position", F.round("value", 6).alias("value"))


@query(
    "b21_clean_plate",
    """SELECT c_custkey, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS text,
      length(regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g')) BETWEEN 4 AND 10 AS valid
    FROM (SELECT c_custkey, substr(c_mktsegment, 1, CAST(c_custkey % 9 AS BIGINT)) || '-' || CAST(c_custkey % 1000 AS VARCHAR) || ' ' AS raw FROM customer)""",
)
def clean_plate(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select(
        "c_custkey", P.clean_plate(F.expr("concat(left(c_mktsegment, cast(c_custkey % 9 as int)), '-', c_custkey % 1000, ' ')")).alias("p")
    )
    return raw.select("c_custkey", "p.text", "p.valid")


def detector_rows(spark, sf_dir):
    """Detector-like output rows from order lines."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "(l_partkey % 101) / 100D AS cx",
        "(l_suppkey % 53) / 52D AS cy",
        "l_quantity / 60 AS bw",
        "l_quantity / 180 AS bh",
        "array(l_discount * 8, l_tax * 8, (l_partkey % 7) / 10D) AS scores",
        "640 AS image_width",
        "480 AS image_height",
    )


BOXES_SQL = """SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(trunc(cx * 640) AS INT) - w / 2.0) AS INT) AS x,
      CAST(trunc(CAST(trunc(cy * 480) AS INT) - h / 2.0) AS INT) AS y, w, h, confidence,
      CASE WHEN s0 = confidence THEN 0 WHEN s1 = confidence THEN 1 ELSE 2 END AS class_id
    FROM (SELECT *, CAST(trunc(l_quantity / 60 * 640) AS INT) AS w, CAST(trunc(l_quantity / 180 * 480) AS INT) AS h, greatest(s0, s1, s2) AS confidence
      FROM (SELECT *, CAST(l_partkey % 101 AS DOUBLE) / 100 AS cx, CAST(l_suppkey % 53 AS DOUBLE) / 52 AS cy, l_discount * 8 AS s0, l_tax * 8 AS s1,
         CAST(l_partkey % 7 AS DOUBLE) / 10 AS s2 FROM lineitem))
    WHERE confidence > 0.5"""


@query("b22_decode_boxes", f"SELECT l_orderkey, l_linenumber, x, y, w, h, round(confidence, 6) AS confidence, class_id FROM ({BOXES_SQL})")
def decode_boxes(spark, sf_dir):
    out = P.decode_boxes(detector_rows(spark, sf_dir), ["license_plate", "car", "person"], 0.5)
    return out.select("l_orderkey", "l_linenumber", "x", "y", "w", "h", F.round("confidence", 6).alias("confidence"), "class_id")


@query(
    "b23_clip_boxes",
    f"""SELECT l_orderkey, l_linenumber, greatest(0, x) AS x, greatest(0, y) AS y, least(w, 640 - greatest(0, x)) AS w,
      least(h, 480 - greatest(0, y)) AS h FROM ({BOXES_SQL})""",
)
def clip_boxes(spark, sf_dir):
    out = P.clip_boxes(P.decode_boxes(detector_rows(spark, sf_dir), ["license_plate", "car", "person"], 0.5))
    return out.select("l_orderkey", "l_linenumber", "x", "y", "w", "h")


@query(
    "a12_compact_ports",
    with_packets("""WITH d AS (SELECT DISTINCT src_ip, dst_port % 100 AS port FROM packets WHERE dst_port IS NOT NULL),
    r AS (SELECT src_ip, port, port - row_number() OVER (PARTITION BY src_ip ORDER BY port) AS run FROM d),
    s AS (SELECT src_ip, min(port) AS lo, max(port) AS hi FROM r GROUP BY src_ip, run)
    SELECT src_ip, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) END, ',' ORDER BY lo) AS ports
    FROM s GROUP BY src_ip"""),
)
def compact_ports(spark, sf_dir):
    p = flat_packets(spark, sf_dir).select("src_ip", (F.col("dst_port") % 100).alias("port"))
    return report.compact_ports(p, "src_ip", "port")
