"""Feed, indicator and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.functions.indicators import url_host
from netsift.operators import enrich as E
from netsift.operators import intel as T
from netsift.plans.catalogue import query
from netsift.plans.fields import FOUND_SQL, SEVERITY_COLUMNS, observed_alerts
from netsift.plans.tables import PACKETS_SQL, packets, table, with_packets
from netsift.schemas import ALERT_LOG, PACKET
from netsift.sources import feeds as S
from netsift.sources.logs import log_time, parse_mixed_lines
from netsift.sources.packets import JSON_TIMES, parse_packet_lines

_HOST = "split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)"

# indicators of four feeds, all taken from the tables
INDICATORS_SQL = f"""SELECT DISTINCT 'hosts' AS feed, 'domain' AS indicator_type, {_HOST} AS value FROM pages
  UNION SELECT 'urls', 'url', url FROM pages
  UNION SELECT 'scan', 'ip', src_ip FROM packets WHERE packet_id % 50 = 0
  UNION SELECT 'sinkhole', 'ip', dst_ip FROM packets WHERE packet_id % 97 = 0
  UNION SELECT 'sinkhole', 'domain', split_part(payload, 'Host: ', 2) FROM packets WHERE packet_id % 20 = 3
  UNION SELECT 'urls', 'url', split_part(payload, 'wget ', 2) FROM packets WHERE packet_id % 20 = 2
  UNION SELECT 'hosts', 'domain', {_HOST} FROM pages WHERE page_id % 2 = 0
  UNION SELECT 'sinkhole', 'domain', {_HOST} FROM pages WHERE page_id % 3 = 0
  UNION SELECT 'hashes', 'hash', md5(payload) FROM packets WHERE packet_id % 11 = 0"""


def indicators(spark, sf_dir):
    p = packets(spark, sf_dir)
    hosts = table(spark, sf_dir, "pages").select("page_id", "url", url_host("url").alias("host"))

    def feed(df, name, kind, value):
        return df.select(F.lit(name).alias("feed"), F.lit(kind).alias("indicator_type"), value.alias("value"))

    parts = [
        feed(hosts, "hosts", "domain", F.col("host")),
        feed(hosts, "urls", "url", F.col("url")),
        feed(p.where("packet_id % 50 = 0"), "scan", "ip", F.col("src_ip")),
        feed(p.where("packet_id % 97 = 0"), "sinkhole", "ip", F.col("dst_ip")),
        feed(p.where("packet_id % 20 = 3"), "sinkhole", "domain", F.element_at(F.split("payload", "Host: "), 2)),
        feed(p.where("packet_id % 20 = 2"), "urls", "url", F.element_at(F.split("payload", "wget "), 2)),
        feed(hosts.where("page_id % 3 = 0"), "sinkhole", "domain", F.col("host")),
        feed(p.where("packet_id % 11 = 0"), "hashes", "hash", F.md5("payload")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def on_indicators(sql: str) -> str:
    body = sql.strip()
    head = f"WITH packets AS ({PACKETS_SQL}), indicators AS ({INDICATORS_SQL})"
    return f"{head}, {body[4:]}" if body.upper().startswith("WITH") else f"{head} {body}"


# -- logs ---------------------------------------------------------------------


@query(
    "a2_packet_lines",
    with_packets("""SELECT packet_id, ts, protocol, src_ip, dst_ip, src_port, dst_port, length, syn, urg, payload FROM packets WHERE packet_id % 10 > 0"""),
)
def packet_lines(spark, sf_dir):
    """Packets written as JSON lines, every tenth line broken, and read back."""
    p = packets(spark, sf_dir).select(*[c for c in PACKET.fieldNames() if c not in ("ip_version", "icmp_type", "icmp_code")])
    line = F.to_json(F.struct(F.col("ts").alias("timestamp"), *[c for c in p.columns if c != "ts"]), JSON_TIMES)
    lines = p.select(F.when(F.col("packet_id") % 10 == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("value"))
    out = parse_packet_lines(lines).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return out.select("packet_id", "ts", "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "length", "tcp_flags.syn", "tcp_flags.urg", "payload")


@query(
    "a4_alert_log",
    """SELECT date_trunc('second', ts) AS ts, 'S-' || event_type AS signature_id, 'user ' || CAST(user_id AS VARCHAR) AS message FROM events WHERE event_id % 4 < 2
      UNION ALL SELECT NULL, 'S-' || event_type, 'user ' || CAST(user_id AS VARCHAR) FROM events WHERE event_id % 4 = 2""",
)
def alert_log(spark, sf_dir):
    """JSON lines, pipe-delimited lines, lines with a bad time, and lines to drop."""
    fields = {"signature_id": F.concat(F.lit("S-"), "event_type"), "message": F.concat(F.lit("user "), F.col("user_id").cast("string"))}
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    text = F.concat_ws(" | ", stamp, *fields.values(), F.lit("more"))
    line = (
        F.when(F.col("event_id") % 4 == 0, F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), *[c.alias(n) for n, c in fields.items()])))
        .when(F.col("event_id") % 4 == 1, text)
        .when(F.col("event_id") % 4 == 2, F.concat_ws("|", F.lit("yesterday"), *fields.values()))
        .otherwise(F.concat_ws("|", stamp, "event_type"))
    )
    out = parse_mixed_lines(table(spark, sf_dir, "events").select(line.alias("value")), ALERT_LOG)
    return out.select(log_time("timestamp").cast("timestamp_ntz").alias("ts"), "signature_id", "message")


# -- feeds --------------------------------------------------------------------


@query(
    "a6_text_feed",
    f"""WITH lines AS (SELECT trim(line) AS t FROM (SELECT CASE page_id % 4 WHEN 0 THEN '# ' || url WHEN 1 THEN '  ' || {_HOST} || ' '
        WHEN 2 THEN '10.20.' || CAST(page_id % 300 AS VARCHAR) || '.7' ELSE 'localhost' END AS line FROM pages
        UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents))
    SELECT DISTINCT 'list' AS feed, CASE WHEN regexp_matches(t, '^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){{3}}$')
      THEN 'ip' ELSE 'domain' END AS indicator_type, t AS value FROM lines WHERE t <> '' AND t NOT LIKE '#%' AND contains(t, '.')""",
)
def text_feed(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    line = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("# "), "url"))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("  "), url_host("url"), F.lit(" ")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("10.20."), (F.col("page_id") % 300).cast("string"), F.lit(".7")))
        .otherwise("localhost")
    )
    docs = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return S.parse_text_feed(pages.select(line.alias("value")).union(docs), "list")


@query(
    "a7_rules_feed",
    with_packets("""SELECT DISTINCT 'rules' AS feed, 'ip' AS indicator_type, src_ip AS value FROM packets WHERE packet_id % 3 = 0
      UNION SELECT 'rules', 'ip', dst_ip FROM packets WHERE packet_id % 3 = 0 AND try_cast(split_part(dst_ip, '.', 4) AS INT) < 256"""),
)
def rules_feed(spark, sf_dir):
    line = (
        F.when(F.col("packet_id") % 3 == 0, F.concat(F.lit("alert ip ["), "src_ip", F.lit(","), "dst_ip", F.lit(",10.0.0.0/8] any -> $HOME_NET any")))
        .when(F.col("packet_id") % 3 == 1, F.concat(F.lit("# drop ip ["), "dst_ip", F.lit("]")))
        .otherwise(F.concat(F.lit("alert tcp [1.2.3.4] "), "src_ip"))
    )
    return S.parse_rules_feed(packets(spark, sf_dir).select(line.alias("value")), "rules")


def pulses(spark, sf_dir):
    """Orders as pulses with two indicators each."""
    kind = (
        F.when(F.col("o_orderkey") % 4 == 0, "IPv4")
        .when(F.col("o_orderkey") % 4 == 1, "hostname")
        .when(F.col("o_orderkey") % 4 == 2, "FileHash-MD5")
        .otherwise("CVE")
    )
    first = F.struct(kind.alias("type"), F.concat(F.lit("i-"), (F.col("o_custkey") % 500).cast("string")).alias("indicator"))
    second = F.struct(
        F.when(F.col("o_orderkey") % 5 > 0, "URL").alias("type"),
        F.concat(F.lit("http://h/"), (F.col("o_custkey") % 300).cast("string")).alias("indicator"),
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("pulse "), (F.col("o_custkey") % 50).cast("string")).alias("name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"),
        F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd").alias("modified"),
        F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.array(F.concat(F.lit("ref-"), (F.col("o_orderkey") % 9).cast("string"))).alias("references"),
        F.array(first, second).alias("indicators"),
    )


PULSES_SQL = """SELECT 'pulse ' || CAST(o_custkey % 50 AS VARCHAR) AS name, strftime(o_orderdate, '%Y-%m-%d') AS created,
   strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS modified, o_orderstatus AS tag1, o_orderpriority AS tag2,
   'ref-' || CAST(o_orderkey % 9 AS VARCHAR) AS ref, t.type, t.indicator
 FROM orders, LATERAL (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'IPv4' WHEN 1 THEN 'hostname' WHEN 2 THEN 'FileHash-MD5' ELSE 'CVE' END AS type,
     'i-' || CAST(o_custkey % 500 AS VARCHAR) AS indicator
   UNION ALL SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'URL' END, 'http://h/' || CAST(o_custkey % 300 AS VARCHAR)) t"""


@query(
    "a8_pulses",
    f"""SELECT DISTINCT 'otx' AS feed, CASE type WHEN 'IPv4' THEN 'ip' WHEN 'hostname' THEN 'domain' WHEN 'FileHash-MD5' THEN 'hash'
      WHEN 'URL' THEN 'url' ELSE 'other' END AS indicator_type, indicator AS value FROM ({PULSES_SQL}) WHERE type IS NOT NULL""",
)
def parse_pulses(spark, sf_dir):
    return S.parse_pulses(pulses(spark, sf_dir), "otx")


@query(
    "a9_blacklist",
    with_packets("""SELECT 'blacklist' AS feed, 'ip' AS indicator_type, ip AS value, confidence FROM
      (SELECT src_ip AS ip, CAST(least(100, count(*)) AS INT) AS confidence FROM packets GROUP BY 1) WHERE confidence >= 60
      ORDER BY confidence DESC, ip LIMIT 100"""),
)
def blacklist(spark, sf_dir):
    entries = packets(spark, sf_dir).groupBy(F.col("src_ip").alias("ip")).agg(F.least(F.lit(100), F.count(F.lit(1))).cast("int").alias("confidence"))
    return S.parse_blacklist(entries, "blacklist", 60, 100)


@query(
    "a10_stale_feeds",
    """SELECT event_type AS feed, max(ts) FILTER (WHERE event_type <> 'view') AS last_updated,
      coalesce(epoch(TIMESTAMP '2024-01-31 12:00:00' - max(ts) FILTER (WHERE event_type <> 'view')) > 43200, true) AS stale FROM events GROUP BY 1""",
)
def stale_feeds(spark, sf_dir):
    snapshots = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("feed"), F.when(F.col("event_type") != "view", F.col("ts")).alias("last_updated")
    )
    return S.stale_feeds(snapshots, F.lit("2024-01-31 12:00:00").cast("timestamp"), 12)


# -- matching -----------------------------------------------------------------


@query(
    "d1_match_ip",
    on_indicators("""SELECT packet_id, 'src_ip' AS field, src_ip AS value FROM packets WHERE src_ip IN (SELECT value FROM indicators WHERE indicator_type = 'ip')
      UNION ALL SELECT packet_id, 'dst_ip', dst_ip FROM packets WHERE dst_ip IN (SELECT value FROM indicators WHERE indicator_type = 'ip')"""),
)
def match_ip(spark, sf_dir):
    return T.match_ip_indicators(packets(spark, sf_dir), indicators(spark, sf_dir))


@query(
    "d2_match_text",
    on_indicators(f"""WITH found AS ({FOUND_SQL.format(id="packet_id", text="payload", source="packets")})
      SELECT DISTINCT packet_id, indicator_type, value FROM found SEMI JOIN indicators USING (indicator_type, value)"""),
)
def match_text(spark, sf_dir):
    return T.match_text_indicators(packets(spark, sf_dir), "payload", indicators(spark, sf_dir))


@query(
    "d2_match_hash",
    on_indicators("SELECT packet_id FROM packets WHERE md5(payload) IN (SELECT value FROM indicators WHERE indicator_type = 'hash')"),
)
def match_hash(spark, sf_dir):
    p = packets(spark, sf_dir).select("packet_id", F.md5("payload").alias("payload_md5"))
    return T.match_hash(p, "payload_md5", indicators(spark, sf_dir)).select("packet_id")


FEEDS = ["hosts", "urls", "scan", "sinkhole", "hashes"]


@query(
    "d3_feed_verdicts",
    on_indicators("""WITH wanted AS (SELECT DISTINCT 'ip' AS indicator_type, src_ip AS value FROM packets UNION
        SELECT DISTINCT 'domain', """ + _HOST + """ FROM pages)
      SELECT indicator_type, value, """
    + ", ".join(f"EXISTS (SELECT 1 FROM indicators i WHERE i.feed = '{f}' AND i.indicator_type = w.indicator_type AND i.value = w.value) AS in_{f}" for f in FEEDS)
    + " FROM wanted w"),
)
def feed_verdicts(spark, sf_dir):
    ips = packets(spark, sf_dir).select(F.lit("ip").alias("indicator_type"), F.col("src_ip").alias("value"))
    hosts = table(spark, sf_dir, "pages").select(F.lit("domain").alias("indicator_type"), url_host("url").alias("value"))
    return T.feed_verdicts(ips.union(hosts).distinct(), indicators(spark, sf_dir), FEEDS)


@query(
    "d4_check_packets",
    on_indicators(f"""WITH found AS ({FOUND_SQL.format(id="packet_id", text="payload", source="packets")}
        UNION SELECT packet_id, 'ip', src_ip FROM packets UNION SELECT packet_id, 'ip', dst_ip FROM packets),
      listed AS (SELECT DISTINCT indicator_type, value FROM indicators),
      hits AS (SELECT packet_id, count(*) FILTER (WHERE indicator_type = 'ip') AS i, count(*) FILTER (WHERE indicator_type = 'domain') AS d,
        count(*) FILTER (WHERE indicator_type = 'url') AS u FROM found JOIN listed USING (indicator_type, value) GROUP BY 1)
      SELECT packet_id, coalesce(i, 0) AS ip_matches, coalesce(d, 0) AS domain_matches, coalesce(u, 0) AS url_matches,
        coalesce(i + d + u, 0) > 0 AS matched FROM packets LEFT JOIN hits USING (packet_id)"""),
)
def check_packets(spark, sf_dir):
    return T.check_packets(packets(spark, sf_dir), indicators(spark, sf_dir))


NETWORKS_SQL = """SELECT DISTINCT '192.168.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) || '/' || CAST(20 + user_id % 12 AS VARCHAR) AS network
  FROM events WHERE user_id % 9 = 0 UNION SELECT '8.8.' || CAST(user_id % 8 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) FROM events WHERE user_id % 6 = 2
  UNION SELECT '10.0.0.0/' || CAST(8 + event_id % 30 AS VARCHAR) FROM events"""


@query(
    "d5_match_cidr",
    with_packets(f"""WITH parts AS (SELECT network, split_part(network, '/', 1) AS a, CASE WHEN contains(network, '/') THEN CAST(split_part(network, '/', 2) AS INT) ELSE 32 END AS p
        FROM ({NETWORKS_SQL})),
      nets AS (SELECT network, p, (CAST(split_part(a, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(a, '.', 2) AS BIGINT) * 65536
        + CAST(split_part(a, '.', 3) AS BIGINT) * 256 + CAST(split_part(a, '.', 4) AS BIGINT)) // CAST(2 ** (32 - p) AS BIGINT) AS head FROM parts WHERE p <= 32),
      ends AS (SELECT packet_id, 'src_ip' AS field, src_ip AS ip FROM packets UNION ALL SELECT packet_id, 'dst_ip', dst_ip FROM packets),
      nums AS (SELECT packet_id, field, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
        + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM ends)
      SELECT packet_id, field, network FROM nums JOIN nets ON n // CAST(2 ** (32 - p) AS BIGINT) = head"""),
)
def match_cidr(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("user_id % 9 = 0").selectExpr("concat('192.168.', user_id % 4, '.', user_id % 250, '/', 20 + user_id % 12) AS network")
    b = e.where("user_id % 6 = 2").selectExpr("concat('8.8.', user_id % 8, '.', user_id % 256) AS network")
    c = e.selectExpr("concat('10.0.0.0/', 8 + event_id % 30) AS network")
    return T.match_cidr(packets(spark, sf_dir), a.union(b).union(c).distinct(), direction="both")


# -- enrichment ---------------------------------------------------------------


def geo_ranges(spark, sf_dir):
    """A range of addresses per customer nation and supplier."""
    nations = table(spark, sf_dir, "nation")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return suppliers.selectExpr(
        "CAST(CASE WHEN s_suppkey % 2 = 0 THEN 3115852544 ELSE 134742016 END + (s_suppkey - 1) * 64 AS BIGINT) AS lo",
        "CAST(CASE WHEN s_suppkey % 2 = 0 THEN 3115852544 ELSE 134742016 END + (s_suppkey - 1) * 64 + 63 AS BIGINT) AS hi",
        "concat('N', n_nationkey) AS country_code",
        "n_name AS country_name",
        "s_name AS city",
        "s_suppkey AS asn",
    )


GEO_SQL = """SELECT CAST(CASE WHEN s_suppkey % 2 = 0 THEN 3115852544 ELSE 134742016 END + (s_suppkey - 1) * 64 AS BIGINT) AS lo,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN 3115852544 ELSE 134742016 END + (s_suppkey - 1) * 64 + 63 AS BIGINT) AS hi,
  'N' || CAST(n_nationkey AS VARCHAR) AS country_code, n_name AS country_name, s_name AS city FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

_NUM = """CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536
        + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT)"""

_LOCATED = f"""ips AS (SELECT DISTINCT id, ip FROM (SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, src_ip AS ip FROM packets
          UNION ALL SELECT 'A-' || CAST(packet_id AS VARCHAR), dst_ip FROM packets)),
      geo AS ({GEO_SQL}),
      located AS (SELECT id, ip, true AS is_private, '**' AS country_code, 'Private IP' AS country_name, CAST(NULL AS VARCHAR) AS city FROM ips
        WHERE ip LIKE '10.%' OR ip LIKE '192.168.%'
      UNION ALL SELECT id, ip, false, country_code, country_name, city FROM ips JOIN geo ON {_NUM.format(c='ip')} BETWEEN lo AND hi
        WHERE NOT (ip LIKE '10.%' OR ip LIKE '192.168.%'))"""


@query("d6_geoip", with_packets(f"WITH {_LOCATED} SELECT * FROM located"))
def geoip(spark, sf_dir):
    out = E.enrich_geoip(observed_alerts(spark, sf_dir), geo_ranges(spark, sf_dir))
    return out.select("id", F.explode("geoip").alias("ip", "g")).select("id", "ip", "g.is_private", "g.country_code", "g.country_name", "g.city")


_V6 = "concat('2a00:', lower(hex(c_nationkey)), ':', CASE WHEN c_custkey % 3 = 0 THEN '8000' ELSE '1' END, '::', lower(hex(c_custkey % 65536)))"


def mixed_addresses(spark, sf_dir):
    """An IPv6 address per customer, and an IPv4 address per supplier, some private, some without a range."""
    six = table(spark, sf_dir, "customer").selectExpr(f"{_V6} AS ip").unionByName(table(spark, sf_dir, "supplier").selectExpr("concat('fd00::', lower(hex(s_suppkey % 65536))) AS ip"))
    four = table(spark, sf_dir, "supplier").selectExpr("concat('185.', CAST(s_suppkey % 256 AS STRING), '.35.7') AS ip")
    return six.unionByName(four)


def mixed_ranges(spark, sf_dir):
    """A range of either family per nation but every fifth: the lower half of its IPv6 network, and one IPv4 network."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0")
    names = ["concat('N', n_nationkey) AS country_code", "n_name AS country_name"]
    six = nations.selectExpr("concat('2a00:', lower(hex(n_nationkey)), '::') AS lo", "concat('2a00:', lower(hex(n_nationkey)), ':7fff:ffff:ffff:ffff:ffff:ffff') AS hi", *names)
    return six.unionByName(nations.selectExpr("concat('185.', CAST(n_nationkey AS STRING), '.0.0') AS lo", "concat('185.', CAST(n_nationkey AS STRING), '.255.255') AS hi", *names))


@query(
    "d6_locate_mixed",
    """WITH six AS (SELECT DISTINCT '2a00:' || lower(to_hex(c_nationkey)) || ':' || CASE WHEN c_custkey % 3 = 0 THEN '8000' ELSE '1' END || '::'
        || lower(to_hex(c_custkey % 65536)) AS ip, c_nationkey AS n, c_custkey % 3 <> 0 AS low FROM customer),
      four AS (SELECT DISTINCT '185.' || CAST(s_suppkey % 256 AS VARCHAR) || '.35.7' AS ip, s_suppkey % 256 AS n FROM supplier)
    SELECT ip, false AS is_private, 'N' || CAST(n_nationkey AS VARCHAR) AS country_code, n_name AS country_name FROM six JOIN nation ON n = n_nationkey AND low AND n % 5 <> 0
    UNION ALL SELECT ip, false, 'N' || CAST(n_nationkey AS VARCHAR), n_name FROM four JOIN nation ON n = n_nationkey AND n % 5 <> 0
    UNION ALL SELECT DISTINCT 'fd00::' || lower(to_hex(s_suppkey % 65536)), true, '**', 'Private IP' FROM supplier""",
)
def locate_mixed(spark, sf_dir):
    return E.locate(mixed_addresses(spark, sf_dir), mixed_ranges(spark, sf_dir))


def dns_table(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(
        "concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 100 AS STRING)) AS ip",
        "concat('host-', CAST(user_id % 40 AS STRING), '.example.com') AS hostname",
    )


def named_alerts(spark, sf_dir):
    """Alerts with a host name and a URL observable."""
    alerts = observed_alerts(spark, sf_dir)
    link = F.struct(
        F.lit("url").alias("type"),
        F.concat(F.lit("http://host-"), (F.col("seq") % 50).cast("string"), F.lit(".example.com/a?b")).alias("value"),
        F.lit("Link").alias("description"),
        F.array(F.lit("link")).alias("tags"),
    )
    return alerts.withColumn("observables", F.array_append("observables", link)).withColumn(
        "hostname", F.concat(F.lit("host-"), (F.col("seq") % 45).cast("string"), F.lit(".example.com"))
    )


_DNS = """dns AS (SELECT DISTINCT '10.0.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 100 AS VARCHAR) AS ip,
      'host-' || CAST(user_id % 40 AS VARCHAR) || '.example.com' AS hostname FROM events),
    ents AS (SELECT DISTINCT 'A-' || CAST(packet_id AS VARCHAR) AS id, packet_id, src_ip AS ip FROM packets UNION SELECT 'A-' || CAST(packet_id AS VARCHAR), packet_id, dst_ip FROM packets),
    names AS (SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, 'host-' || CAST(packet_id % 50 AS VARCHAR) || '.example.com' AS hostname FROM packets
      UNION SELECT 'A-' || CAST(packet_id AS VARCHAR), 'host-' || CAST(packet_id % 45 AS VARCHAR) || '.example.com' FROM packets),
    links AS (SELECT id, ip AS entity, 'hostnames' AS kind, hostname AS value FROM ents JOIN dns USING (ip)
      UNION ALL SELECT id, hostname, 'ip_addresses', ip FROM names JOIN dns USING (hostname))"""


@query("d7_dns_links", with_packets(f"WITH {_DNS} SELECT * FROM links"))
def dns_links(spark, sf_dir):
    return E.dns_links(named_alerts(spark, sf_dir), dns_table(spark, sf_dir))


@query(
    "d7_enrich_dns",
    with_packets(f"""WITH {_DNS}, g AS (SELECT id, count(*) AS n, min(value) AS v FROM links GROUP BY id, entity, kind)
    SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, (SELECT count(*) FROM g WHERE g.id = 'A-' || CAST(packet_id AS VARCHAR)) AS entities,
      coalesce((SELECT CAST(sum(n) AS BIGINT) FROM g WHERE g.id = 'A-' || CAST(packet_id AS VARCHAR)), 0) AS resolved FROM packets"""),
)
def enrich_dns(spark, sf_dir):
    out = E.enrich_dns(named_alerts(spark, sf_dir), dns_table(spark, sf_dir))
    values = F.coalesce(F.map_values("dns"), F.array().cast("array<struct<kind:string,n:bigint,first_value:string>>"))
    return out.select(
        "id",
        F.size(values).cast("long").alias("entities"),
        F.aggregate(values, F.lit(0).cast("long"), lambda acc, v: acc + v["n"]).alias("resolved"),
    )


@query(
    "d8_summarise_pulses",
    f"""WITH p AS ({PULSES_SQL})
    SELECT indicator, count(*) AS pulse_count, true AS malicious, min(created) AS first_seen, max(modified) AS last_seen,
      count(DISTINCT name) AS distinct_sources, count(DISTINCT ref) AS distinct_references,
      (SELECT count(DISTINCT t) FROM (SELECT unnest([tag1, tag2]) AS t FROM p q WHERE q.indicator = p.indicator)) AS distinct_tags
    FROM p GROUP BY indicator""",
)
def summarise_pulses(spark, sf_dir):
    return E.summarise_pulses(pulses(spark, sf_dir))


@query(
    "d8_pulse_attributes",
    f"""WITH p AS ({PULSES_SQL}) SELECT DISTINCT indicator, 'source' AS kind, name AS value FROM p UNION SELECT indicator, 'reference', ref FROM p
      UNION SELECT indicator, 'tag', tag1 FROM p UNION SELECT indicator, 'tag', tag2 FROM p""",
)
def pulse_attributes(spark, sf_dir):
    return E.pulse_attributes(pulses(spark, sf_dir))


def intel_table(spark, sf_dir):
    """One row per address, domain or hash with a count; counted indicators are malicious."""
    found = indicators(spark, sf_dir).groupBy(F.col("value").alias("indicator")).agg(F.count(F.lit(1)).alias("pulse_count"))
    return found.withColumn("malicious", F.col("pulse_count") > 1)


_INTEL = f"""intel AS (SELECT value AS indicator, count(*) AS pulse_count, count(*) > 1 AS malicious FROM indicators GROUP BY 1),
    found AS (SELECT DISTINCT id, indicator, type FROM (SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, src_ip AS indicator, 'ip' AS type FROM packets
      UNION ALL SELECT 'A-' || CAST(packet_id AS VARCHAR), dst_ip, 'ip' FROM packets
      UNION ALL SELECT 'A-' || CAST(packet_id AS VARCHAR), md5(payload), 'md5' FROM packets)),
    per AS (SELECT id, count(*) AS known, string_agg(indicator || '/' || type, ',' ORDER BY indicator) FILTER (WHERE malicious) AS bad
      FROM found JOIN intel USING (indicator) GROUP BY id)"""


@query(
    "d9_enrich_intel",
    on_indicators(f"""WITH {_INTEL} SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, coalesce(known, 0) AS known, coalesce(bad, '') AS malicious
      FROM packets LEFT JOIN per ON per.id = 'A-' || CAST(packet_id AS VARCHAR)"""),
)
def enrich_intel(spark, sf_dir):
    out = E.enrich_intel(observed_alerts(spark, sf_dir), intel_table(spark, sf_dir))
    names = F.transform("malicious_indicators", lambda m: F.concat(m["indicator"], F.lit("/"), m["type"]))
    return out.select(
        "id", F.coalesce(F.size("threat_intel"), F.lit(0)).cast("long").alias("known"), F.coalesce(F.array_join(names, ","), F.lit("")).alias("malicious")
    )


@query(
    "d10_enrich_and_escalate",
    on_indicators(f"""WITH {_INTEL}, {_LOCATED}
      SELECT 'A-' || CAST(packet_id AS VARCHAR) AS id, CASE WHEN bad IS NOT NULL THEN 'high' ELSE lower({SEVERITY_COLUMNS.replace('event_id', 'packet_id')}) END AS severity,
        CASE WHEN bad IS NOT NULL THEN 'malicious' ELSE '' END AS tags, coalesce(city, '') || ', ' || country_name AS source_location,
        TIMESTAMP '2024-02-01 00:00:00' AS enrichment_time
      FROM packets LEFT JOIN per ON per.id = 'A-' || CAST(packet_id AS VARCHAR)
      LEFT JOIN located ON located.id = 'A-' || CAST(packet_id AS VARCHAR) AND located.ip = src_ip"""),
)
def enrich_and_escalate(spark, sf_dir):
    geo, intel = geo_ranges(spark, sf_dir), intel_table(spark, sf_dir)
    steps = [lambda a: E.enrich_geoip(a, geo), lambda a: E.enrich_intel(a, intel), E.escalate]
    out = E.enrich(observed_alerts(spark, sf_dir), steps, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.select("id", "severity", F.array_join("tags", ",").alias("tags"), "source_location", "enrichment_time")


# -- cases --------------------------------------------------------------------

_RANK = "CASE sev WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"
_ALERTS = f"alerts AS (SELECT *, lower({SEVERITY_COLUMNS.replace('event_id', 'packet_id')}) AS sev FROM packets)"


@query(
    "e21_cases",
    with_packets(f"""WITH {_ALERTS} SELECT src_ip AS source_ip, CASE max({_RANK}) WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity,
      count(*) AS alert_count FROM alerts GROUP BY 1"""),
)
def cases(spark, sf_dir):
    return E.build_cases(observed_alerts(spark, sf_dir), "source_ip")


@query(
    "e21_case_alerts",
    with_packets("""SELECT src_ip AS source_ip, row_number() OVER (PARTITION BY src_ip ORDER BY ts, 'A-' || CAST(packet_id AS VARCHAR)) AS position,
      'A-' || CAST(packet_id AS VARCHAR) AS alert_id, '- Alert on ' || protocol || ' (A-' || CAST(packet_id AS VARCHAR) || ')' AS line FROM packets"""),
)
def case_alerts(spark, sf_dir):
    return E.case_alerts(observed_alerts(spark, sf_dir), "source_ip")


@query(
    "e21_case_observables",
    with_packets("""WITH o AS (SELECT src_ip AS source_ip, ts, packet_id, 0 AS pos, src_ip AS value, 'ip' AS type, 'Source IP' AS description FROM packets
      UNION ALL SELECT src_ip, ts, packet_id, 1, dst_ip, 'ip', 'Destination IP' FROM packets
      UNION ALL SELECT src_ip, ts, packet_id, 2, md5(payload), 'md5', 'Payload hash' FROM packets)
    SELECT source_ip, value, type, description FROM (SELECT *, row_number() OVER (PARTITION BY source_ip, value ORDER BY ts, packet_id, pos) AS r FROM o) WHERE r = 1"""),
)
def case_observables(spark, sf_dir):
    out = E.case_observables(observed_alerts(spark, sf_dir), "source_ip", ["timestamp", "seq"])
    return out.select("source_ip", "value", "type", "description")


# -- sets ---------------------------------------------------------------------


@query("i1_aggregate_feeds", on_indicators("SELECT DISTINCT indicator_type, value FROM indicators"))
def aggregate_feeds(spark, sf_dir):
    return T.aggregate_feeds(indicators(spark, sf_dir))


@query("i1_feed_totals", on_indicators("SELECT indicator_type, count(DISTINCT value) AS indicators FROM indicators GROUP BY 1"))
def feed_totals(spark, sf_dir):
    return T.feed_totals(indicators(spark, sf_dir))


@query(
    "i2_feed_delta",
    on_indicators("""SELECT 'removed' AS change, * FROM (SELECT indicator_type, value FROM indicators WHERE feed = 'hosts' EXCEPT SELECT indicator_type, value FROM indicators WHERE feed = 'sinkhole')
      UNION ALL SELECT 'added', * FROM (SELECT indicator_type, value FROM indicators WHERE feed = 'sinkhole' EXCEPT SELECT indicator_type, value FROM indicators WHERE feed = 'hosts')"""),
)
def feed_delta(spark, sf_dir):
    i = indicators(spark, sf_dir)
    return T.feed_delta(i.where("feed = 'hosts'"), i.where("feed = 'sinkhole'"))


@query(
    "i3_feed_overlap",
    on_indicators("""SELECT indicator_type, value FROM indicators WHERE feed = 'hosts' INTERSECT SELECT indicator_type, value FROM indicators WHERE feed = 'sinkhole'"""),
)
def feed_overlap(spark, sf_dir):
    i = indicators(spark, sf_dir)
    return T.feed_overlap(i.where("feed = 'hosts'"), i.where("feed = 'sinkhole'"))
