"""Signature rule queries on the packet view."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from netsift.operators import rules as R
from netsift.plans.catalogue import query
from netsift.plans.tables import packets, with_packets

# The events are sparse, so the rate rules are read over hours here.
HOUR = 3600


def sparse_rules() -> list[R.SignatureRule]:
    rates = {"RATE-001": (2, 48 * HOUR), "RATE-002": (3, 12 * HOUR), "RATE-003": (2, 48 * HOUR)}
    rules = []
    for rule in R.default_rules():
        if rule.rule_id in rates:
            count, seconds = rates[rule.rule_id]
            rule = replace(rule, count=count, seconds=seconds)
        if rule.rule_id == "COMP-001":
            port, rate = rule.subrules
            rule = replace(rule, subrules=[port, replace(rate, count=2, seconds=48 * HOUR)])
        rules.append(rule)
    return rules


def _like(patterns: list[str]) -> str:
    return "regexp_matches(payload, '" + "|".join(f"(?:{p})" for p in patterns).replace("'", "''") + "', 'i')"


_SPECS = {s["rule_id"]: s for s in R.DEFAULT_RULES}
_RATE_TERMS = f"""
 r1 AS (SELECT *, count(*) OVER (PARTITION BY coalesce(src_ip,''), coalesce(CAST(dst_port AS VARCHAR),'') ORDER BY ts
          RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) >= 2 AS rate_001,
        count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) >= 3 AS rate_002,
        dst_port = 53 AND count(*) FILTER (WHERE dst_port = 53) OVER (PARTITION BY src_ip ORDER BY ts
          RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) >= 2 AS comp_001
      FROM packets),
 r2 AS (SELECT *, src_ip LIKE '185.216.35.%' OR src_ip LIKE '192.99.142.%' AS ip_001,
        src_ip LIKE '109.70.100.%' OR src_ip LIKE '171.25.193.%' AS ip_002,
        {_like(_SPECS['PAYLOAD-001']['patterns'])} AS payload_001,
        {_like(_SPECS['PAYLOAD-002']['patterns'])} AS payload_002,
        {_like(_SPECS['PAYLOAD-003']['patterns'])} AS payload_003,
        dst_port IN (21,22,23,445,1433,3306,3389) AS port_001
      FROM r1)"""


@query(
    "h6_check_signatures",
    with_packets(f"""WITH {_RATE_TERMS}
    SELECT * FROM (SELECT packet_id, ts, CASE WHEN rate_001 THEN 'RATE-001' WHEN rate_002 THEN 'RATE-002' WHEN ip_001 THEN 'IP-001'
      WHEN ip_002 THEN 'IP-002' WHEN payload_001 THEN 'PAYLOAD-001' WHEN payload_002 THEN 'PAYLOAD-002'
      WHEN payload_003 THEN 'PAYLOAD-003' WHEN port_001 THEN 'PORT-001' WHEN comp_001 THEN 'COMP-001' END AS rule_id,
      CASE WHEN rate_001 THEN 'high' WHEN rate_002 THEN 'medium' WHEN ip_001 THEN 'high'
      WHEN ip_002 THEN 'medium' WHEN payload_001 THEN 'critical' WHEN payload_002 THEN 'critical'
      WHEN payload_003 THEN 'high' WHEN port_001 THEN 'medium' WHEN comp_001 THEN 'high' END AS severity FROM r2)
    WHERE rule_id IS NOT NULL"""),
)
def check_signatures(spark, sf_dir):
    return R.check_signatures(packets(spark, sf_dir), sparse_rules()).select("packet_id", "ts", "rule_id", "severity")


@query(
    "h7_match_all",
    with_packets(f"""WITH {_RATE_TERMS}
    SELECT packet_id, 'RATE-001' AS rule_id FROM r2 WHERE rate_001
    UNION ALL SELECT packet_id, 'RATE-002' FROM r2 WHERE rate_002
    UNION ALL SELECT packet_id, 'RATE-003' FROM r2 WHERE rate_001
    UNION ALL SELECT packet_id, 'IP-001' FROM r2 WHERE ip_001
    UNION ALL SELECT packet_id, 'IP-002' FROM r2 WHERE ip_002
    UNION ALL SELECT packet_id, 'PAYLOAD-001' FROM r2 WHERE payload_001
    UNION ALL SELECT packet_id, 'PAYLOAD-002' FROM r2 WHERE payload_002
    UNION ALL SELECT packet_id, 'PAYLOAD-003' FROM r2 WHERE payload_003
    UNION ALL SELECT packet_id, 'PORT-001' FROM r2 WHERE port_001
    UNION ALL SELECT packet_id, 'COMP-001' FROM r2 WHERE comp_001"""),
)
def match_all(spark, sf_dir):
    return R.match_all(packets(spark, sf_dir), sparse_rules()).select("packet_id", "rule_id")


@query(
    "h8_default_rules_by_severity",
    with_packets(f"""WITH hits AS (SELECT *, count(*) OVER (PARTITION BY coalesce(src_ip,''), coalesce(CAST(dst_port AS VARCHAR),'')
        ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) >= 5 AS rate_001,
       count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 5 SECOND PRECEDING AND CURRENT ROW) >= 15 AS rate_002,
       dst_port = 53 AND count(*) FILTER (WHERE dst_port = 53) OVER (PARTITION BY src_ip ORDER BY ts
         RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) >= 30 AS comp_001 FROM packets),
    first_hit AS (SELECT CASE WHEN rate_001 THEN 'RATE-001 high' WHEN rate_002 THEN 'RATE-002 medium'
      WHEN src_ip LIKE '185.216.35.%' OR src_ip LIKE '192.99.142.%' THEN 'IP-001 high'
      WHEN src_ip LIKE '109.70.100.%' OR src_ip LIKE '171.25.193.%' THEN 'IP-002 medium'
      WHEN {_like(_SPECS['PAYLOAD-001']['patterns'])} THEN 'PAYLOAD-001 critical'
      WHEN {_like(_SPECS['PAYLOAD-002']['patterns'])} THEN 'PAYLOAD-002 critical'
      WHEN {_like(_SPECS['PAYLOAD-003']['patterns'])} THEN 'PAYLOAD-003 high'
      WHEN dst_port IN (21,22,23,445,1433,3306,3389) THEN 'PORT-001 medium'
      WHEN comp_001 THEN 'COMP-001 high' END AS hit FROM hits)
    SELECT split_part(hit, ' ', 1) AS rule_id, split_part(hit, ' ', 2) AS severity, count(*) AS alerts
    FROM first_hit WHERE hit IS NOT NULL GROUP BY 1, 2"""),
)
def default_rules_by_severity(spark, sf_dir):
    found = R.check_signatures(packets(spark, sf_dir), R.default_rules())
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("alerts"))


@query(
    "f2_rate_match",
    with_packets("""SELECT packet_id,
      count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) >= 2 AS by_ip,
      dst_port IS NOT NULL AND count(*) OVER (PARTITION BY dst_port ORDER BY ts
        RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) >= 9 AS by_port,
      count(*) OVER (PARTITION BY coalesce(src_ip,''), coalesce(CAST(dst_port AS VARCHAR),'') ORDER BY ts
        RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) >= 2 AS by_ip_port
    FROM packets"""),
)
def rate_match(spark, sf_dir):
    df = packets(spark, sf_dir).select("packet_id", "ts", "src_ip", "dst_port")
    df = R.rate_match(df, "ip", 2, 6 * HOUR, name="by_ip")
    df = R.rate_match(df, "port", 9, 6 * HOUR, name="by_port")
    df = R.rate_match(df, "ip_port", 2, 6 * HOUR, name="by_ip_port")
    return df.select("packet_id", "by_ip", "by_port", "by_ip_port")


@query(
    "h1_port_rule",
    with_packets("""SELECT packet_id, coalesce(dst_port IN (22, 23) OR dst_port BETWEEN 40000 AND 40500, false) AS by_dst,
      coalesce(src_port BETWEEN 1024 AND 2047, false) AS by_src,
      coalesce(src_port = 53, false) OR coalesce(dst_port = 53, false) AS by_both FROM packets"""),
)
def port_rule(spark, sf_dir):
    dst = R.PortRule("P1", "dst", port_list=[22, "23", "40000-40500"])
    src = R.PortRule("P2", "src", port_list=["1024-2047"], direction="src")
    both = R.PortRule("P3", "both", port_list=["53", "x"], direction="both")
    return packets(spark, sf_dir).select(
        "packet_id", dst.column().alias("by_dst"), src.column().alias("by_src"), both.column().alias("by_both")
    )


@query(
    "h2_ip_rule",
    with_packets("""SELECT packet_id, src_ip LIKE '185.216.35.%' OR src_ip = '8.8.1.17' AS by_src,
      dst_ip LIKE '10.0.0.%' OR dst_ip LIKE '10.0.1.%' AS by_dst,
      src_ip LIKE '192.168.%' OR dst_ip LIKE '192.168.%' AS by_both FROM packets"""),
)
def ip_rule(spark, sf_dir):
    src = R.IPRule("I1", "src", ip_list=["185.216.35.7/24", "8.8.1.17", "not an address"])
    dst = R.IPRule("I2", "dst", ip_list=["10.0.0.0/23", "2001:db8::/32"], direction="dst")
    both = R.IPRule("I3", "both", ip_list=["192.168.0.0/16"], direction="both")
    return packets(spark, sf_dir).select(
        "packet_id", src.column().alias("by_src"), dst.column().alias("by_dst"), both.column().alias("by_both")
    )


@query(
    "h3_payload_rule",
    f"""SELECT doc_id, regexp_matches(text, '(?:password|secret)|(?:[a-z]+@[a-z]+)', 'i') AS any_case,
      regexp_matches(text, '(?:The)|(?:Der)') AS as_written FROM documents""",
)
def payload_rule(spark, sf_dir):
    from netsift.plans.tables import table

    docs = table(spark, sf_dir, "documents").withColumnRenamed("text", "payload")
    loose = R.PayloadRule("T1", "loose", patterns=["password|secret", "[a-z]+@[a-z]+", "("])
    exact = R.PayloadRule("T2", "exact", patterns=["The", "Der"], case_sensitive=True)
    return docs.select("doc_id", loose.column().alias("any_case"), exact.column().alias("as_written"))


@query(
    "h5_composite_rule",
    with_packets("""SELECT packet_id,
      coalesce(src_ip LIKE '192.168.%' AND (dst_port = 22 OR regexp_matches(payload, 'select', 'i')), false) AS nested,
      coalesce(dst_port IN (22, 3306), false) AND count(*) FILTER (WHERE dst_port IN (22, 3306)) OVER (PARTITION BY src_ip
        ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) >= 3 AS gated FROM packets"""),
)
def composite_rule(spark, sf_dir):
    either = R.CompositeRule(
        "C2", "either", operator="or", subrules=[R.PortRule("p", "p", port_list=[22]), R.PayloadRule("t", "t", patterns=["select"])]
    )
    nested = R.CompositeRule("C1", "nested", subrules=[R.IPRule("i", "i", ip_list=["192.168.0.0/16"]), either])
    gated = R.CompositeRule(
        "C3",
        "gated",
        subrules=[R.PortRule("p", "p", port_list=[22, 3306]), R.RateRule("r", "r", count=3, seconds=48 * HOUR)],
    )
    flagged, (a, b) = R.evaluate_rules(packets(spark, sf_dir), [nested, gated])
    return flagged.select("packet_id", F.col(a).alias("nested"), F.col(b).alias("gated"))
