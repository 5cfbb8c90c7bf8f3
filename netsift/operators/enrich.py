"""Alert enrichment: location, names, threat intelligence, escalation, cases.

Tables with an unbounded number of values per key (host names of an address,
tags of an indicator) stay in long form, one row per value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.functions.alerts import map_severity
from netsift.functions.indicators import indicator_type, url_host
from netsift.functions.network import ip_key, is_ip, is_private_ip
from netsift.operators.ordering import carry_last, ensure_checkpoints, row_numbers

# Alert fields that hold addresses, host names and indicators.
IP_FIELDS = ["source_ip", "destination_ip", "src_ip", "dst_ip", "ip"]
HOSTNAME_FIELDS = ["hostname", "domain", "fqdn", "host"]
INDICATOR_FIELDS = [
    "ip",
    "source_ip",
    "destination_ip",
    "src_ip",
    "dst_ip",
    "hostname",
    "domain",
    "hash",
    "url",
    "md5",
    "sha1",
    "sha256",
]
GEO_FIELDS = ["country_code", "country_name", "city", "latitude", "longitude", "time_zone", "continent", "asn", "organization"]

# What is known of a private address.
PRIVATE_GEO = {"country_code": "**", "country_name": "Private IP"}

_NO_TEXT = "array<string>"


def _field_values(alerts: DataFrame, fields: Sequence[str]) -> Column:
    present = [F.col(f) for f in fields if f in alerts.columns]
    values = F.array(*present) if present else F.array().cast(_NO_TEXT)
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def _observed(alerts: DataFrame, kinds: Sequence[str]) -> Column:
    if "observables" not in alerts.columns:
        return F.array().cast(_NO_TEXT)
    chosen = F.filter("observables", lambda o: o["type"].isin(list(kinds)) & (o["value"] != ""))
    return F.coalesce(F.transform(chosen, lambda o: o["value"]), F.array().cast(_NO_TEXT))


def alert_addresses(alerts: DataFrame) -> Column:
    """Distinct addresses of an alert: five fields and ``ip`` observables."""
    return F.array_distinct(F.concat(_field_values(alerts, IP_FIELDS), _observed(alerts, ["ip"])))


def alert_hostnames(alerts: DataFrame) -> Column:
    """Distinct host names of an alert: fields, observables and hosts of URL observables."""
    hosts = F.filter(F.transform(_observed(alerts, ["url"]), lambda u: url_host(u)), lambda h: h != "")
    return F.array_distinct(F.concat(_field_values(alerts, HOSTNAME_FIELDS), _observed(alerts, ["domain", "hostname"]), hosts))


def _range_key(geo: DataFrame, end: str) -> Column:
    """Sort key of one end of a range: an IPv4 number, or an address of either family as text."""
    if isinstance(geo.schema[end].dataType, T.StringType):
        return ip_key(end)
    return F.concat(F.lit("4"), F.lpad(F.hex(F.col(end).cast("long")), 32, "0"))


def locate(addresses: DataFrame, geo: DataFrame, ip: str = "ip") -> DataFrame:
    """Distinct addresses with their location: ``ip``, ``is_private`` and the fields of ``geo``.

    Private addresses get a fixed record, others the range (``lo``..``hi``,
    not overlapping, of either family; numbers are IPv4) they lie in; unknown
    ones are left out. Ranges and addresses are put into one order of 128-bit
    keys, in which each address takes the last range that starts at or before
    it (:func:`carry_last`): no pairs are formed, however wide a range is.
    """
    ensure_checkpoints(addresses.sparkSession)
    fields = [c for c in GEO_FIELDS if c in geo.columns]
    # written once: the texts are taken from the rows a single time and checked once each, not once a row
    distinct = addresses.select(F.col(ip).alias("ip")).distinct().checkpoint()
    distinct = distinct.where(is_ip("ip")).select("ip", is_private_ip("ip").alias("is_private"))
    private = distinct.where("is_private").select(
        "ip",
        "is_private",
        *[F.lit(PRIVATE_GEO.get(c)).cast(geo.schema[c].dataType).alias(c) for c in fields],
    )
    known = F.struct(_range_key(geo, "hi").alias("_to"), *fields)
    ranges = geo.select(_range_key(geo, "lo").alias("_key"), known.alias("_range")).where("_key IS NOT NULL AND _range._to IS NOT NULL")
    public = distinct.where("NOT is_private").select(ip_key("ip").alias("_key"), "ip")
    both = ranges.select("_key", F.lit(None).cast("string").alias("ip"), "_range").unionByName(public, allowMissingColumns=True)
    # a range comes before the addresses at its start
    found = carry_last(both.withColumn("_kind", F.col("ip").isNotNull()), ["_key", "_kind"], "_range", "_range_at")
    found = found.where("_kind AND _key <= _range_at._to").select("ip", F.lit(False).alias("is_private"), *[F.col(f"_range_at.{c}").alias(c) for c in fields])
    return private.unionByName(found)


def enrich_geoip(alerts: DataFrame, geo: DataFrame, row_id: str = "id", name: str = "geoip") -> DataFrame:
    """Add a map from each of the alert's addresses to its location."""
    pairs = alerts.select(F.col(row_id).alias("_id"), F.explode(alert_addresses(alerts)).alias("ip"))
    located = locate(pairs, geo)
    record = F.struct(*[c for c in located.columns if c != "ip"])
    entries = F.struct(F.col("ip").alias("key"), record.alias("value"))
    # as many entries as the alert itself lists addresses
    per_alert = pairs.join(located, "ip").groupBy("_id").agg(F.map_from_entries(F.collect_list(entries)).alias(name))
    return alerts.join(per_alert, F.col(row_id) == F.col("_id"), "left").drop("_id")


def dns_links(alerts: DataFrame, dns: DataFrame, row_id: str = "id") -> DataFrame:
    """Resolved names of an alert: (row id, entity, kind, value), kind ``hostnames`` or ``ip_addresses``."""
    ips = alerts.select(row_id, F.explode(alert_addresses(alerts)).alias("entity"))
    names = alerts.select(row_id, F.explode(alert_hostnames(alerts)).alias("entity"))
    pairs = dns.select("ip", "hostname").distinct()
    by_ip = ips.join(pairs, F.col("entity") == F.col("ip")).select(row_id, "entity", F.lit("hostnames").alias("kind"), F.col("hostname").alias("value"))
    by_name = names.join(pairs, F.col("entity") == F.col("hostname")).select(
        row_id, "entity", F.lit("ip_addresses").alias("kind"), F.col("ip").alias("value")
    )
    return by_ip.unionByName(by_name)


def enrich_dns(alerts: DataFrame, dns: DataFrame, row_id: str = "id", name: str = "dns") -> DataFrame:
    """Add how many names or addresses each entity of the alert resolves to, and the first of them.

    The full lists are the rows of :func:`dns_links`.
    """
    links = dns_links(alerts, dns, row_id).groupBy(F.col(row_id).alias("_id"), "entity", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("first_value")
    )
    entry = F.struct(F.col("entity").alias("key"), F.struct("kind", "n", "first_value").alias("value"))
    per_alert = links.groupBy("_id").agg(F.map_from_entries(F.collect_list(entry)).alias(name))
    return alerts.join(per_alert, F.col(row_id) == F.col("_id"), "left").drop("_id")


def summarise_pulses(pulses: DataFrame) -> DataFrame:
    """Per indicator: pulses, malicious, first and last seen, distinct tags, sources and references.

    ``pulses`` as in ``schemas.PULSE``; the values themselves come from
    :func:`pulse_attributes`.
    """
    seen = pulses.select(F.explode("indicators").alias("_i"), "created", "modified")
    seen = seen.where(F.col("_i.indicator") != "")
    base = seen.groupBy(F.col("_i.indicator").alias("indicator")).agg(
        F.count(F.lit(1)).alias("pulse_count"), F.min("created").alias("first_seen"), F.max("modified").alias("last_seen")
    )
    kinds = {"tags": "tag", "sources": "source", "references": "reference"}
    counts = pulse_attributes(pulses).groupBy("indicator").agg(
        *[F.count_if(F.col("kind") == k).alias(f"distinct_{n}") for n, k in kinds.items()]
    )
    out = base.join(counts, "indicator", "left").fillna(0, [f"distinct_{n}" for n in kinds])
    return out.withColumn("malicious", F.col("pulse_count") > 0)


def pulse_attributes(pulses: DataFrame) -> DataFrame:
    """Distinct (indicator, kind, value); kind is tag, source or reference."""

    def of(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    none = F.array().cast(_NO_TEXT)
    attributes = F.concat(
        of("tag", F.coalesce("tags", none)), of("source", F.array("name")), of("reference", F.coalesce("references", none))
    )
    return (
        pulses.select("indicators", attributes.alias("_a"))
        .select(F.explode("indicators.indicator").alias("indicator"), "_a")
        .where(F.col("indicator") != "")
        .select("indicator", F.explode("_a").alias("_a"))
        .where(F.col("_a.value").isNotNull())
        .select("indicator", "_a.kind", "_a.value")
        .distinct()
    )


def alert_indicators(alerts: DataFrame, row_id: str = "id") -> DataFrame:
    """Distinct (row id, indicator, type) of an alert: twelve fields and all observables."""
    known = ["ip", "domain", "url", "md5", "sha1", "sha256"]
    fields = F.transform(_field_values(alerts, INDICATOR_FIELDS), lambda v: F.struct(v.alias("value"), F.lit(None).cast("string").alias("kind")))
    found = fields
    if "observables" in alerts.columns:
        usable = F.filter("observables", lambda o: o["value"] != "")
        observed = F.transform(
            usable,
            lambda o: F.struct(o["value"].alias("value"), F.when(F.lower(o["type"]).isin(known), F.lower(o["type"])).alias("kind")),
        )
        found = F.concat(fields, F.coalesce(observed, F.array().cast("array<struct<value:string,kind:string>>")))
    pairs = alerts.select(row_id, F.explode(found).alias("_f")).select(row_id, F.col("_f.value").alias("indicator"), "_f.kind")
    # an observable's own type wins over a guess, which is made only where there is none
    chosen = pairs.groupBy(row_id, "indicator").agg(F.max("kind").alias("_kind"))
    return chosen.select(row_id, "indicator", F.coalesce("_kind", indicator_type("indicator")).alias("type")).where("type <> 'unknown'")


def enrich_intel(alerts: DataFrame, intel: DataFrame, row_id: str = "id") -> DataFrame:
    """Add ``threat_intel`` and ``malicious_indicators`` (arrays over the alert's own indicators).

    ``intel`` has one row per indicator, as :func:`summarise_pulses` gives.
    """
    facts = [c for c in intel.columns if c != "indicator"]
    found = alert_indicators(alerts, row_id).join(intel, "indicator")
    entry = F.struct("indicator", "type", *facts)
    malicious = F.when(F.col("malicious"), F.struct("indicator", "type"))
    per_alert = found.groupBy(F.col(row_id).alias("_id")).agg(
        F.array_sort(F.collect_list(entry)).alias("threat_intel"),
        F.array_sort(F.collect_list(malicious)).alias("malicious_indicators"),
    )
    return alerts.join(per_alert, F.col(row_id) == F.col("_id"), "left").drop("_id")


def enrich(alerts: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]], now: Column) -> DataFrame:
    """Run enrichment steps in order and note the time."""
    for step in steps:
        alerts = alerts.transform(step)
    return alerts.withColumn("enrichment_time", now)


def escalate(alerts: DataFrame) -> DataFrame:
    """Severity ``high`` and tag ``malicious`` for malicious indicators; adds the source's location."""
    is_bad = F.coalesce(F.size("malicious_indicators") > 0, F.lit(False)) if "malicious_indicators" in alerts.columns else F.lit(False)
    tags = F.coalesce("tags", F.array().cast(_NO_TEXT)) if "tags" in alerts.columns else F.array().cast(_NO_TEXT)
    out = alerts.withColumns(
        {
            "severity": F.when(is_bad, "high").otherwise(F.col("severity")),
            "tags": F.when(is_bad, F.array_append(tags, "malicious")).otherwise(tags),
        }
    )
    if "geoip" in alerts.columns:
        place = F.try_element_at("geoip", F.col("source_ip"))
        text = F.concat(F.coalesce(place["city"], F.lit("")), F.lit(", "), place["country_name"])
        out = out.withColumn("source_location", text)
    return out


# -- cases --------------------------------------------------------------------


def build_cases(alerts: DataFrame, case_key: str) -> DataFrame:
    """One row per case: highest severity and number of alerts."""
    best = F.max_by(F.lower("severity"), map_severity("severity", "rank"))
    known = F.when(F.max(map_severity("severity", "rank")) > 0, best).otherwise("low")
    return alerts.groupBy(case_key).agg(known.alias("severity"), F.count(F.lit(1)).alias("alert_count"))


def case_alerts(alerts: DataFrame, case_key: str, ts: str = "timestamp", row_id: str = "id", slice_seconds: float = 3600) -> DataFrame:
    """The alerts of a case in order: (case, position from 1, id, line)."""
    line = F.concat(
        F.lit("- "), F.coalesce("title", F.lit("Unknown Alert")), F.lit(" ("), F.coalesce(row_id, F.lit("Unknown ID")), F.lit(")")
    )
    lines = alerts.select(case_key, ts, F.col(row_id).alias("alert_id"), line.alias("line"))
    numbered = row_numbers(lines, [case_key], ts, ["alert_id"], slice_seconds, "position")
    return numbered.select(case_key, "position", "alert_id", "line")


def case_observables(alerts: DataFrame, case_key: str, order: Sequence[str]) -> DataFrame:
    """Observables of a case, unique by value; the first in ``order`` is kept."""
    flat = alerts.select(case_key, *order, F.posexplode("observables").alias("_pos", "_o")).where(F.col("_o.value") != "")
    first = F.min_by("_o", F.struct(*order, "_pos"))
    return flat.groupBy(case_key, F.col("_o.value").alias("value")).agg(first.alias("_o")).select(
        case_key, "value", "_o.type", "_o.description", "_o.tags"
    )
