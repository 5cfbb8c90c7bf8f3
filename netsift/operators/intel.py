"""Threat indicators: matching packets, verdicts, feed sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.indicators import text_indicators
from netsift.functions.network import IPV4_PATTERN, _signed, ip_to_long, ipv6_to_longs

BROADCAST_NETWORKS = 50_000
INDICATOR_TYPES = ["ip", "domain", "url", "hash", "other"]


def _listed(indicators: DataFrame) -> DataFrame:
    """Distinct (type, value), named so that they do not clash in a join."""
    return indicators.select(F.col("indicator_type").alias("_type"), F.col("value").alias("_value")).distinct()


def _address_candidates() -> Column:
    ends = [F.struct(F.lit(c).alias("field"), F.lit("ip").alias("type"), F.col(c).alias("value")) for c in ("src_ip", "dst_ip")]
    return F.filter(F.array(*ends), lambda e: e["value"].isNotNull())


def match_ip_indicators(packets: DataFrame, indicators: DataFrame, row_id: str = "packet_id") -> DataFrame:
    """One row per packet and end whose address is a listed indicator."""
    ends = packets.select(row_id, F.explode(_address_candidates()).alias("_e"))
    listed = _listed(indicators).where("_type = 'ip'")
    found = ends.join(listed, F.col("_e.value") == F.col("_value"))
    return found.select(row_id, F.col("_e.field").alias("field"), F.col("_value").alias("value"))


def feed_periods(snapshots: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """When each indicator was listed: (feed, indicator_type, value, ``valid_from``, ``valid_to``).

    ``snapshots`` holds whole lists (feed, ``snapshot_at``, indicator_type, value). A list holds from its time
    until that of the feed's next one; neighbouring lists with the same indicator are one period, so
    periods of one indicator do not overlap. ``versions`` (feed, snapshot_at) names the lists where some
    were empty. ``valid_to`` is NULL for what is still listed.
    """
    times = (snapshots if versions is None else versions).select("feed", "snapshot_at").where("snapshot_at IS NOT NULL").distinct()
    by_feed = Window.partitionBy("feed").orderBy("snapshot_at")
    times = times.select(F.col("feed").alias("_feed"), F.col("snapshot_at").alias("_at"), F.row_number().over(by_feed).alias("_no"), F.lead("snapshot_at").over(by_feed).alias("_until"))
    own = ["feed", "indicator_type", "value"]
    listed = snapshots.select(*own, "snapshot_at").distinct().join(times, F.col("feed").eqNullSafe(F.col("_feed")) & (F.col("snapshot_at") == F.col("_at")))
    run = F.col("_no") - F.row_number().over(Window.partitionBy(*own).orderBy("_no"))
    return listed.withColumn("_run", run).groupBy(*own, "_run").agg(F.min("_at").alias("valid_from"), F.max_by("_until", "_no").alias("valid_to")).drop("_run")


def match_ip_as_of(packets: DataFrame, periods: DataFrame, row_id: str = "packet_id", ts: str = "ts") -> DataFrame:
    """One row per packet, end and feed that listed the address at the packet's time: the batch may run before or after a refresh."""
    ends = packets.select(row_id, F.col(ts).cast("timestamp").alias("_at"), F.explode(_address_candidates()).alias("_e"))
    listed = periods.where("indicator_type = 'ip'").select("feed", F.col("value").alias("_value"), F.col("valid_from").cast("timestamp").alias("_from"), F.col("valid_to").cast("timestamp").alias("_to"))
    held = (F.col("_e.value") == F.col("_value")) & (F.col("_at") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_at") < F.col("_to")))
    return ends.join(listed, held).select(row_id, F.col("_e.field").alias("field"), F.col("_value").alias("value"), "feed")


def match_text_indicators(df: DataFrame, text: str, indicators: DataFrame, row_id: str = "packet_id") -> DataFrame:
    """One row per text and listed domain or URL found in it."""
    tokens = df.select(row_id, F.explode(F.array_distinct(text_indicators(text))).alias("_e"))
    listed = _listed(indicators).where(F.col("_type").isin("domain", "url"))
    found = tokens.join(listed, (F.col("_e.type") == F.col("_type")) & (F.col("_e.value") == F.col("_value")))
    return found.select(row_id, F.col("_type").alias("indicator_type"), F.col("_value").alias("value"))


def match_hash(df: DataFrame, column: str, indicators: DataFrame) -> DataFrame:
    """Rows whose hash column is a listed hash."""
    listed = _listed(indicators).where("_type = 'hash'").select("_value")
    return df.join(listed, F.col(column) == F.col("_value"), "left_semi")


def feed_verdicts(wanted: DataFrame, indicators: DataFrame, feeds: Sequence[str]) -> DataFrame:
    """Per wanted (indicator_type, value) one boolean per feed, ``in_<feed>``."""
    per_value = indicators.groupBy(F.col("indicator_type").alias("_type"), F.col("value").alias("_value")).agg(
        *[F.max(F.col("feed") == f).alias(f"in_{f}") for f in feeds]
    )
    joined = wanted.join(per_value, (F.col("indicator_type") == F.col("_type")) & (F.col("value") == F.col("_value")), "left")
    return joined.select(*wanted.columns, *[F.coalesce(f"in_{f}", F.lit(False)).alias(f"in_{f}") for f in feeds])


def check_packets(packets: DataFrame, indicators: DataFrame, text: str = "payload", row_id: str = "packet_id") -> DataFrame:
    """Per packet: listed addresses, domains and URLs (counts of distinct values) and ``matched``.

    Candidates are looked up and then combined per packet; the packets
    themselves are read once and their payloads are not shuffled.
    """
    addresses = F.transform(_address_candidates(), lambda e: F.struct(e["type"].alias("type"), e["value"].alias("value")))
    words = F.coalesce(text_indicators(text), F.array().cast("array<struct<type:string,value:string>>"))
    candidates = F.array_distinct(F.concat(addresses, words))
    looked = packets.select(row_id, F.explode_outer(candidates).alias("_e"))
    found = looked.join(
        _listed(indicators), (F.col("_e.type") == F.col("_type")) & (F.col("_e.value") == F.col("_value")), "left"
    )
    return (
        found.groupBy(row_id)
        .agg(*[F.count_if(F.col("_type") == t).alias(f"{t}_matches") for t in ("ip", "domain", "url")])
        .withColumn("matched", F.col("ip_matches") + F.col("domain_matches") + F.col("url_matches") > 0)
    )


# -- networks -----------------------------------------------------------------


def network_table(networks: DataFrame, column: str) -> DataFrame:
    """Distinct networks as (version, prefix, hi, lo) with host bits cleared; bad entries are left out."""
    parts = F.split(F.trim(column), "/")
    address = F.get(parts, F.lit(0))
    given = F.get(parts, F.lit(1))
    parsed = networks.select(
        F.col(column).alias("network"),
        address.rlike(IPV4_PATTERN).alias("_is4"),
        F.struct(F.lit(0).cast("long").alias("hi"), ip_to_long(address).alias("lo")).alias("_v4"),
        ipv6_to_longs(address).alias("_v6"),
        F.when(F.size(parts) == 1, F.lit(-1)).when((F.size(parts) == 2) & given.rlike("^[0-9]{1,3}$"), given.cast("int")).alias("_p"),
    )
    width = F.when(F.col("_is4"), 32).otherwise(128)
    number = F.when(F.col("_is4"), F.col("_v4")).otherwise(F.col("_v6"))
    parsed = parsed.withColumn("prefix", F.when(F.col("_p") == -1, width).otherwise(F.col("_p"))).withColumn("_n", number)
    valid = parsed.where(F.col("_n").isNotNull() & F.col("prefix").between(F.lit(0), width))
    version = F.when(F.col("_is4"), 4).otherwise(6)
    masked = _masked(F.col("_is4"), F.col("_n.hi"), F.col("_n.lo"), F.col("prefix"))
    return valid.select("network", version.alias("version"), "prefix", masked.alias("_m")).select(
        "network", "version", "prefix", "_m.hi", "_m.lo"
    )


def _keep_bits(value: Column, bits: Column) -> Column:
    """The first ``bits`` (0..64) of a 64-bit value."""
    shift = F.lit(64) - bits
    return (
        F.when(bits <= 0, F.lit(0).cast("long"))
        .when(bits >= 64, value)
        .otherwise(F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift))
    )


def _masked(is_v4: Column, hi: Column, lo: Column, prefix: Column) -> Column:
    v4 = F.struct(hi.alias("hi"), F.call_function("shiftleft", F.call_function("shiftright", lo, 32 - prefix), 32 - prefix).alias("lo"))
    v6 = F.struct(_keep_bits(hi, prefix).alias("hi"), _keep_bits(lo, prefix - 64).alias("lo"))
    return F.when(is_v4, v4).otherwise(v6)


def match_cidr(
    packets: DataFrame, networks: DataFrame, column: str = "network", direction: str = "src", row_id: str = "packet_id"
) -> DataFrame:
    """One row per packet, end and network that contains its address.

    Each address is looked up once per prefix length in the list (a handful),
    as an equi-join on the masked address; there is no range join. The side with the
    addresses is never broadcast, whatever the planner takes its size to be (it does not
    see that there is a row per prefix length); a list of at most ``BROADCAST_NETWORKS``
    networks is, and a longer one is joined by sorting.
    """
    table = network_table(networks, column).distinct()
    lengths = table.groupBy("version", "prefix").count().collect()  # at most 33 + 129
    few = sum(r["count"] for r in lengths) <= BROADCAST_NETWORKS
    ends = {"src": ["src_ip"], "dst": ["dst_ip"], "both": ["src_ip", "dst_ip"]}[direction]
    addresses = packets.select(
        row_id, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("ip")) for c in ends])).alias("_e")
    ).select(row_id, F.col("_e.field").alias("field"), F.col("_e.ip").alias("ip"))
    parts = []
    v4 = sorted(r["prefix"] for r in lengths if r["version"] == 4)
    v6 = sorted(r["prefix"] for r in lengths if r["version"] == 6)
    if v4:
        numbers = addresses.select(row_id, "field", ip_to_long("ip").alias("_n")).where(F.col("_n").isNotNull())
        keys = F.array(
            *[
                F.struct(
                    F.lit(4).alias("version"),
                    F.lit(p).alias("prefix"),
                    F.lit(0).cast("long").alias("hi"),
                    (F.col("_n") - F.col("_n") % F.lit(1 << (32 - p))).alias("lo"),
                )
                for p in v4
            ]
        )
        parts.append(numbers.select(row_id, "field", F.explode(keys).alias("_k")))
    if v6:
        numbers = addresses.where(F.col("ip").contains(":")).select(row_id, "field", ipv6_to_longs("ip").alias("_n"))
        full = (1 << 128) - 1
        keys = []
        for p in v6:
            mask = full ^ ((1 << (128 - p)) - 1)
            keys.append(
                F.struct(
                    F.lit(6).alias("version"),
                    F.lit(p).alias("prefix"),
                    F.col("_n.hi").bitwiseAND(F.lit(_signed(mask >> 64))).alias("hi"),
                    F.col("_n.lo").bitwiseAND(F.lit(_signed(mask & ((1 << 64) - 1)))).alias("lo"),
                )
            )
        parts.append(numbers.where(F.col("_n").isNotNull()).select(row_id, "field", F.explode(F.array(*keys)).alias("_k")))
    if not parts:
        nothing = addresses.where(F.lit(False))
        return nothing.select(row_id, "field", F.col("ip").alias("network"))
    looked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    looked = looked.select(row_id, "field", "_k.*")
    return looked.join(table.hint("broadcast" if few else "merge"), ["version", "prefix", "hi", "lo"]).select(row_id, "field", "network")


# -- feeds as sets ------------------------------------------------------------


def aggregate_feeds(indicators: DataFrame) -> DataFrame:
    """Distinct indicators over all feeds."""
    return indicators.select("indicator_type", "value").distinct()


def feed_totals(indicators: DataFrame) -> DataFrame:
    """Distinct indicators per type."""
    return aggregate_feeds(indicators).groupBy("indicator_type").agg(F.count(F.lit(1)).alias("indicators"))


def feed_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a refresh added and removed: (change, indicator_type, value)."""
    sides = old.select("indicator_type", "value", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select("indicator_type", "value", F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    both = sides.groupBy("indicator_type", "value").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    change = F.when(F.col("o") == 0, "added").otherwise("removed")
    return both.where("o <> n").select(change.alias("change"), "indicator_type", "value")


def feed_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Indicators that both feeds hold."""
    return a.select("indicator_type", "value").intersect(b.select("indicator_type", "value"))
