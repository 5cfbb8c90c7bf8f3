"""Packet and address expressions. All are native columns."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.schemas import FLAG_NAMES

# TCP flag bits (RFC 793).
TCP_FLAG_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}

# Service ports counted as common.
COMMON_PORTS = [80, 443, 22, 21, 25, 53, 110, 143, 3306, 3389, 1433, 8080]

# Private and reserved networks (IANA special-purpose registries).
PRIVATE_NETWORKS = [
    "0.0.0.0/8",
    "10.0.0.0/8",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/29",
    "192.0.0.170/31",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
    "::/128",
    "::1/128",
    "::ffff:0:0/96",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
]

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = f"^{_OCTET}([.]{_OCTET}){{3}}$"
_V6_GROUPS = "^([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*)?$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_tcp_flags(flags: str | Column) -> Column:
    """Hexadecimal flag byte (``0x12`` or ``12``) to a struct of six booleans."""
    bits = F.conv(F.regexp_replace(_col(flags), "^0[xX]", ""), 16, 10).cast("int")
    return F.struct(*[(bits.bitwiseAND(F.lit(TCP_FLAG_BITS[f])) > 0).alias(f) for f in FLAG_NAMES])


def decode_payload(raw: str | Column) -> Column:
    """Bytes to text (invalid UTF-8 replaced) with the byte count."""
    raw = _col(raw)
    return F.struct(
        F.make_valid_utf8(raw.cast("string")).alias("payload"), F.octet_length(raw).alias("payload_len")
    )


def nest_flags(df: DataFrame) -> DataFrame:
    """Gather flat boolean columns syn..urg into the ``tcp_flags`` struct."""
    known = F.coalesce(*FLAG_NAMES).isNotNull()
    nested = F.when(known, F.struct(*[F.col(f).alias(f) for f in FLAG_NAMES]))
    return df.withColumn("tcp_flags", nested).drop(*FLAG_NAMES)


def packet_features(df: DataFrame) -> DataFrame:
    """Per-packet features: sizes default to 0, flags as 0/1 for TCP only."""
    is_tcp = (F.col("protocol") == "TCP") & F.col("tcp_flags").isNotNull()
    flags = [
        F.when(is_tcp, F.coalesce(F.col(f"tcp_flags.{f}"), F.lit(False)).cast("int")).alias(f"tcp_{f}")
        for f in FLAG_NAMES
    ]
    keep = [c for c in ["packet_id", "ts", "protocol"] if c in df.columns]
    return df.select(
        *keep,
        F.coalesce("length", F.lit(0)).alias("length"),
        F.coalesce("payload_len", F.lit(0)).alias("payload_len"),
        "ttl",
        "src_port",
        "dst_port",
        *flags,
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times in ``body`` but compute it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ip_to_long(ip: str | Column) -> Column:
    """IPv4 text to its number; NULL when it is not a valid IPv4 address."""
    ip = _col(ip)
    octets = F.split(ip, "[.]")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.try_cast("long"))
    return F.when(ip.rlike(IPV4_PATTERN), number)


def ip_number(ip: str | Column) -> Column:
    """As :func:`ip_to_long`, with 0 for anything that is not an IPv4 address."""
    return F.coalesce(ip_to_long(ip), F.lit(0).cast("long"))


def ipv6_to_longs(ip: str | Column) -> Column:
    """IPv6 text to a struct of two longs (``hi``, ``lo``); NULL when invalid."""
    ip = _col(ip)

    def with_tail(tail: Column) -> Column:
        # an IPv4 tail (::ffff:1.2.3.4) is rewritten as two groups
        groups = let(
            ip_to_long(tail),
            lambda n: F.concat(F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(F.lit(65535)))),
        )
        return F.when(tail == "", ip).otherwise(F.concat(F.left(ip, F.length(ip) - F.length(tail)), groups))

    def groups_of(side: Column) -> Column:
        return F.when(F.coalesce(side, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def full(sides: Column) -> Column:
        def join(pair: Column) -> Column:
            missing = F.lit(8) - F.size(pair["left"]) - F.size(pair["right"])
            shape = F.when(F.size(sides) == 2, missing >= 1).otherwise((F.size(sides) == 1) & (missing == 0))
            padded = F.concat(pair["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), pair["right"])
            return F.when(shape & F.forall(sides, lambda x: x.rlike(_V6_GROUPS)), padded)

        pair = F.struct(
            groups_of(F.get(sides, F.lit(0))).alias("left"), groups_of(F.get(sides, F.lit(1))).alias("right")
        )
        return let(pair, join)

    def half(groups: Column, start: int) -> Column:
        return F.aggregate(
            F.slice(groups, start, 4),
            F.lit(0).cast("long"),
            lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(F.conv(g, 16, 10).try_cast("long")),
        )

    tail = F.regexp_extract(ip, "([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+)$", 1)
    text = let(tail, with_tail)
    groups = let(F.split(text, "::", -1), full)
    longs = let(groups, lambda g: F.when(g.isNotNull(), F.struct(half(g, 1).alias("hi"), half(g, 5).alias("lo"))))
    return F.when(ip.contains(":"), longs)


def ip_key(ip: str | Column) -> Column:
    """Text that sorts as the addresses do: the family, then 32 hex digits; NULL for anything else."""

    def digits(x: Column) -> Column:
        return F.lpad(F.hex(x), 16, "0")

    wide = let(ipv6_to_longs(ip), lambda a: F.concat(F.lit("6"), digits(a["hi"]), digits(a["lo"])))
    return F.coalesce(F.concat(F.lit("4"), F.lit("0" * 16), digits(ip_to_long(ip))), wide)


def ip_value(ip: str | Column) -> Column:
    """The number of an IPv4 or IPv6 address as a double (exact below 2^53); 0 for anything else."""

    def unsigned(x: Column) -> Column:
        return x.cast("double") + F.when(x < 0, float(1 << 64)).otherwise(0.0)

    wide = let(ipv6_to_longs(ip), lambda a: unsigned(a["hi"]) * float(1 << 64) + unsigned(a["lo"]))
    return F.coalesce(ip_to_long(ip).cast("double"), wide, F.lit(0.0))


def is_ip(ip: str | Column) -> Column:
    """True for valid IPv4 or IPv6 text."""
    ip = _col(ip)
    return F.coalesce(ip.rlike(IPV4_PATTERN) | ipv6_to_longs(ip).isNotNull(), F.lit(False))


def parse_networks(networks: Sequence[str]) -> list:
    """Valid networks of a list; host bits are masked, bad entries skipped."""
    parsed = []
    for text in networks:
        try:
            parsed.append(ipaddress.ip_network(str(text).strip(), strict=False))
        except ValueError:
            continue
    return parsed


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= (1 << 63) else number


def in_networks(ip: str | Column, networks: Sequence[str]) -> Column:
    """Whether an address lies in any of a short list of networks; bad text gives NULL."""
    ip = _col(ip)
    parsed = parse_networks(networks)
    number = ip_to_long(ip)
    v4 = [number.between(int(n.network_address), int(n.broadcast_address)) for n in parsed if n.version == 4]
    # NULL, not false, when the text is not an IPv4 address
    hit4 = reduce(lambda a, b: a | b, v4, number < 0)
    v6 = [n for n in parsed if n.version == 6]

    def hit6(longs: Column) -> Column:
        tests = []
        for n in v6:
            mask, base, low = int(n.netmask), int(n.network_address), (1 << 64) - 1
            hi = longs["hi"].bitwiseAND(F.lit(_signed(mask >> 64))) == F.lit(_signed(base >> 64))
            lo = longs["lo"].bitwiseAND(F.lit(_signed(mask & low))) == F.lit(_signed(base & low))
            tests.append(hi & lo)
        return F.when(longs.isNotNull(), reduce(lambda a, b: a | b, tests, F.lit(False)))

    return F.coalesce(hit4, F.when(ip.contains(":"), let(ipv6_to_longs(ip), hit6)))


def is_private_ip(ip: str | Column) -> Column:
    """Private or reserved address; NULL when the text is not an address."""
    return in_networks(ip, PRIVATE_NETWORKS)


def is_well_known_port(port: str | Column) -> Column:
    port = F.coalesce(_col(port), F.lit(0))
    return (port > 0) & (port < 1024)


def is_common_port(port: str | Column) -> Column:
    return F.coalesce(_col(port), F.lit(0)).isin(COMMON_PORTS)


def port_flags(port: str | Column) -> Column:
    """Struct of 0/1: ``well_known`` and ``common``."""
    return F.struct(
        is_well_known_port(port).cast("int").alias("well_known"), is_common_port(port).cast("int").alias("common")
    )


def safe_ratio(numerator: str | Column, denominator: str | Column, default: float = 0.0) -> Column:
    """Ratio as a double; ``default`` unless the denominator is above 0."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(d > 0, n / d).otherwise(F.lit(float(default)))


def byte_features(raw: str | Column, size: int = 16) -> Column:
    """Payload length, then bytes 1..size-1 scaled to 0..1 (missing bytes 0)."""
    raw = _col(raw)
    digits = F.hex(raw)

    def value(i: Column) -> Column:
        byte = F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("double")
        return F.when(i < F.octet_length(raw), byte / F.lit(255.0)).otherwise(F.lit(0.0))

    scaled = F.transform(F.sequence(F.lit(1), F.lit(size - 1)), value)
    return F.concat(F.array(F.octet_length(raw).cast("double")), scaled)
