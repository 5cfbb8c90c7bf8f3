"""Signature rules: compiled to columns, evaluated in one pass over the packets."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsift.functions.network import in_networks
from netsift.operators.ordering import seconds_to_micros, time_slices


class _Context:
    """Collects the per-packet flags and the rate terms of a rule set while it is compiled."""

    def __init__(self) -> None:
        self.flags: dict[str, Column] = {}
        self.rates: list[tuple[str, RateRule, Column | None, float]] = []

    def flag(self, test: Column) -> Column:
        name = f"_flag_{len(self.flags)}"
        self.flags[name] = F.coalesce(test, F.lit(False))
        return F.col(name)

    def rate(self, rule: RateRule, gate: Column | None, gate_reach: float) -> tuple[Column, float]:
        reach = rule.seconds + gate_reach
        for name, known, known_gate, known_reach in self.rates:
            same = (known.track_by, known.count, known.seconds) == (rule.track_by, rule.count, rule.seconds)
            if same and gate is None and known_gate is None:
                return F.col(name), known_reach
        name = f"_rate_{len(self.rates)}"
        self.rates.append((name, rule, gate, reach))
        return F.col(name), reach


@dataclass
class SignatureRule:
    """Base of all rules. A subclass gives ``column()``; NULL counts as no match."""

    rule_id: str
    name: str
    description: str = ""
    severity: str = "medium"

    def column(self) -> Column:
        raise NotImplementedError

    def compile(self, context: _Context, gate: Column | None, reach: float) -> tuple[Column, float]:
        return context.flag(self.column()), 0.0

    def to_dict(self) -> dict:
        base = {"rule_id": self.rule_id, "name": self.name, "description": self.description, "severity": self.severity}
        return {"type": self.kind, **base, **self.options()}

    def options(self) -> dict:
        return {}


def _sides(direction: str, src: str, dst: str) -> list[str]:
    return {"src": [src], "dst": [dst], "both": [src, dst]}.get(direction, [])


def _any(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


@dataclass
class IPRule(SignatureRule):
    """Source/destination address in a short list of addresses and networks.

    For long lists use :func:`netsift.operators.intel.match_cidr`.
    """

    ip_list: list[str] = field(default_factory=list)
    direction: str = "src"
    kind = "ip"

    def column(self) -> Column:
        sides = _sides(self.direction, "src_ip", "dst_ip")
        return _any([F.coalesce(in_networks(s, self.ip_list), F.lit(False)) for s in sides])

    def options(self) -> dict:
        return {"ip_list": list(self.ip_list), "direction": self.direction}


def parse_ports(items: Sequence) -> list[tuple[int, int]]:
    """Ports and ``a-b`` ranges as merged (first, last) pairs; bad entries are skipped."""
    spans = []
    for item in items:
        first, dash, last = str(item).strip().partition("-")
        if first.strip().isdigit() and (not dash or last.strip().isdigit()):
            spans.append((int(first), int(last) if dash else int(first)))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(s for s in spans if s[0] <= s[1]):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


@dataclass
class PortRule(SignatureRule):
    port_list: list = field(default_factory=list)
    direction: str = "dst"
    kind = "port"

    def column(self) -> Column:
        spans = parse_ports(self.port_list)
        single = [low for low, high in spans if low == high]
        tests = []
        for side in _sides(self.direction, "src_port", "dst_port"):
            port = F.col(side)
            if single:
                tests.append(port.isin(single))
            tests += [port.between(low, high) for low, high in spans if low < high]
        return _any([F.coalesce(t, F.lit(False)) for t in tests])

    def options(self) -> dict:
        spans = [str(low) if low == high else f"{low}-{high}" for low, high in parse_ports(self.port_list)]
        return {"port_list": spans, "direction": self.direction}


def _is_regex(pattern: str) -> bool:
    """Whether the engine that will run the pattern, Java's, accepts it."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (re.error, Py4JJavaError, IllegalArgumentException):
        return False
    return True


@dataclass
class PayloadRule(SignatureRule):
    patterns: list[str] = field(default_factory=list)
    case_sensitive: bool = False
    kind = "payload"

    def column(self) -> Column:
        valid = [p for p in self.patterns if _is_regex(p)]
        if not valid:
            return F.lit(False)
        either = "|".join(f"(?:{p})" for p in valid)
        return F.col("payload").rlike(either if self.case_sensitive else f"(?i){either}")

    def options(self) -> dict:
        return {"patterns": list(self.patterns), "case_sensitive": self.case_sensitive}


@dataclass
class RateRule(SignatureRule):
    """At least ``count`` packets of one key within ``seconds``, the packet itself included."""

    count: int = 1
    seconds: float = 60
    track_by: str = "ip"
    kind = "rate"

    def column(self) -> Column:
        raise ValueError("a rate rule needs rate_match, check_signatures or match_all")

    def compile(self, context: _Context, gate: Column | None, reach: float) -> tuple[Column, float]:
        if self.track_by not in ("ip", "port", "ip_port"):
            return F.lit(False), 0.0
        return context.rate(self, gate, reach)

    def options(self) -> dict:
        return {"count": self.count, "seconds": self.seconds, "track_by": self.track_by}


@dataclass
class CompositeRule(SignatureRule):
    """``and`` / ``or`` of rules, left to right.

    As evaluation stops at the first decisive rule, a rate rule counts only the
    packets that reach it.
    """

    subrules: list[SignatureRule] = field(default_factory=list)
    operator: str = "and"
    kind = "composite"

    def column(self) -> Column:
        if not self.subrules or self.operator not in ("and", "or"):
            return F.lit(False)
        terms = [F.coalesce(r.column(), F.lit(False)) for r in self.subrules]
        return reduce((lambda a, b: a & b) if self.operator == "and" else (lambda a, b: a | b), terms)

    def compile(self, context: _Context, gate: Column | None, reach: float) -> tuple[Column, float]:
        if not self.subrules or self.operator not in ("and", "or"):
            return F.lit(False), 0.0
        result, own_reach = None, 0.0
        for rule in self.subrules:
            passed = result if result is None or self.operator == "and" else ~result
            inner = gate if passed is None else (passed if gate is None else gate & passed)
            term, term_reach = rule.compile(context, inner, max(reach, own_reach))
            own_reach = max(own_reach, term_reach)
            if result is None:
                result = term
            else:
                result = (result & term) if self.operator == "and" else (result | term)
        return result, own_reach

    def options(self) -> dict:
        return {"operator": self.operator, "subrules": [r.to_dict() for r in self.subrules]}


RULE_KINDS = {r.kind: r for r in (IPRule, PortRule, PayloadRule, RateRule, CompositeRule)}


def rule_from_dict(spec: dict) -> SignatureRule | None:
    """A rule from its dictionary; an unknown type gives None."""
    values = {k: v for k, v in spec.items() if k != "type"}
    kind = RULE_KINDS.get(spec.get("type"))
    if kind is None:
        return None
    if kind is CompositeRule:
        parsed = [rule_from_dict(s) for s in values.get("subrules") or []]
        values["subrules"] = [r for r in parsed if r is not None]
    known = kind.__dataclass_fields__
    return kind(**{k: v for k, v in values.items() if k in known})


def load_rules(path: str) -> list[SignatureRule]:
    """Rules of a YAML file (``rules:`` list), read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        specs = (yaml.safe_load(f) or {}).get("rules") or []
    return [r for r in map(rule_from_dict, specs) if r is not None]


def save_rules(rules: Sequence[SignatureRule], path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"rules": [r.to_dict() for r in rules]}, f, sort_keys=False)


def _rate_flags(df: DataFrame, rates: list, ts: str) -> DataFrame:
    """Add one boolean per rate term.

    A key's packets are cut into time slices, so a busy key is many tasks.
    "At least k packets in the last n seconds" is "the packet k-1 places back is
    at most n seconds old", which costs one ``lag`` per packet however dense the
    traffic is; packets of the same instant count for each other.
    """
    used = {"src_ip", "dst_port", ts}
    for base, members in (
        ("src_ip", [r for r in rates if r[1].track_by != "port"]),
        ("dst_port", [r for r in rates if r[1].track_by == "port"]),
    ):
        if not members:
            continue
        wide = [c for c in df.columns if c not in used and not c.startswith("_")]
        cut = time_slices(df, ts, max(reach for *_, reach in members))
        cut = cut.withColumns({c: F.when(F.col("_own"), F.col(c)) for c in wide})
        # a missing address is the empty one
        cut = cut.withColumn("_src", F.coalesce("src_ip", F.lit(""))).repartition("_src" if base == "src_ip" else base, "_slice")
        for name, rule, gate, _ in members:
            keys = {"ip": ["_src"], "port": ["dst_port"], "ip_port": ["_src", "dst_port"]}[rule.track_by]
            gates = [] if gate is None else ["_gate"]
            window = Window.partitionBy(*keys, "_slice", *gates).orderBy("_us")
            kth = F.lag("_us", int(rule.count) - 1).over(window) if rule.count > 1 else F.col("_us")
            latest = F.max("_kth").over(window.rangeBetween(0, 0))
            has_key = {"ip": F.col("_src") != "", "port": F.col("dst_port").isNotNull(), "ip_port": F.lit(True)}[rule.track_by]
            passed = F.lit(True) if gate is None else F.col("_gate")
            hit = passed & has_key & (latest >= F.col("_us") - F.lit(seconds_to_micros(rule.seconds)))
            if gate is not None:
                cut = cut.withColumn("_gate", F.coalesce(gate, F.lit(False)))
            cut = cut.withColumn("_kth", kth).withColumn(name, F.coalesce(hit, F.lit(False))).drop("_gate", "_kth")
        df = cut.where("_own").drop("_us", "_slice", "_own", "_src")
    return df


def evaluate_rules(df: DataFrame, rules: Sequence[SignatureRule], ts: str = "ts") -> tuple[DataFrame, list[str]]:
    """Add one boolean column per rule; returns the frame and the column names."""
    context = _Context()
    compiled = [rule.compile(context, None, 0.0)[0] for rule in rules]
    names = [f"_m_{i}" for i in range(len(rules))]
    flagged = df.withColumns(context.flags) if context.flags else df
    flagged = _rate_flags(flagged, context.rates, ts)
    flagged = flagged.withColumns(dict(zip(names, compiled, strict=True)))
    return flagged.drop(*context.flags, *[r[0] for r in context.rates]), names


def _match(rule: SignatureRule) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        F.lit(rule.description).alias("rule_description"),
        F.lit(rule.severity).alias("severity"),
    )


_MATCH_FIELDS = ["rule_id", "rule_name", "rule_description", "severity"]


def check_signatures(df: DataFrame, rules: Sequence[SignatureRule], ts: str = "ts") -> DataFrame:
    """The first rule, in list order, that each packet matches; other packets are left out."""
    flagged, names = evaluate_rules(df, rules, ts)
    first = F.coalesce(*[F.when(F.col(n), _match(r)) for n, r in zip(names, rules, strict=True)])
    found = flagged.withColumn("_match", first).where(F.col("_match").isNotNull())
    return found.select(*df.columns, *[F.col(f"_match.{f}").alias(f) for f in _MATCH_FIELDS])


def match_all(df: DataFrame, rules: Sequence[SignatureRule], ts: str = "ts") -> DataFrame:
    """One row per packet and matching rule."""
    flagged, names = evaluate_rules(df, rules, ts)
    hits = F.array_compact(F.array(*[F.when(F.col(n), _match(r)) for n, r in zip(names, rules, strict=True)]))
    found = flagged.withColumn("_match", F.explode(hits))
    return found.select(*df.columns, *[F.col(f"_match.{f}").alias(f) for f in _MATCH_FIELDS])


def rate_match(
    df: DataFrame, track_by: str, count: int, seconds: float, ts: str = "ts", name: str = "rate_match"
) -> DataFrame:
    """Add a boolean: the packet completes ``count`` packets of its key in ``seconds``."""
    flagged, (column,) = evaluate_rules(df, [RateRule("rate", "rate", count=count, seconds=seconds, track_by=track_by)], ts)
    return flagged.withColumnRenamed(column, name)


# The default rule set.
DEFAULT_RULES = [
    {
        "type": "rate",
        "rule_id": "RATE-001",
        "name": "SSH Brute Force Attempt",
        "description": "Detects multiple SSH connection attempts",
        "severity": "high",
        "count": 5,
        "seconds": 60,
        "track_by": "ip_port",
    },
    {
        "type": "rate",
        "rule_id": "RATE-002",
        "name": "Port Scan Detected",
        "description": "Detects port scanning activity",
        "severity": "medium",
        "count": 15,
        "seconds": 5,
        "track_by": "ip",
    },
    {
        "type": "rate",
        "rule_id": "RATE-003",
        "name": "FTP Brute Force Attempt",
        "description": "Detects multiple FTP connection attempts",
        "severity": "high",
        "count": 5,
        "seconds": 60,
        "track_by": "ip_port",
    },
    {
        "type": "ip",
        "rule_id": "IP-001",
        "name": "Known Malicious IP",
        "description": "Detects traffic from known malicious IP addresses",
        "severity": "high",
        "ip_list": ["185.216.35.0/24", "192.99.142.0/24"],
        "direction": "src",
    },
    {
        "type": "ip",
        "rule_id": "IP-002",
        "name": "Tor Exit Node",
        "description": "Detects traffic from Tor exit nodes",
        "severity": "medium",
        "ip_list": ["109.70.100.0/24", "171.25.193.0/24"],
        "direction": "src",
    },
    {
        "type": "payload",
        "rule_id": "PAYLOAD-001",
        "name": "SQL Injection Attempt",
        "description": "Detects common SQL injection patterns",
        "severity": "critical",
        "patterns": ["union\\s+select", "select.*from", "or\\s+1=1", "drop\\s+table", "admin'--", ";\\s*exec"],
        "case_sensitive": False,
    },
    {
        "type": "payload",
        "rule_id": "PAYLOAD-002",
        "name": "Command Injection Attempt",
        "description": "Detects common command injection patterns",
        "severity": "critical",
        "patterns": [
            ";\\s*(?:rm|nc|wget|curl|bash|sh|chmod|python)",
            "[|;&]\\s*(?:cat|nc|wget|curl|bash|sh|chmod|python)",
            "/bin/(?:bash|sh|nc)",
        ],
        "case_sensitive": False,
    },
    {
        "type": "payload",
        "rule_id": "PAYLOAD-003",
        "name": "XSS Attempt",
        "description": "Detects common XSS patterns",
        "severity": "high",
        "patterns": [
            "<script>",
            "javascript:",
            "onerror=",
            "onload=",
            "onclick=",
            "ondblclick=",
            "document\\.cookie",
        ],
        "case_sensitive": False,
    },
    {
        "type": "port",
        "rule_id": "PORT-001",
        "name": "Suspicious Port Access",
        "description": "Detects access to commonly exploited services",
        "severity": "medium",
        "port_list": ["21", "22", "23", "445", "1433", "3306", "3389"],
        "direction": "dst",
    },
    {
        "type": "composite",
        "rule_id": "COMP-001",
        "name": "DNS Tunneling",
        "description": "Detects potential DNS tunneling",
        "severity": "high",
        "operator": "and",
        "subrules": [
            {
                "type": "port",
                "rule_id": "PORT-002",
                "name": "DNS Port",
                "description": "DNS port traffic",
                "severity": "low",
                "port_list": ["53"],
                "direction": "dst",
            },
            {
                "type": "rate",
                "rule_id": "RATE-004",
                "name": "High DNS Query Rate",
                "description": "Abnormally high rate of DNS queries",
                "severity": "medium",
                "count": 30,
                "seconds": 60,
                "track_by": "ip",
            },
        ],
    },
]


def default_rules() -> list[SignatureRule]:
    return [rule_from_dict(spec) for spec in DEFAULT_RULES]
