import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsift.functions.network import in_networks, ipv6_to_longs, is_private_ip
from netsift.operators import flows
from netsift.operators import intel as I
from netsift.operators import rules as R

START = dt.datetime(2024, 1, 1)
SCHEMA = (
    "packet_id long, ts timestamp, protocol string, src_ip string, dst_ip string, src_port int, dst_port int, payload string, "
    "length int, tcp_flags struct<syn:boolean,ack:boolean,fin:boolean,rst:boolean,psh:boolean,urg:boolean>"
)


def packets(spark, rows):
    """rows: (seconds, src_ip, dst_port[, payload])."""
    flags = (True, False, False, False, False, False)
    data = [
        (i, START + dt.timedelta(seconds=r[0]), "TCP", r[1], "10.9.9.9", 5000, r[2], r[3] if len(r) > 3 else None, 100, flags)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_demo_packet_matches_in_order(spark):
    df = packets(spark, [(0, "192.99.142.10", 22)])
    assert [r.rule_id for r in R.check_signatures(df, R.default_rules()).collect()] == ["IP-001"]
    assert sorted(r.rule_id for r in R.match_all(df, R.default_rules()).collect()) == ["IP-001", "PORT-001"]


def test_rate_counts_the_fifth_packet(spark):
    df = packets(spark, [(s, "1.1.1.1", 22) for s in (0, 10, 20, 30, 40, 101)])
    got = {r.packet_id: r.rate_match for r in R.rate_match(df, "ip_port", 5, 60).collect()}
    assert [i for i, m in got.items() if m] == [4]


def test_rate_window_is_inclusive_and_peers_count(spark):
    df = packets(spark, [(0, "1.1.1.1", 22), (60, "1.1.1.1", 22), (200, "2.2.2.2", 1), (200, "2.2.2.2", 1)])
    got = {r.packet_id: r.rate_match for r in R.rate_match(df, "ip", 2, 60).collect()}
    assert got == {0: False, 1: True, 2: True, 3: True}


def brute_rates(rows, key, count, seconds, gate=lambda r: True):
    out = []
    for i, r in enumerate(rows):
        n = sum(1 for q in rows if gate(q) and key(q) == key(r) and r[0] - seconds <= q[0] <= r[0])
        out.append(gate(r) and key(r) not in (None, "") and n >= count)
    return out


def test_rates_and_composites_equal_brute_force(spark):
    rng = random.Random(5)
    # one address sends most packets
    ips, texts = ["9.9.9.9"] * 6 + ["1.1.1.1", "", None], ["a", "select b from c"]
    rows = [(rng.randint(0, 3000) / 2, rng.choice(ips), rng.choice([22, 53, None]), rng.choice(texts)) for _ in range(400)]
    df = packets(spark, rows)
    sql = R.PayloadRule("t", "t", patterns=["select.*from"])
    dns = R.PortRule("p", "p", port_list=[53])
    rules = [
        R.RateRule("a", "a", count=5, seconds=20),
        R.RateRule("b", "b", count=4, seconds=20, track_by="port"),
        R.RateRule("c", "c", count=3, seconds=15, track_by="ip_port"),
        R.CompositeRule("d", "d", subrules=[sql, R.RateRule("r", "r", count=3, seconds=30)]),
        R.CompositeRule("e", "e", operator="or", subrules=[dns, R.RateRule("r", "r", count=3, seconds=30)]),
        R.CompositeRule("f", "f", subrules=[R.RateRule("r", "r", count=4, seconds=20), R.RateRule("s", "s", count=2, seconds=10)]),
    ]
    flagged, names = R.evaluate_rules(df, rules)
    got = {r.packet_id: [r[n] for n in names] for r in flagged.collect()}
    has_sql, has_dns = (lambda r: "select" in r[3]), (lambda r: r[2] == 53)
    a = brute_rates(rows, lambda r: r[1], 5, 20)
    b = brute_rates(rows, lambda r: r[2], 4, 20)
    c = brute_rates(rows, lambda r: (r[1] or "", r[2]), 3, 15)
    d = brute_rates(rows, lambda r: r[1], 3, 30, has_sql)
    e = [has_dns(r) or x for r, x in zip(rows, brute_rates(rows, lambda r: r[1], 3, 30, lambda q: not has_dns(q)), strict=True)]
    first = dict(zip(map(id, rows), brute_rates(rows, lambda r: r[1], 4, 20), strict=True))
    f = brute_rates(rows, lambda r: r[1], 2, 10, lambda q: first[id(q)])
    want = {i: list(x) for i, x in enumerate(zip(a, b, c, d, e, f, strict=True))}
    assert got == want


def test_empty_and_unknown_composites_never_match(spark):
    df = packets(spark, [(0, "1.1.1.1", 22)])
    rules = [R.CompositeRule("x", "x"), R.CompositeRule("y", "y", operator="xor", subrules=[R.PortRule("p", "p", port_list=[22])])]
    assert R.match_all(df, rules).count() == 0


class LongPayload(R.SignatureRule):
    kind = "long"

    def column(self):
        return F.length("payload") > 3


def test_rules_of_the_user(spark):
    df = packets(spark, [(0, "1.1.1.1", 1, "abcdef"), (1, "1.1.1.1", 1, "ab"), (2, "1.1.1.1", 1)])
    rules = [LongPayload("L", "long"), R.CompositeRule("C", "c", subrules=[LongPayload("L", "long"), R.RateRule("r", "r", count=1, seconds=5)])]
    assert sorted((r.packet_id, r.rule_id) for r in R.match_all(df, rules).collect()) == [(0, "C"), (0, "L")]


def test_rules_round_trip(tmp_path):
    path = str(tmp_path / "rules.yaml")
    R.save_rules(R.default_rules(), path)
    assert [r.to_dict() for r in R.load_rules(path)] == [r.to_dict() for r in R.default_rules()]
    with open(path, "a", encoding="utf-8") as f:
        f.write("- type: unknown\n  rule_id: Z\n")
    assert len(R.load_rules(path)) == 10


def test_ports_are_merged():
    assert R.parse_ports([1, "2", "3", 7, "9-10", "x", "5-"]) == [(1, 3), (7, 7), (9, 10)]
    assert R.PortRule("p", "p", port_list=[1, 2, 3, 7]).options()["port_list"] == ["1-3", "7"]


@pytest.mark.parametrize(
    ("ip", "private"),
    [("2001:db8::1", True), ("::1", True), ("bad", None), ("8.8.8.8", False), ("172.31.1.1", True), ("172.32.1.1", False), ("2606:4700::1", False)],
)
def test_private_addresses(spark, ip, private):
    df = spark.createDataFrame([(ip,)], "ip string")
    assert df.select(is_private_ip("ip").alias("p")).first().p is private


def test_ipv6_networks(spark):
    df = spark.createDataFrame([("2001:db8:1::5",), ("2001:db9::1",), ("1.2.3.4",), ("1:2",)], "ip string")
    got = [r.m for r in df.select(in_networks("ip", ["2001:db8::/32", "1.2.0.0/16"]).alias("m")).collect()]
    assert got == [True, False, True, None]
    assert df.select(ipv6_to_longs("ip").alias("v")).collect()[3].v is None


def test_match_cidr_with_both_versions(spark):
    df = packets(spark, [(0, "10.1.2.3", 1), (1, "2001:db8::9", 1), (2, "bad", 1)])
    nets = spark.createDataFrame([("10.0.0.0/8",), ("10.1.2.3",), ("10.1.2.99/24",), ("2001:db8::/32",), ("::/0",), ("10.0.0.0/40",), ("x",), ("0.0.0.0/0",)], "network string")
    got = sorted((r.packet_id, r.network) for r in I.match_cidr(df, nets).collect())
    assert got == [
        (0, "0.0.0.0/0"), (0, "10.0.0.0/8"), (0, "10.1.2.3"), (0, "10.1.2.99/24"), (1, "2001:db8::/32"), (1, "::/0")
    ]


def test_trailing_features_of_a_dense_key(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 1600) / 4, rng.choice(["9.9.9.9", "8.8.8.8", "", None]), rng.choice([22, 53, 0, None])) for _ in range(300)]
    df = packets(spark, rows).withColumn("length", (F.col("packet_id") % 37 + 1).cast("int"))
    got = {r.packet_id: r for r in flows.trailing_features(df, 60, ["protocol"], "packet_id").collect()}
    assert len(got) == 300
    for i, r in enumerate(rows):
        near = [(j, q) for j, q in enumerate(rows) if r[0] - 60 <= q[0] <= r[0]]
        sizes = [j % 37 + 1 for j, _ in near]
        g = got[i]
        assert (g.packet_count, g.min_packet_size, g.max_packet_size) == (len(near), min(sizes), max(sizes))
        mean = sum(sizes) / len(sizes)
        assert abs(g.avg_packet_size - mean) < 1e-9
        assert abs(g.std_packet_size - (sum((s - mean) ** 2 for s in sizes) / len(sizes)) ** 0.5) < 1e-6
        assert g.unique_src_ips == len({q[1] for _, q in near if q[1]})
        assert g.unique_dst_ports == len({q[2] for _, q in near if q[2]})
        assert g.unique_dst_ips == 1 and g.tcp_syn_ratio == 1.0


@pytest.mark.parametrize("most", [50_000, 0])
def test_match_cidr_broadcasts_no_addresses(spark, monkeypatch, most):
    monkeypatch.setattr(I, "BROADCAST_NETWORKS", most)
    df = packets(spark, [(i, f"10.0.{i}.1", 1) for i in range(20)])
    nets = spark.createDataFrame([(f"10.0.{i}.0/{24 + i % 3}",) for i in range(0, 200)], "network string")
    found = I.match_cidr(df, nets)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the list is the larger side here, and the planner would broadcast the packets' side
    assert ("BuildRight" in plan) == bool(most) and "BuildLeft" not in plan
    assert sorted((r.packet_id, r.network) for r in found.collect()) == [(i, f"10.0.{i}.0/{24 + i % 3}") for i in range(20)]


def test_a_dense_block_of_trailing_features_is_one_pass_of_numbers():
    """Against brute force: ties in time, null values, windows that reach into the block before, a repeated id."""
    rng = np.random.default_rng(5)
    n, span = 300, 50
    rows = pd.DataFrame({"_id": np.arange(n), "_no_id": False, "_us": rng.integers(0, 100, n), "_len": rng.integers(-5, 90, n), "_f": rng.integers(0, 2, n)})
    rows["_own"] = rows["_us"] >= 50
    for name in flows.UNIQUES:
        rows[f"_u_{name}"] = pd.Series([None if v == 0 else str(v) for v in rng.integers(0, 9, n)], dtype=object)
    got = flows._trailing_block(rows, span, ["_len", "_f"]).set_index("_id")
    assert len(got) == rows["_own"].sum()
    for row in rows[rows["_own"]].itertuples():
        now = rows.at[row.Index, "_us"]
        seen = rows[(rows["_us"] >= now - span) & (rows["_us"] <= now)]
        one = got.loc[row.Index]
        assert (one["_n"], one["_len"], one["_f"]) == (len(seen), seen["_len"].sum(), seen["_f"].sum())
        assert (one["min_packet_size"], one["max_packet_size"]) == (seen["_len"].min(), seen["_len"].max())
        assert [one[u] for u in flows.UNIQUES] == [seen[f"_u_{u}"].nunique() for u in flows.UNIQUES]
    first = rows[rows["_own"]].index[:2]
    rows.loc[first, "_id"] = -1
    assert len(flows._trailing_block(rows, span, ["_len"])) == rows["_own"].sum() - 1
    assert flows._trailing_block(rows[~rows["_own"]], span, ["_len"]).empty
