"""Streams that chain state, committed files, tree scans and the sweep of ranges and addresses."""

import datetime as dt
import json
import os
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F

from netsift.operators import enrich as E
from netsift.operators import evaluation as V
from netsift.operators import rules as R
from netsift.operators.ordering import carry_last
from netsift.plans import live
from netsift.sources import committed as C
from netsift.sources.packets import read_packets
from netsift.streaming import packets as P
from netsift.streaming import stateful as W

START = dt.datetime(2024, 1, 1)
DATA = "/root/testdata/sf0.001"


def write_files(folder, files):
    """Packets ``(id, second, src, port, payload)``, one file per batch, in order of age."""
    folder.mkdir(exist_ok=True)
    for n, rows in enumerate(files):
        file = folder / f"part-{n}.json"
        lines = [
            {"packet_id": i, "timestamp": (START + dt.timedelta(seconds=s)).isoformat(), "protocol": "TCP", "src_ip": src, "dst_ip": "10.9.9.9", "src_port": 4000, "dst_port": port, "payload": payload, "length": 60}
            for i, s, src, port, payload in rows
        ]
        file.write_text("\n".join(map(json.dumps, lines)))
        os.utime(file, (time.time() + n - 100, time.time() + n - 100))
    return str(folder)


def busy_files(seed, per_batch=60):
    """Batches in time order; 90 % of the packets have one address; the last batch only moves the watermark."""
    rng, files, at, number = random.Random(seed), [], 0.0, 0
    for _ in range(3):
        rows = []
        for _ in range(per_batch):
            at += rng.choice([0, 0, 0.5, 1, 9])
            number += 1
            src = "10.0.0.1" if rng.random() < 0.9 else rng.choice(["10.0.0.2", "10.0.0.3", None])
            rows.append((number, round(at, 3), src, rng.choice([22, 53, 80, None]), rng.choice(["x", "id=1 union  select y", None])))
        files.append(rows)
    return [*files, [(None, at + 86400, "10.7.7.7", 1, "end")]]


def run(own, stream, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return own.table(name)


@pytest.fixture
def rocks(spark):
    own = live.stream_session(spark)
    W.use_rocksdb(own)
    return own


@pytest.mark.parametrize(("track_by", "count", "seconds"), [("ip", 3, 2), ("ip_port", 2, 5), ("port", 6, 0), ("ip", 1, 1)])
def test_rate_stream_on_rocksdb_equals_batch(rocks, tmp_path, track_by, count, seconds):
    path = write_files(tmp_path / "in", busy_files(1))
    stream = P.packet_stream(rocks, path, "1 second", max_files=1).where("packet_id IS NOT NULL")
    got = run(rocks, W.rate_stream(stream, track_by, count, seconds), tmp_path, f"rates_{track_by}_{count}")
    batch = R.rate_match(read_packets(rocks, path).where("packet_id IS NOT NULL"), track_by, count, seconds).where("rate_match")
    assert sorted(r.packet_id for r in got.collect()) == sorted(r.packet_id for r in batch.collect())
    assert got.count() or count == 6


def test_a_busy_key_sends_few_rows_to_its_state(spark):
    rows = [("busy", k, k * 1000) for k in range(20_000)] + [(f"k{k % 50}", 20_000 + k, k * 1000) for k in range(2000)]
    narrow = spark.createDataFrame(rows, "track_key string, packet_id long, us long").coalesce(1)
    marked = W.thin_busy_keys(narrow, 4, 1_000_000).collect()
    sent = [r for r in marked if r.track_key == "busy" and (r.counted or not r.sure)]
    batches = len({r.packet_id // 10_000 for r in sent}) + 2
    # 20 seconds of 1000 packets: at most twice the count per second and batch of rows
    assert len(marked) == 22_000 and len(sent) <= 2 * 4 * (20 + batches) and sum(r.sure for r in marked if r.track_key == "busy") > 19_900


def test_the_state_of_a_busy_key_is_bounded(rocks, tmp_path):
    path = write_files(tmp_path / "in", busy_files(2, per_batch=400)[:-1])
    stream = P.packet_stream(rocks, path, "1 second", max_files=1)
    run(rocks, W.rate_stream(stream, "ip", 5, 600), tmp_path, "bounded")
    state = rocks.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "cp-bounded"))
    kept = state.select(F.size("list_value").alias("n")) if "list_value" in state.columns else state.groupBy("key").agg(F.count("*").alias("n"))
    assert 0 < max(r.n for r in kept.collect()) <= 4


RULES = [
    R.CompositeRule("C", "dns", severity="high", subrules=[R.PortRule("p", "p", port_list=[53]), R.RateRule("r", "r", count=3, seconds=4)]),
    R.PayloadRule("T", "sql", description="sql text", patterns=["union\\s+select"], severity="critical"),
    R.RateRule("R", "many", count=4, seconds=2, track_by="ip"),
    R.PortRule("P", "ssh", port_list=[22], severity="low"),
]


@pytest.mark.parametrize("chosen", [[0, 1, 2, 3], [1, 3], [3, 2], [2]])
def test_detect_stream_gives_the_first_match_of_each_packet(spark, tmp_path, chosen):
    own = live.stream_session(spark)
    rules = [RULES[k] for k in chosen]
    path = write_files(tmp_path / "in", busy_files(3))
    name = "first_" + "".join(map(str, chosen))
    got = run(own, W.detect_stream(P.packet_stream(own, path, "1 second", max_files=1), rules), tmp_path, name)
    want = R.check_signatures(read_packets(own, path), rules).where("packet_id IS NOT NULL").collect()
    fields = lambda r: (r.packet_id, r.rule_id, r.rule_name, r.rule_description, r.severity)
    found = got.where("packet_id IS NOT NULL").collect()
    assert sorted(map(fields, found)) == sorted(map(fields, want)) and want
    envelope = {r.packet_id: (r.timestamp, r.type, r.packet.src_ip, r.packet.dst_port, r.packet.payload, r.data.rule_id) for r in found}
    assert envelope == {r.packet_id: (r.ts, "signature", r.src_ip, r.dst_port, r.payload, r.rule_id) for r in want}


def test_all_rate_rules_share_one_step_and_repeated_packets_all_count(spark, tmp_path):
    own = live.stream_session(spark)
    *files, last = busy_files(5)
    path = write_files(tmp_path / "in", [[row for row in rows for _ in range(1 + row[0] % 2)] for rows in files] + [last])
    stream = W.detect_stream(P.packet_stream(own, path, "1 second", max_files=1), RULES)
    query = stream.writeStream.format("memory").queryName("one_step").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    # the rate rules, and their hits with the packets
    assert max(len(p["stateOperators"]) for p in query.recentProgress) == 2
    found, batch = (sorted((r.packet_id, r.rule_id) for r in df.where("packet_id IS NOT NULL").collect()) for df in (own.table("one_step"), R.check_signatures(read_packets(own, path), RULES)))
    assert found == batch and len(found) > len(set(found))


def test_a_batch_is_committed_once(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3)], "id string, n int")
    for batch in (0, 0, 1):
        C.write_batch(alerts, path, batch)
    C.write_batch(alerts.limit(0), path, 2)
    got = sorted(tuple(r) for r in C.read_committed(spark, path, alerts.schema).collect())
    assert got == [(b, i, n) for b in ("0", "1") for i, n in (("a", 1), ("b", 2), ("c", 3))]
    assert [c["batch_id"] for c in C.commits(path)] == ["0", "1", "2"]
    assert len(os.listdir(tmp_path / "alerts" / "data")) == sum(len(c["files"]) for c in C.commits(path))


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "alerts")

    def broken(frames):
        for frame in frames:
            yield frame
            raise OSError("lost")

    alerts = spark.createDataFrame([(str(k), k) for k in range(20)], "id string, n int")
    with pytest.raises(Exception, match="lost"):
        C.write_batch(alerts.mapInPandas(broken, alerts.schema), path, 7)
    assert C.commits(path) == [] and C.read_committed(spark, path, alerts.schema).count() == 0
    C.write_batch(alerts, path, 7)
    assert C.read_committed(spark, path, alerts.schema).count() == 20


def test_a_stream_commits_each_batch(spark, tmp_path):
    source = write_files(tmp_path / "in", busy_files(4))
    alerts = R.check_signatures(P.packet_stream(spark, source, max_files=1), RULES[3:])
    path = str(tmp_path / "out")
    for _ in range(2):
        C.write_stream(alerts, path, str(tmp_path / "cp"), "packet_id").awaitTermination(120)
    want = R.check_signatures(read_packets(spark, source), RULES[3:])
    got = C.read_committed(spark, path, alerts.schema)
    assert sorted(r.packet_id for r in got.collect()) == sorted(r.packet_id for r in want.collect()) and want.count()
    assert {r.batch_id for r in got.collect()} <= {"0", "1", "2", "3"}


def plain_matching(alerts, events, window):
    used, pairs = set(), []
    for a in range(len(alerts)):
        for e in range(len(events)):
            if e not in used and abs(alerts[a] - events[e]) <= window:
                used.add(e)
                pairs.append((a, e))
                break
    return pairs


@pytest.mark.parametrize("fan", [2, 3])
def test_matching_composes_slices_in_a_tree(spark, fan):
    rng = random.Random(fan)
    for n, m, span, window in ((150, 140, 500, 4), (60, 200, 300, 6), (200, 60, 300, 6), (90, 90, 30_000, 5)):
        # dense logs have no gap at which the matching starts anew
        alerts, events = sorted(rng.randint(-span, span) for _ in range(n)), sorted(rng.randint(-span, span) for _ in range(m))
        frames = [spark.createDataFrame([(i, START + dt.timedelta(seconds=t)) for i, t in enumerate(times)], f"{name} long, ts timestamp") for name, times in (("alert_id", alerts), ("event_id", events))]
        got = V.match_alerts(*frames, window, slice_seconds=2 * window, fan=fan)
        assert sorted((r.alert_id, r.event_id) for r in got.collect()) == plain_matching(alerts, events, window), (n, m, span)
    assert V.match_alerts(frames[0].limit(0), frames[1].limit(0), 5, fan=fan).count() == 0


def test_the_last_value_is_carried_over_the_ranges(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(400), rng.choice([None, None, None, f"v{k}"])) for k in range(300)]
    got = {r.i: r.held for r in carry_last(spark.createDataFrame(rows, "i int, at int, v string"), ["at", "i"], "v", "held").collect()}
    held, want = None, {}
    for i, _, v in sorted(rows, key=lambda r: (r[1], r[0])):
        held = v if v is not None else held
        want[i] = held
    assert got == want


def test_locations_of_both_families(spark):
    geo = spark.createDataFrame(
        [("2a00:1::", "2a00:1:0:ffff:ffff:ffff:ffff:ffff", "A"), ("2a00:1:1::", "2a00:1:1::", "B"), ("8.8.0.0", "8.8.255.255", "C"), ("bad", "9.9.9.9", "D"), ("ffff::", "ffff:ffff::", "E")],
        "lo string, hi string, country_code string",
    )
    ips = ["2a00:1::5", "2a00:1:0:ffff::1", "2a00:1:1::", "2a00:1:1::1", "2a00:0::", "8.8.8.8", "8.9.0.0", "8.7.255.255", "::ffff:8.8.8.8", "10.0.0.1", "fd00::1", "no", None, "FFFF:0001::"]
    got = {r.ip: r.country_code for r in E.locate(spark.createDataFrame([(i,) for i in ips], "ip string"), geo).collect()}
    public = {"2a00:1::5": "A", "2a00:1:0:ffff::1": "A", "2a00:1:1::": "B", "8.8.8.8": "C", "FFFF:0001::": "E"}
    assert {k: v for k, v in got.items() if v != "**"} == public and {"10.0.0.1", "fd00::1"} <= set(got)
    # one wide range and many narrow ones: still one row per address
    wide = spark.createDataFrame([(0, 2**31, "W")] + [(2**31 + 2 * k, 2**31 + 2 * k, "N") for k in range(1, 2000)], "lo long, hi long, country_code string")
    many = spark.range(3000).select(F.concat(F.lit("128.0."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("ip"))
    counts = {r.country_code: r["count"] for r in E.locate(many, wide).groupBy("country_code").count().collect()}
    assert counts == {"W": 1, "N": 1499}


@pytest.mark.parametrize("name", ["k4_rate_stream", "k5_detect_stream", "k8_committed_alerts", "a3_write_packets", "a5_write_alerts", "d6_locate_mixed"])
def test_live_queries_have_rows(spark, name):
    from netsift.plans import catalogue

    catalogue.load()
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_medians_of_many_labels(spark):
    rng = random.Random(11)
    rows = [(k, f"l{k % 10_000}" if k % 7 else "hot", rng.choice([float(rng.randrange(50)), None, float("nan")]) if k % 3 == 0 else rng.random()) for k in range(60_000)] + [(-1, None, 5.0), (-2, "none", None)]
    df = spark.createDataFrame(rows, "i long, label string, score double").withColumn("is_anomaly", F.col("score") > 0.5)
    by_label = {}
    for _, label, score in rows:
        if label is not None:
            by_label.setdefault(label, []).extend([score] if score is not None and score == score else [])
    want = {label: statistics.median(v) if v else None for label, v in by_label.items()}
    got = {r.label: r.median_score for r in V.anomaly_report(df).collect() if r.level == "label" and r.label is not None}
    assert got == want and len(want) > 8000


def test_locate_takes_each_row_once(spark):
    taken = spark.sparkContext.accumulator(0)

    def seen(text):
        taken.add(1)
        return text

    seen = F.udf(seen, "string")
    geo = spark.createDataFrame([(134744064, 134744319, "US")], "lo long, hi long, country_code string")
    rows = spark.range(60).select(F.concat(F.lit("8.8.8."), (F.col("id") % 3).cast("string")).alias("ip"))
    rows = rows.unionByName(spark.createDataFrame([("10.0.0.1",), ("none",), (None,)], "ip string"))
    got = {(r.ip, r.is_private, r.country_code) for r in E.locate(rows.select(seen("ip").alias("ip")), geo).collect()}
    assert got == {("8.8.8.0", False, "US"), ("8.8.8.1", False, "US"), ("8.8.8.2", False, "US"), ("10.0.0.1", True, "**")}
    assert taken.value == 63


def test_an_indicator_is_guessed_only_without_a_type(spark):
    kinds = "id string, source_ip string, observables array<struct<type:string,value:string>>"
    rows = [("a", "8.8.8.8", [("Domain", "8.8.8.8"), ("other", "evil.example.org")]), ("a", "1.2.3.4", []), ("b", "8.8.8.8", None), ("c", "?", [("x", "??")])]
    got = {tuple(r) for r in E.alert_indicators(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {("a", "8.8.8.8", "domain"), ("a", "evil.example.org", "domain"), ("a", "1.2.3.4", "ip"), ("b", "8.8.8.8", "ip")}
