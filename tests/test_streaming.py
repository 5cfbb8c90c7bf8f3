import datetime as dt
import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsift.operators import flows
from netsift.operators import intel as I
from netsift.operators import rules as R
from netsift.operators import thresholds as H
from netsift.operators.detections import debounce
from netsift.sources.packets import read_packets
from netsift.streaming import packets as P
from netsift.streaming import sinks as S
from netsift.streaming import stateful as W

START = dt.datetime(2024, 1, 1)


def packet(i, second, src="10.0.0.1", dst_port=22, protocol="TCP", payload="x", length=100):
    return {
        "packet_id": i,
        "timestamp": (START + dt.timedelta(seconds=second)).isoformat(),
        "protocol": protocol,
        "src_ip": src,
        "dst_ip": "10.1.1.1",
        "src_port": 4000,
        "dst_port": dst_port,
        "tcp_flags": {"syn": i % 2 == 0, "ack": True, "fin": False, "rst": False, "psh": False, "urg": False},
        "payload": payload,
        "payload_len": 1,
        "length": length,
    }


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "packets"
    path.mkdir()
    rows = [packet(i, 7 * i, src=f"10.0.0.{i % 3}", dst_port=[22, 53, 80][i % 3], length=60 + i) for i in range(60)]
    rows[5]["payload"] = "id=1 union  select x"
    for n in range(3):
        text = "\n".join(json.dumps(r) for r in rows[n * 20 : (n + 1) * 20])
        (path / f"part-{n}.json").write_text(text + "\nnot json\n")
        # files are taken by age
        os.utime(path / f"part-{n}.json", (time.time() + n - 10, time.time() + n - 10))
    return str(path)


def run(stream, tmp_path, name, spark):
    query = (
        stream.writeStream.format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / name))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    return spark.table(name), query


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_packets_skip_malformed_lines(spark, folder):
    assert read_packets(spark, folder).count() == 60
    assert read_packets(spark, folder).where("tcp_flags.syn").count() == 30


def test_windows_equal_batch(spark, folder, tmp_path):
    stream = P.packet_stream(spark, folder, "1 second", max_files=1)
    got, _ = run(P.rate_windows(stream, "30 seconds"), tmp_path, "rate_windows", spark)
    batch = P.rate_windows(read_packets(spark, folder), "30 seconds")
    want = rows(batch, "window_start", "packets", "bytes")
    # append mode leaves the windows that the watermark has not passed
    assert set(rows(got, "window_start", "packets", "bytes")) <= set(want)
    assert got.count() >= len(want) - 2


def test_sliding_summary_equals_batch(spark, folder, tmp_path):
    stream = P.packet_stream(spark, folder, "1 second", max_files=1)
    got, _ = run(P.sliding_summary(stream), tmp_path, "sliding", spark)
    batch = rows(P.sliding_summary(read_packets(spark, folder)), "window_start", "packet_count", "unique_src_ips", "tcp_syn_ratio")
    assert 0 < got.count() and set(rows(got, "window_start", "packet_count", "unique_src_ips", "tcp_syn_ratio")) <= set(batch)


def test_flow_sessions(spark, folder, tmp_path):
    stream = P.packet_stream(spark, folder, "1 second", max_files=1)
    got, _ = run(P.flow_sessions(stream, "22 seconds"), tmp_path, "sessions", spark)
    batch = P.flow_sessions(read_packets(spark, folder), "22 seconds")
    columns = ["src_ip", "dst_port", "packet_count", "byte_count", "flow_duration"]
    assert batch.count() == 3
    assert set(rows(got, *columns)) <= set(rows(batch, *columns))
    assert rows(flows.flow_features(read_packets(spark, folder)), *columns) == rows(batch, *columns)


def test_rate_stream_equals_batch(spark, folder, tmp_path):
    stream = P.packet_stream(spark, folder, "10 seconds", max_files=1)
    got, _ = run(W.rate_stream(stream, "ip", 3, 45), tmp_path, "rates", spark)
    batch = R.rate_match(read_packets(spark, folder), "ip", 3, 45).where("rate_match")
    assert rows(got, "packet_id") == rows(batch, "packet_id")
    assert got.count() > 0


def test_detect_stream(spark, folder, tmp_path):
    rules = [
        R.PayloadRule("T", "sql", patterns=["union\\s+select"], severity="critical"),
        R.PortRule("P", "ssh", port_list=[22]),
        R.CompositeRule("C", "dns", severity="high", subrules=[R.PortRule("p", "p", port_list=[53]), R.RateRule("r", "r", count=3, seconds=45)]),
    ]
    stream = P.packet_stream(spark, folder, "10 seconds", max_files=1)
    got, _ = run(W.detect_stream(stream, rules), tmp_path, "alerts", spark)
    batch = R.match_all(read_packets(spark, folder), rules)
    assert rows(got, "packet_id", "rule_id") == rows(batch, "packet_id", "rule_id")


def series(spark, folder):
    return read_packets(spark, folder).select(F.col("src_ip").alias("feature"), "ts", F.col("packet_id").alias("row_id"), F.col("length").cast("double").alias("value"))


def test_ewma_stream_equals_batch(spark, folder, tmp_path):
    stream = P.packet_stream(spark, folder, max_files=1).select(
        F.col("src_ip").alias("feature"), "ts", F.col("packet_id").alias("row_id"), F.col("length").cast("double").alias("value")
    )
    got, _ = run(W.ewma_stream(stream), tmp_path, "ewma", spark)
    batch = H.flag_over_threshold(H.ewma_threshold(series(spark, folder), slice_seconds=60))
    a = {r.row_id: (round(r.threshold, 6), r.is_anomaly) for r in got.collect()}
    b = {r.row_id: (round(r.threshold, 6), r.is_anomaly) for r in batch.collect()}
    assert a == b and len(a) == 60


def test_debounce_stream_equals_batch(spark, folder, tmp_path):
    stream = P.packet_stream(spark, folder, max_files=1)
    got, _ = run(W.debounce_stream(stream, "src_ip", "packet_id", 50), tmp_path, "debounced", spark)
    batch = debounce(read_packets(spark, folder), "src_ip", "ts", 50, "packet_id", slice_seconds=60)
    assert rows(got, "packet_id") == rows(batch, "packet_id")


def test_fan_out_survives_a_failing_sink(spark, folder, tmp_path):
    failed = []

    def broken(batch, batch_id):
        raise OSError("disk full")

    alerts = R.check_signatures(P.packet_stream(spark, folder, max_files=1), [R.PortRule("P", "ssh", port_list=[22])])
    sinks = {"broken": broken, "json": S.json_sink(str(tmp_path / "out"))}
    query = S.fan_out(
        alerts, sinks, str(tmp_path / "cp"), lambda batch, name, error: failed.append(name), dead_letter=lambda name: S.json_sink(str(tmp_path / "dead" / name))
    )
    query.awaitTermination(120)
    assert query.exception() is None
    assert set(failed) == {"broken"}
    assert spark.read.json(str(tmp_path / "out")).count() == 20
    assert spark.read.json(str(tmp_path / "dead" / "broken")).count() == 20
    strict = S.fan_out(alerts, sinks, str(tmp_path / "cp-strict"))
    with pytest.raises(Exception, match="disk full"):
        strict.awaitTermination(120)


def test_enrichment_reloads_the_feed(spark, folder, tmp_path):
    loads = []

    def load():
        loads.append(1)
        listed = [("f", "ip", "10.0.0.1")] if len(loads) > 1 else [("f", "ip", "10.0.0.2")]
        return {"feed": spark.createDataFrame(listed, "feed string, indicator_type string, value string")}

    query = S.enrich_each_batch(
        P.packet_stream(spark, folder, max_files=1),
        load,
        lambda batch, tables: I.match_ip_indicators(batch, tables["feed"]),
        S.parquet_sink(str(tmp_path / "matches")),
        str(tmp_path / "cp2"),
    )
    query.awaitTermination(120)
    assert len(loads) == 3
    assert {r.value for r in spark.read.parquet(str(tmp_path / "matches")).collect()} == {"10.0.0.1", "10.0.0.2"}


def test_stream_static_join(spark, folder, tmp_path):
    feed = spark.createDataFrame([("f", "ip", "10.0.0.1")], "feed string, indicator_type string, value string")
    got, _ = run(I.match_ip_indicators(P.packet_stream(spark, folder), feed), tmp_path, "static_join", spark)
    assert got.count() == 20


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = tmp_path / "late"
    path.mkdir()
    for n, seconds in enumerate([[0, 10, 20], [300, 310], [320], [5], [600]]):
        file = path / f"part-{n}.json"
        file.write_text("\n".join(json.dumps(packet(100 * n + i, s)) for i, s in enumerate(seconds)))
        os.utime(file, (time.time() + n, time.time() + n))
    stream = P.packet_stream(spark, str(path), "30 seconds", max_files=1)
    got, query = run(P.rate_windows(stream, "1 minute"), tmp_path, "late", spark)
    assert S.late_rows(query) == 1
    first = [r.packets for r in got.where(F.col("window_start") == F.lit(START)).collect()]
    assert first == [3]


def test_ewma_of_a_large_batch_comes_in_parts():
    """Rows in any order, in frames of any size: results leave in bounded parts and are those of one go in time order."""
    rng = np.random.default_rng(3)
    us, values = rng.integers(0, 40, 100), rng.random(100)
    frame = pd.DataFrame({"feature": "a", "row_id": rng.permutation(100), "us": us, "value": values})
    frames = [frame.iloc[:7], frame.iloc[7:60], frame.iloc[60:]]
    for state in (None, (0.5, 0.01)):
        parts = list(W.ewma_parts(iter(frames), state, "feature", "a", "row_id", 0.3, 3.0, size=16))
        assert max(len(out) for out, _ in parts) == 16
        want, after = W.ewma_rows(frame.sort_values(["us", "row_id"]), state, "feature", "a", "row_id", 0.3, 3.0)
        got = pd.concat([out for out, _ in parts], ignore_index=True)
        pd.testing.assert_frame_equal(got, want.reset_index(drop=True), check_exact=True)
        assert parts[-1][1] == after
