import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from netsift.functions import network as N
from netsift.sources import datasets, feeds, logs
from netsift.sources.packets import read_packets, write_packets


def test_dataset_by_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    df = datasets.read_dataset(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("x", "int"), ("y", "string")] and df.count() == 2
    with pytest.raises(ValueError):
        datasets.read_dataset(spark, "a.xlsx")


def test_packets_round_trip(spark, tmp_path):
    line = {"packet_id": 1, "timestamp": "2024-01-01T00:00:05.250001", "src_ip": "1.1.1.1", "tcp_flags": {"syn": True}, "length": 9}
    (tmp_path / "in.json").write_text(json.dumps(line) + "\n{broken\n\n")
    df = read_packets(spark, str(tmp_path / "in.json"))
    write_packets(df, str(tmp_path / "out"))
    back = read_packets(spark, str(tmp_path / "out"))
    assert back.collect() == df.collect()
    row = back.first()
    assert row.ts == dt.datetime(2024, 1, 1, 0, 0, 5, 250001) and row.tcp_flags.syn and row.tcp_flags.ack is None


def test_mixed_logs(spark, tmp_path):
    path = tmp_path / "alerts.log"
    path.write_text(
        '{"timestamp": "2024-01-01T00:00:00Z", "signature_id": "S1", "message": "m"}\n2024-01-01 00:01:00 | S2 | text | more\nonly|two\nplain\n'
    )
    got = sorted(tuple(r) for r in logs.read_alert_log(spark, str(path)).collect())
    assert got == [("2024-01-01 00:01:00", "S2", "text"), ("2024-01-01T00:00:00Z", "S1", "m")]
    times = logs.read_alert_log(spark, str(path)).select(logs.log_time("timestamp").alias("t")).collect()
    assert sorted(r.t for r in times) == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 1)]
    path.write_text("2024-01-01 00:01:00|ddos|details\n")
    assert logs.read_attack_log(spark, str(path)).first().type == "ddos"


def test_alerts_are_appended(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "id string, n int")
    for _ in range(2):
        logs.write_alerts(df, str(tmp_path / "alerts"))
    assert spark.read.json(str(tmp_path / "alerts")).count() == 2


def test_feed_snapshots_replace_their_feed_only(spark, tmp_path):
    path = str(tmp_path / "feeds")

    def snapshot(feed, values, hour):
        df = spark.createDataFrame([(feed, "ip", v) for v in values], "feed string, indicator_type string, value string")
        feeds.save_feed(df, path, F.lit(f"2024-01-01 0{hour}:00:00").cast("timestamp"))

    snapshot("a", ["1.1.1.1", "2.2.2.2"], 1)
    snapshot("b", ["3.3.3.3"], 2)
    snapshot("a", ["4.4.4.4"], 3)
    got = sorted((r.feed, r.value) for r in feeds.load_feed(spark, path).collect())
    assert got == [("a", "4.4.4.4"), ("b", "3.3.3.3")]
    stale = feeds.stale_feeds(feeds.load_feed(spark, path), F.lit("2024-01-02 02:30:00").cast("timestamp"), 24)
    assert {r.feed: r.stale for r in stale.collect()} == {"a": False, "b": True}


def test_rule_feed_takes_bracketed_single_addresses(spark):
    lines = spark.createDataFrame([("alert ip [1.2.3.4,5.6.7.8,10.0.0.0/8] any -> $HOME_NET any",), ("# drop ip [9.9.9.9]",), ("alert tcp [7.7.7.7]",)], "value string")
    assert sorted(r.value for r in feeds.parse_rules_feed(lines, "r").collect()) == ["1.2.3.4", "5.6.7.8"]


def test_image_scan(spark, tmp_path):
    for name in ("a.JPG", "b.png", "c.txt", "noextension", "d.bmp"):
        (tmp_path / name).write_bytes(b"xy")
    got = datasets.scan_images(spark, str(tmp_path))
    assert sorted(r.file_name for r in got.select("file_name").collect()) == ["a.JPG", "b.png", "d.bmp"]


def test_payload_decoding(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff!"),), (bytearray("é".encode()),)], "raw binary")
    got = [(r.p.payload, r.p.payload_len) for r in df.select(N.decode_payload("raw").alias("p")).collect()]
    assert got == [("ok�!", 4), ("é", 2)]


def test_byte_features(spark):
    df = spark.createDataFrame([(bytearray([9, 255, 51]),)], "raw binary")
    got = df.select(N.byte_features("raw", 5).alias("b")).first().b
    assert got == [3.0, 1.0, 0.2, 0.0, 0.0]
