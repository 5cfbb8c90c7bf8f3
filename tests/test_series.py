import datetime as dt
import math
import random

import numpy as np
from pyspark.sql import functions as F

from netsift.operators import detections as D
from netsift.operators import thresholds as H
from netsift.functions.plates import clean_plate

START = dt.datetime(2024, 1, 1)


def series(spark, values, step=60):
    rows = [("f", START + dt.timedelta(seconds=step * i), i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, ts timestamp, row_id long, value double")


def by_row(df):
    return {r.row_id: r for r in df.collect()}


def test_ewma_golden(spark):
    got = by_row(H.flag_over_threshold(H.ewma_threshold(series(spark, [1, 2, 3]))))
    assert [round(got[i].ewma, 6) for i in range(3)] == [1, 1.3, 1.81]
    assert [round(got[i].ewmvar, 6) for i in range(3)] == [0, 0.21, 0.7539]
    assert [round(got[i].threshold, 6) for i in range(3)] == [1, 2.674773, 4.414822]
    assert [got[i].is_anomaly for i in range(3)] == [False, True, True]


def test_ewma_over_slices_and_resumed(spark, tmp_path):
    rng = random.Random(6)
    values = [rng.gauss(50, 10) for _ in range(200)]
    m, s, want = values[0], 0.0, []
    for i, v in enumerate(values):
        if i:
            s = 0.7 * (s + 0.3 * (v - m) ** 2)
            m = 0.3 * v + 0.7 * m
        want.append(m + 3 * math.sqrt(s))
    df = series(spark, values)
    got = by_row(H.ewma_threshold(df, slice_seconds=600))
    assert np.allclose([got[i].threshold for i in range(200)], want)
    first = H.ewma_threshold(df.where("row_id < 120"), slice_seconds=600)
    H.save_threshold_state(first, str(tmp_path / "state"))
    state, recent = H.load_threshold_state(spark, str(tmp_path / "state"))
    rest = by_row(H.ewma_threshold(df.where("row_id >= 120"), state=state, slice_seconds=600))
    assert np.allclose([rest[i].threshold for i in range(120, 200)], want[120:])
    assert math.isclose(rest[120].previous_threshold, want[119])
    assert recent.count() == 100


def test_moving_threshold_over_chunks_and_resumed(spark, tmp_path):
    rng = random.Random(7)
    values = [rng.random() * 9 for _ in range(150)]
    df = series(spark, values)
    got = by_row(H.moving_threshold(df, window=10, slice_seconds=600))
    assert got[0].threshold == math.inf and got[0].previous_threshold is None and got[1].previous_threshold == math.inf
    for i in range(2, 150):
        last = values[max(0, i - 10) : i]
        assert math.isclose(got[i].previous_threshold, np.mean(last) + 3 * np.std(last))
    H.save_threshold_state(H.moving_threshold(df.where("row_id < 90"), window=10), str(tmp_path / "s"), window=10)
    _, recent = H.load_threshold_state(spark, str(tmp_path / "s"))
    rest = by_row(H.resume_moving_threshold(df.where("row_id >= 90"), recent, window=10))
    assert all(math.isclose(rest[i].threshold, got[i].threshold) for i in range(90, 150))


def test_unplanned_features_are_not_anomalous(spark):
    df = series(spark, [1, 1, 100])
    out = H.apply_thresholds(df, [H.ThresholdPlan("other")])
    assert [r.is_anomaly for r in out.collect()] == [False] * 3
    flagged = by_row(H.apply_thresholds(df, [H.ThresholdPlan("f", "moving")]))
    assert flagged[2].is_anomaly


def test_thresholds_of_the_user(spark):
    def fixed(rows, tie, limit):
        return rows.withColumns({"threshold": F.lit(limit), "previous_threshold": F.lit(limit)})

    out = H.apply_thresholds(series(spark, [1, 5, 9]), [H.ThresholdPlan("f", fixed, {"limit": 4.0})])
    assert {r.row_id: r.is_anomaly for r in out.collect()} == {0: False, 1: True, 2: True}


def test_forecast_of_a_short_series_repeats(spark):
    thresholds = H.seasonal_threshold(series(spark, [1, 2, 3]), period=4)
    got = H.seasonal_forecast(thresholds, 2, period=4).orderBy("step").collect()
    assert [r.forecast for r in got] == [3.0, 3.0] and got[0].threshold == got[1].threshold


def test_debounce_golden(spark):
    df = spark.createDataFrame([("v", s) for s in (2.0, 3.0, 3.9, 4.0, 6.5)], "video string, s double")
    kept = D.debounce(df, "video", "s", 2.0)
    assert sorted(r.s for r in kept.collect()) == [2.0, 4.0, 6.5]
    early = spark.createDataFrame([("v", s) for s in (0.5, 1.9, 2.0)], "video string, s double")
    assert [r.s for r in D.debounce(early, "video", "s", 2.0, suppress_start=True).collect()] == [2.0]


def test_debounce_over_slices_equals_the_plain_loop(spark):
    rng = random.Random(10)
    rows = [(k, rng.randint(0, 4000) / 10) for k in "ab" for _ in range(250)]
    df = spark.createDataFrame(rows, "video string, s double")
    want = []
    for key in "ab":
        last = None
        for t in sorted(s for k, s in rows if k == key):
            if last is None or t - last >= 2.0 - 1e-9:
                want.append((key, t))
                last = t
    got = sorted((r.video, r.s) for r in D.debounce(df, "video", "s", 2.0, slice_seconds=7).collect())
    assert got == sorted(want)


def overlap(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_nms_in_rounds_equals_the_plain_loop(spark):
    rng = random.Random(11)
    boxes = [
        ("big" if i < 150 else "small", i, rng.randint(0, 100), rng.randint(0, 60), rng.randint(5, 40), rng.randint(5, 40), rng.randint(1, 50) / 50)
        for i in range(170)
    ]
    df = spark.createDataFrame(boxes, "image string, box_id long, x int, y int, w int, h int, confidence double")
    want = []
    for image in ("big", "small"):
        kept = []
        for b in sorted((b for b in boxes if b[0] == image), key=lambda b: (-b[6], b[1])):
            if all(overlap(b[2:6], k[2:6]) <= 0.3 for k in kept):
                kept.append(b)
        want += [b[1] for b in kept]
    for size in (20, 1000):
        got = D.nms(df, 0.3, round_size=size)
        assert sorted(r.box_id for r in got.collect()) == sorted(want)


def test_plate_texts(spark):
    df = spark.createDataFrame([("ab-12 cd",), ("x1",), ("ABCDEFGHIJK",)], "t string")
    got = [tuple(r.p) for r in df.select(clean_plate("t").alias("p")).collect()]
    assert got == [("AB12CD", True), ("X1", False), ("ABCDEFGHIJK", False)]


def test_votes(spark):
    rows = [("v", 1, "AAAA"), ("v", 2, "BBBB"), ("v", 3, "bb-bb"), ("w", 1, "x"), ("t", 2, "CCCC"), ("t", 1, "DDDD")]
    df = spark.createDataFrame(rows, "video string, n int, raw_text string")
    assert {r.video: r.plate for r in D.vote_plate(df, "video", "n").collect()} == {"v": "BBBB", "w": D.NO_PLATE, "t": "DDDD"}
    assert {r.video: r.plate for r in D.first_valid_plate(df, "video", "n").collect()} == {"v": "AAAA", "w": D.NO_PLATE, "t": "DDDD"}
