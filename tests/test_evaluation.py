import datetime as dt
import random

from pyspark.sql import functions as F

from netsift.operators import evaluation as V
from netsift.operators import learning as L
from netsift.operators import lifecycle as C

START = dt.datetime(2024, 1, 1)


def log(spark, name, seconds):
    rows = [(i, START + dt.timedelta(seconds=s) if s is not None else None, i) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, f"{name} long, ts timestamp, seq long")


def greedy(alerts, events, window):
    used, pairs = set(), []
    for i, a in enumerate(alerts):
        for j, e in enumerate(events):
            if j not in used and a is not None and e is not None and abs(a - e) <= window:
                used.add(j)
                pairs.append((i, j))
                break
    return pairs


def pairs_of(df):
    return sorted((r.alert_id, r.event_id) for r in df.collect())


def test_matching_in_list_order(spark):
    for alerts, events, want in (
        ([0, 10, 200], [50, 30], [(0, 0), (1, 1)]),
        ([0, 100], [55, -50], [(0, 0)]),
    ):
        a, e = log(spark, "alert_id", alerts), log(spark, "event_id", events)
        got = V.match_alerts_listed(a, e, 60)
        assert pairs_of(got) == want == greedy(alerts, events, 60)
    counts = V.match_counts(a, e, got).first()
    assert (counts.true_positives, counts.false_positives, counts.false_negatives) == (1, 1, 1)


def test_matching_in_list_order_equals_the_plain_loop(spark):
    rng = random.Random(4)
    alerts = [rng.randint(0, 900) for _ in range(25)] + [None]
    events = [rng.randint(0, 900) for _ in range(25)]
    got = V.match_alerts_listed(log(spark, "alert_id", alerts), log(spark, "event_id", events), 30)
    assert pairs_of(got) == sorted(greedy(alerts, events, 30))


def test_matching_in_time_order_equals_the_plain_loop(spark):
    rng = random.Random(8)
    for n, m, span, window in ((60, 60, 600, 20), (120, 30, 300, 25), (30, 120, 300, 25), (80, 80, 4000, 10), (100, 100, 100, 5)):
        alerts, events = sorted(rng.randint(0, span) for _ in range(n)), sorted(rng.randint(0, span) for _ in range(m))
        got = V.match_alerts(log(spark, "alert_id", alerts), log(spark, "event_id", events), window, slice_seconds=2 * window)
        assert pairs_of(got) == sorted(greedy(alerts, events, window)), (n, m, span)


def test_rows_without_time_match_nothing(spark):
    a, e = log(spark, "alert_id", [None, 0]), log(spark, "event_id", [None, 10])
    assert pairs_of(V.match_alerts(a, e, 60)) == [(1, 1)]


def test_areas_with_ties(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.3, False), (0.1, False)], "s double, y boolean")
    got = V.detector_quality(df, "s", "y").first()
    assert abs(got.roc_auc - 5.5 / 6) < 1e-12
    # points (r, p): (0,1) (.5,1) (1,2/3) then recall stays 1
    assert abs(got.pr_auc - (0.5 * 1 + 0.5 * (1 + 2 / 3) / 2)) < 1e-12


def test_confusion_is_zero_safe(spark):
    df = spark.createDataFrame([(False, False)], "p boolean, y boolean")
    row = V.confusion_metrics(df, "p", "y").first()
    assert (row.true_negatives, row.precision, row.recall, row.f1_score) == (1, 0.0, 0.0, 0.0)


def scored(spark, n_normal, n_bad):
    rows = [(i, float(i), i >= n_normal) for i in range(n_normal + n_bad)]
    return spark.createDataFrame(rows, "row_id long, score double, is_anomaly boolean")


def test_balanced_sample(spark):
    df = scored(spark, 300, 80)
    a = L.balanced_sample(df, "is_anomaly", "row_id")
    b = L.balanced_sample(df.repartition(7), "is_anomaly", "row_id")
    assert sorted(r.row_id for r in a.collect()) == sorted(r.row_id for r in b.collect())
    assert {r.is_anomaly: r["count"] for r in a.groupBy("is_anomaly").count().collect()} == {True: 80, False: 80}
    assert L.balanced_sample(df, "is_anomaly", "row_id", max_rows=50).count() == 50
    assert L.balanced_sample(scored(spark, 300, 49), "is_anomaly", "row_id").count() == 0


def test_uncertainty_band(spark):
    n, centre, reach = 200, int(200 * (100 * (1 - 0.9)) / 100), 10
    assert L.uncertainty_band(scored(spark, n, 0), "score", 0.9, 10.0) == (float(centre - reach), float(centre + reach))


def test_registry(spark, tmp_path):
    registry = C.Registry(spark, str(tmp_path / "registry"))
    at = [F.lit(f"2024-01-01 0{h}:00:00").cast("timestamp") for h in range(6)]
    assert registry.register("m", "r1", ("auc", 0.8), {"a": "b"}, at[0]) == 1
    assert registry.register("m", "r2", ("auc", 0.9), {}, at[1]) == 2
    registry.promote("m", 1, "Production", at[2])
    registry.promote("m", 2, "Production", at[3])
    assert {r.version: r.stage for r in registry.versions().collect()} == {1: "Archived", 2: "Production"}
    assert [r.version for r in registry.versions("Production").collect()] == [2]
    assert registry.versions().where("version = 1").first().tags == {"a": "b"}


def test_update_decisions(spark):
    report = spark.createDataFrame([(500, True, False)], "rows long, drift_detected boolean, performance_degradation boolean")

    def decide(has_model, last, now):
        state = spark.createDataFrame([(has_model, last)], "has_model boolean, last_update timestamp")
        return C.update_needed(state, report, F.lit(now).cast("timestamp")).first().reasons

    assert decide(False, None, "2024-01-10 00:00:00") == ["no_model"]
    assert decide(True, None, "2024-01-10 00:00:00") == ["first_training", "drift"]
    assert decide(True, dt.datetime(2024, 1, 9, 20), "2024-01-10 00:00:00") == []
    assert decide(True, dt.datetime(2024, 1, 9, 12), "2024-01-10 00:00:00") == ["drift"]
    assert decide(True, dt.datetime(2024, 1, 3), "2024-01-10 00:00:00") == ["max_interval", "drift"]


def test_drift_calls_the_evaluator(spark):
    from netsift.operators import drift as D

    a = spark.createDataFrame([(float(i % 10),) for i in range(200)], "x double")
    b = spark.createDataFrame([(float(i % 10 + 5),) for i in range(150)], "x double")
    row = D.drift_report(a, b, ["x"], performance=lambda df: df.count() / 1000, baseline=0.5).first()
    assert row.drift_detected and row.drifted_features == ["x"] and row.performance_degradation
    assert abs(row.drift_score - 0.5) < 1e-12
    few = D.drift_report(a, b.limit(50), ["x"]).first()
    assert not few.drift_detected and few.drift_score == 0.0
    shift = D.wasserstein_drift(a, b, ["x"]).first().score
    assert abs(shift - 5 / 9) < 1e-12


def test_drift_reads_each_sample_once(spark):
    from netsift.operators import drift as D

    a, b = (spark.range(200).select((F.col("id") % 7).alias("x"), (F.col("id") * k).alias("y")) for k in (1, 2))
    found = D.drift_scores(a, b, ["x", "y"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "LogicalRDD" in plan
    got = {r.feature: (r.ks, r.wasserstein) for r in found.collect()}
    assert got["x"] == (0.0, 0.0) and abs(got["y"][0] - 0.5) < 1e-12
