"""Evaluation, drift, learning and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import drift as D
from netsift.operators import evaluation as V
from netsift.operators import learning as L
from netsift.operators import lifecycle as C
from netsift.plans.catalogue import query
from netsift.plans.tables import packets, table, with_packets


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# -- alerts against attacks: errors are attacks, every other event is an alert

_A = "SELECT event_id AS alert_id, ts FROM events WHERE event_type <> 'error'"
_E = "SELECT event_id, ts FROM events WHERE event_type = 'error'"


def alerts_and_attacks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    alerts = e.where("event_type <> 'error'").select(F.col("event_id").alias("alert_id"), "ts")
    return alerts, e.where("event_type = 'error'").select("event_id", "ts")


@query(
    "d13_pair_alerts",
    f"""SELECT alert_id, event_id, round((epoch_us(e.ts) - epoch_us(a.ts)) / 1e6, 6) AS seconds FROM ({_A}) a, ({_E}) e
      WHERE abs(epoch_us(a.ts) - epoch_us(e.ts)) <= 300000000""",
)
def pair_alerts(spark, sf_dir):
    a, e = alerts_and_attacks(spark, sf_dir)
    return _round(V.pair_alerts(a, e, 300), "seconds")


@query(
    "d13_unmatched",
    f"""SELECT 'alert' AS side, alert_id AS id FROM ({_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({_E}) e WHERE abs(epoch_us(a.ts) - epoch_us(e.ts)) <= 300000000)
      UNION ALL SELECT 'event', event_id FROM ({_E}) e WHERE NOT EXISTS (SELECT 1 FROM ({_A}) a WHERE abs(epoch_us(a.ts) - epoch_us(e.ts)) <= 300000000)""",
)
def unmatched(spark, sf_dir):
    a, e = alerts_and_attacks(spark, sf_dir)
    left, right = V.unmatched(a, e, 300)
    return left.select(F.lit("alert").alias("side"), F.col("alert_id").alias("id")).union(right.select(F.lit("event"), "event_id"))


# In time order the greedy step is: take the first event after the last one taken that is not too old.
GREEDY_SQL = f"""RECURSIVE a AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, alert_id) AS i, alert_id, epoch_us(ts) AS us FROM ({_A})),
  e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, event_id) AS j, event_id, epoch_us(ts) AS us FROM ({_E})),
  r AS MATERIALIZED (SELECT i, alert_id, (SELECT count(*) FROM e WHERE e.us < a.us - 600000000) AS lo, (SELECT count(*) FROM e WHERE e.us <= a.us + 600000000) AS hi FROM a),
  g AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS alert_id, CAST(NULL AS BIGINT) AS j
    UNION ALL SELECT r.i, CASE WHEN greatest(g.used, r.lo) < r.hi THEN greatest(g.used, r.lo) + 1 ELSE g.used END, r.alert_id,
      CASE WHEN greatest(g.used, r.lo) < r.hi THEN greatest(g.used, r.lo) + 1 END FROM g JOIN r ON r.i = g.i + 1)"""


@query("d12_match_alerts", f"WITH {GREEDY_SQL} SELECT alert_id, event_id FROM g JOIN e USING (j)")
def match_alerts(spark, sf_dir):
    a, e = alerts_and_attacks(spark, sf_dir)
    return V.match_alerts(a, e, 600)


_ATTACKS = """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'brute_force' WHEN 2 THEN 'ddos' WHEN 3 THEN 'phishing'
  WHEN 4 THEN 'sql_injection' ELSE 'worm' END AS type FROM orders"""
_TECHNIQUES = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d, _ in V.ATTACK_TECHNIQUES) + ") t(type, tactic, technique_id, technique_name)"


def attacks(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 6 WHEN 0 THEN 'port_scan' WHEN 1 THEN 'brute_force' WHEN 2 THEN 'ddos' WHEN 3 THEN 'phishing' "
        "WHEN 4 THEN 'sql_injection' ELSE 'worm' END AS type",
    )


@query("d14_map_attack", f"SELECT o_orderkey, type, tactic, technique_id, technique_name FROM ({_ATTACKS}) JOIN {_TECHNIQUES} USING (type)")
def map_attack(spark, sf_dir):
    return V.map_attack(attacks(spark, sf_dir)).drop("url")


@query(
    "e20_evaluation_report",
    f"""WITH {GREEDY_SQL}, m AS (SELECT count(*) FILTER (WHERE j IS NOT NULL) AS tp FROM g), n AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM e) AS ne),
      x AS (SELECT count(*) AS mapped_attacks, count(DISTINCT technique_id) AS techniques, count(DISTINCT tactic) AS tactics FROM ({_ATTACKS}) JOIN {_TECHNIQUES} USING (type))
    SELECT tp AS true_positives, na - tp AS false_positives, ne - tp AS false_negatives, round(tp / na, 6) AS precision, round(tp / ne, 6) AS recall,
      round(2 * tp / (na + ne), 6) AS f1_score, mapped_attacks, techniques, tactics, na AS alerts, ne AS attack_events FROM m, n, x""",
)
def evaluation_report(spark, sf_dir):
    a, e = alerts_and_attacks(spark, sf_dir)
    out = V.evaluation_report(a, e, V.match_alerts(a, e, 600), attacks(spark, sf_dir))
    return _round(out, "precision", "recall", "f1_score")


# -- scored rows: document length against the toxic and quality labels


def scored(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    joined = labels.join(docs, "doc_id")
    return joined.select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") > 3000).alias("is_anomaly"), F.col("quality").alias("label"))


SCORED_SQL = """SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, n_chars > 3000 AS is_anomaly, quality AS label FROM labels JOIN documents USING (doc_id)"""


@query(
    "e15_anomaly_report",
    f"""WITH s AS ({SCORED_SQL}) SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE 'label' END AS level, label, count(*) AS total,
      count(*) FILTER (WHERE is_anomaly) AS anomalies, round(count(*) FILTER (WHERE is_anomaly) * 100.0 / count(*), 6) AS anomaly_percent,
      min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score, round(median(score), 6) AS median_score
    FROM s GROUP BY GROUPING SETS ((), (label))""",
)
def anomaly_report(spark, sf_dir):
    return _round(V.anomaly_report(scored(spark, sf_dir)), "anomaly_percent", "mean_score", "median_score")


_CONFUSION = """count(*) FILTER (WHERE p AND y) AS true_positives, count(*) FILTER (WHERE p AND NOT y) AS false_positives,
  count(*) FILTER (WHERE NOT p AND NOT y) AS true_negatives, count(*) FILTER (WHERE NOT p AND y) AS false_negatives"""


@query(
    "e16_confusion_metrics",
    with_packets(f"""WITH s AS (SELECT protocol, length > 200 AS p, event_id IS NOT NULL AS y FROM packets LEFT JOIN (SELECT event_id FROM events WHERE user_id % 2 = 0) ON event_id = packet_id),
      c AS (SELECT protocol, {_CONFUSION} FROM s GROUP BY 1)
    SELECT *, round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0 END, 6) AS precision,
      round(CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0 END, 6) AS recall,
      round(CASE WHEN true_positives + false_positives + false_negatives > 0 THEN 2 * true_positives / (2 * true_positives + false_positives + false_negatives) ELSE 0 END, 6) AS f1_score
    FROM c"""),
)
def confusion_metrics(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("event_id").alias("packet_id"), (F.col("user_id") % 2 == 0).alias("label2"))
    p = packets(spark, sf_dir).join(users, "packet_id")
    out = V.confusion_metrics(p, F.col("length") > 200, "label2", ["protocol"])
    return _round(out, "precision", "recall", "f1_score")


_RATED = "SELECT user_id % 3 = 0 AS y, round(value, 1) AS s FROM events"
_AREAS = f"""c AS (SELECT s, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM ({_RATED}) GROUP BY 1),
  r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (ORDER BY s DESC)),
  z AS (SELECT *, coalesce(lag(tp) OVER (ORDER BY s DESC), 0) AS tp0, coalesce(lag(fp) OVER (ORDER BY s DESC), 0) AS fp0 FROM r),
  v AS (SELECT sum(neg * (tp0 + pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
    sum(pos * (tp / (tp + fp) + CASE WHEN tp0 + fp0 > 0 THEN tp0 / (tp0 + fp0) ELSE 1 END) / 2) / sum(pos) AS pr_auc FROM z)"""


def rated(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3 == 0).alias("y"), F.round("value", 1).alias("s"))


@query("e17_roc_auc", f"WITH {_AREAS} SELECT round(roc_auc, 6) AS roc_auc FROM v")
def roc_auc(spark, sf_dir):
    return _round(V.roc_auc(rated(spark, sf_dir), "s", "y"), "roc_auc")


@query("e18_pr_auc", f"WITH {_AREAS} SELECT round(pr_auc, 6) AS pr_auc FROM v")
def pr_auc(spark, sf_dir):
    return _round(V.pr_auc(rated(spark, sf_dir), "s", "y"), "pr_auc")


@query("e19_detector_quality", f"WITH {_AREAS} SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round((roc_auc + pr_auc) / 2, 6) AS quality FROM v")
def detector_quality(spark, sf_dir):
    r = rated(spark, sf_dir).withColumn("s", -F.col("s"))
    return _round(V.detector_quality(r, "s", "y", lower_is_anomalous=True), "roc_auc", "pr_auc", "quality")


# -- drift: early against late line items

FEATURES = ["l_quantity", "l_discount", "l_extendedprice"]


def early_and_late(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("l_discount", F.when(F.col("l_shipdate") >= "1995-06-01", F.col("l_discount") * 1.5).otherwise(F.col("l_discount")))
    return items.where("l_shipdate < TIMESTAMP_NTZ '1995-06-01'"), items.where("l_shipdate >= TIMESTAMP_NTZ '1995-06-01'")


_DRIFT = """items AS (SELECT l_shipdate < TIMESTAMP '1995-06-01' AS early, l_quantity, l_extendedprice,
    CASE WHEN l_shipdate >= TIMESTAMP '1995-06-01' THEN l_discount * 1.5 ELSE l_discount END AS l_discount FROM lineitem),
  cells AS (SELECT early, 'l_quantity' AS feature, l_quantity AS v FROM items UNION ALL SELECT early, 'l_discount', l_discount FROM items
    UNION ALL SELECT early, 'l_extendedprice', l_extendedprice FROM items),
  n AS (SELECT feature, v, count(*) FILTER (WHERE early) AS r, count(*) FILTER (WHERE NOT early) AS c FROM cells GROUP BY 1, 2),
  s AS (SELECT *, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr, sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS fc,
    lead(v) OVER (PARTITION BY feature ORDER BY v) AS nv FROM n WINDOW w AS (PARTITION BY feature ORDER BY v)),
  d AS (SELECT feature, max(abs(fr - fc)) AS ks, least(1, sum(abs(fr - fc) * coalesce(nv - v, 0)) / greatest(max(v) FILTER (WHERE r > 0) - min(v) FILTER (WHERE r > 0), 1e-10)) AS w
    FROM s GROUP BY 1)"""


@query("j9_ks_drift", f"WITH {_DRIFT} SELECT feature, round(ks, 6) AS score FROM d")
def ks_drift(spark, sf_dir):
    return _round(D.ks_drift(*early_and_late(spark, sf_dir), FEATURES), "score")


@query("j10_wasserstein_drift", f"WITH {_DRIFT} SELECT feature, round(w, 6) AS score FROM d")
def wasserstein_drift(spark, sf_dir):
    return _round(D.wasserstein_drift(*early_and_late(spark, sf_dir), FEATURES), "score")


@query(
    "j11_drift_report",
    f"""WITH {_DRIFT} SELECT (SELECT count(*) FROM items WHERE NOT early) AS rows, round(max(ks), 6) AS drift_score, max(ks) > 0.1 AS drift_detected,
      string_agg(feature, ',' ORDER BY feature) FILTER (WHERE ks > 0.1) AS drifted_features, true AS performance_degradation FROM d""",
)
def drift_report(spark, sf_dir):
    out = D.drift_report(*early_and_late(spark, sf_dir), FEATURES, performance=0.7, baseline=0.9)
    return _round(out.select("rows", "drift_score", "drift_detected", F.array_join("drifted_features", ",").alias("drifted_features"), "performance_degradation"), "drift_score")


@query(
    "j12_should_retrain",
    f"""WITH {_DRIFT} SELECT true AS retrain, 'drift_detected,performance_degradation' AS reasons,
      string_agg(feature, ',' ORDER BY feature) FILTER (WHERE ks > 0.1) AS drifted_features, round(0.2, 6)::DOUBLE AS performance_drop FROM d""",
)
def should_retrain(spark, sf_dir):
    report = D.drift_report(*early_and_late(spark, sf_dir), FEATURES, performance=0.7, baseline=0.9)
    out = D.should_retrain(report, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return _round(
        out.select("retrain", F.array_join("reasons", ",").alias("reasons"), F.array_join("drifted_features", ",").alias("drifted_features"), "performance_drop"),
        "performance_drop",
    )


@query(
    "j17_update_needed",
    f"""WITH {_DRIFT}, h AS (SELECT (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ts))) / 3.6e9 AS hours FROM events)
    SELECT true AS update_needed, CASE WHEN hours >= 12 THEN 'drift' || ',performance' ELSE 'performance' END AS reasons, round(hours, 6) AS hours_since_update,
      (SELECT count(*) FROM items WHERE NOT early) AS available_samples FROM h""",
)
def update_needed(spark, sf_dir):
    report = D.drift_report(*early_and_late(spark, sf_dir), FEATURES, performance=0.7, baseline=0.9)
    state = table(spark, sf_dir, "events").agg(F.max("ts").alias("last_update")).withColumn("has_model", F.lit(True))
    out = C.update_needed(state, report, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return _round(out.select("update_needed", F.array_join("reasons", ",").alias("reasons"), "hours_since_update", "available_samples"), "hours_since_update")


@query(
    "f14_performance_trend",
    """WITH l AS (SELECT o_orderdate AS ts, max(o_totalprice) AS p FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 20)
    SELECT count(*) AS evaluations, round(max_by(p, ts) - min_by(p, ts), 6) AS trend FROM l""",
)
def performance_trend(spark, sf_dir):
    daily = table(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.max("o_totalprice").alias("p"))
    return _round(D.performance_trend(daily, "o_orderdate", "p"), "trend")


# -- active learning on event values


def scored_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("value").alias("score"), (F.col("value") > 60).alias("is_anomaly"))


_BAND = """o AS (SELECT event_id, ts, value AS score, value > 60 AS is_anomaly, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events),
  k AS (SELECT max(score) FILTER (WHERE r = greatest(0, CAST(floor(n * (100 * (1 - 0.9)) / 100) AS BIGINT) - CAST(floor(n * 10.0 / 2 / 100) AS BIGINT))) AS low,
    max(score) FILTER (WHERE r = least(n - 1, CAST(floor(n * (100 * (1 - 0.9::DOUBLE)) / 100) AS BIGINT) + CAST(floor(n * 10.0 / 2 / 100) AS BIGINT))) AS high FROM o)"""


@query("j13_uncertainty_band", f"WITH {_BAND.replace('(1 - 0.9)', '(1 - 0.9::DOUBLE)')} SELECT low, high FROM k")
def uncertainty_band(spark, sf_dir):
    events = scored_events(spark, sf_dir)
    low, high = L.uncertainty_band(events, "score")
    return spark.range(1).select(F.lit(low).alias("low"), F.lit(high).alias("high"))


_BAND = _BAND.replace("(1 - 0.9)", "(1 - 0.9::DOUBLE)")


@query("j14_split_confident", f"WITH {_BAND} SELECT event_id, is_anomaly, score BETWEEN low AND high AS is_uncertain FROM o, k")
def split_confident(spark, sf_dir):
    sure, unsure = L.split_confident(scored_events(spark, sf_dir), "score")
    return sure.unionByName(unsure).select("event_id", "is_anomaly", "is_uncertain")


@query(
    "e22_labelling_metrics",
    f"""WITH {_BAND}, m AS (SELECT is_anomaly, score BETWEEN low AND high AS u FROM o, k),
      c AS (SELECT count(*) AS t, count(*) FILTER (WHERE NOT u AND NOT is_anomaly) AS n, count(*) FILTER (WHERE NOT u AND is_anomaly) AS a, count(*) FILTER (WHERE u) AS u FROM m)
    SELECT t AS total_samples_processed, n AS auto_labeled_normal, a AS auto_labeled_anomaly, u AS uncertain_samples, n + a AS total_labeled,
      round((n + a) / t, 6) AS labeling_rate, round(a / n, 6) AS normal_anomaly_ratio FROM c""",
)
def labelling_metrics(spark, sf_dir):
    out = L.labelling_metrics(L.mark_uncertain(scored_events(spark, sf_dir), "score"))
    return _round(out, "labeling_rate", "normal_anomaly_ratio")


@query(
    "d15_apply_labels",
    f"""WITH {_BAND}, u AS (SELECT event_id, is_anomaly FROM o, k WHERE score BETWEEN low AND high), l AS (SELECT doc_id AS event_id, toxic = 1 AS y FROM labels)
    SELECT event_id, y AS is_anomaly, false AS is_uncertain FROM u JOIN l USING (event_id) UNION ALL SELECT event_id, is_anomaly, true FROM u ANTI JOIN l USING (event_id)""",
)
def apply_labels(spark, sf_dir):
    _, unsure = L.split_confident(scored_events(spark, sf_dir), "score")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.col("toxic").alias("label"))
    newly, rest = L.apply_labels(unsure, labels, "event_id")
    return newly.unionByName(rest).select("event_id", "is_anomaly", "is_uncertain")


@query(
    "i4_update_pools",
    f"""WITH {_BAND}, m AS (SELECT event_id, ts, is_anomaly, score BETWEEN low AND high AS u FROM o, k), l AS (SELECT doc_id AS event_id, toxic = 1 AS y FROM labels),
      pool AS (SELECT event_id, ts FROM m WHERE NOT u UNION ALL SELECT event_id, ts FROM m SEMI JOIN l USING (event_id) WHERE u),
      wait AS (SELECT event_id, ts FROM m ANTI JOIN l USING (event_id) WHERE u)
    SELECT 'labelled' AS pool, event_id FROM (SELECT * FROM pool ORDER BY ts DESC, event_id DESC LIMIT 2000)
    UNION ALL SELECT 'uncertain', event_id FROM (SELECT * FROM wait ORDER BY ts DESC, event_id DESC LIMIT 200)""",
)
def update_pools(spark, sf_dir):
    sure, unsure = L.split_confident(scored_events(spark, sf_dir), "score")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), F.col("toxic").alias("label"))
    newly, _ = L.apply_labels(unsure, labels, "event_id")
    nothing = sure.where("false")
    labelled, waiting = L.update_pools(nothing, nothing, sure, unsure, newly, "event_id", "ts", 200)
    return labelled.select(F.lit("labelled").alias("pool"), "event_id").union(waiting.select(F.lit("uncertain"), "event_id"))


@query(
    "f13_keep_latest",
    """SELECT 'all' AS scope, event_id FROM (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)
    UNION ALL SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100""",
)
def keep_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    whole = L.keep_latest(e, "ts", 1000, tie="event_id").select(F.lit("all").alias("scope"), "event_id")
    return whole.union(L.keep_latest(e, "ts", 100, ["event_type"], tie="event_id").select("event_type", "event_id"))


@query(
    "j16_balanced_sample",
    """WITH n AS (SELECT count(*) FILTER (WHERE value > 60) AS a, count(*) FILTER (WHERE value <= 60) AS b FROM events)
    SELECT true AS is_anomaly, least(a, b, 400) AS rows, least(a, b, 400) AS distinct_rows FROM n UNION ALL SELECT false, least(a, b, 400), least(a, b, 400) FROM n""",
)
def balanced_sample(spark, sf_dir):
    sample = L.balanced_sample(scored_events(spark, sf_dir), "is_anomaly", "event_id", max_rows=800)
    return sample.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("distinct_rows"))


# -- registry: orders as version events of a customer's model


def version_events(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('model-', o_custkey % 20) AS name",
        "CAST(o_orderkey % 8 + 1 AS INT) AS version",
        "CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging' ELSE 'None' END AS stage",
        "concat('run-', o_orderkey) AS run_id",
        "o_totalprice AS metric_value",
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey / 1000000D) AS event_ts",
    )


_VERSIONS = """ev AS (SELECT 'model-' || CAST(o_custkey % 20 AS VARCHAR) AS name, CAST(o_orderkey % 8 + 1 AS INT) AS version,
    CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging' ELSE 'None' END AS stage, 'run-' || CAST(o_orderkey AS VARCHAR) AS run_id,
    o_totalprice AS metric_value, epoch_us(o_orderdate) + o_orderkey AS t FROM orders),
  cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY t DESC) AS r FROM ev) WHERE r = 1)"""


@query("j19_latest_versions", f"WITH {_VERSIONS} SELECT name, version, stage, run_id, metric_value FROM cur")
def latest_versions(spark, sf_dir):
    return C.latest_versions(version_events(spark, sf_dir)).drop("event_ts")


@query(
    "j19_promotion",
    f"""WITH {_VERSIONS} SELECT name, version, CASE WHEN version = 3 THEN 'Staging' ELSE 'Archived' END AS stage, run_id FROM cur
      WHERE name = 'model-7' AND (version = 3 OR stage = 'Staging')""",
)
def promotion(spark, sf_dir):
    out = C.promotion_events(version_events(spark, sf_dir), "model-7", 3, "Staging", F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))
    return out.select("name", "version", "stage", "run_id")


@query(
    "j20_best_model",
    f"""WITH {_VERSIONS}, top AS (SELECT run_id, metric_value FROM ev ORDER BY metric_value DESC, run_id LIMIT 5)
    SELECT run_id, metric_value, version, stage FROM (SELECT t.run_id, t.metric_value, c.version, c.stage FROM top t LEFT JOIN (SELECT * FROM cur WHERE stage = 'Production') c USING (run_id))
      ORDER BY stage IS NULL, metric_value DESC, run_id LIMIT 1""",
)
def best_model(spark, sf_dir):
    events = version_events(spark, sf_dir)
    return C.best_model(events.select("run_id", "metric_value"), "metric_value", C.latest_versions(events).select("run_id", "version", "stage"))


@query(
    "j22_update_status",
    """SELECT count(*) AS updates, count(*) FILTER (WHERE o_orderstatus = 'F') AS promotions, max(t) AS last_update, max_by(v, t) AS last_version, max_by(o_totalprice, t) AS last_quality
    FROM (SELECT *, CAST(o_orderkey AS INT) AS v, o_orderdate + to_microseconds(o_orderkey) AS t FROM orders)""",
)
def update_status(spark, sf_dir):
    history = table(spark, sf_dir, "orders").selectExpr(
        "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey / 1000000D) AS update_ts",
        "CAST(o_orderkey AS INT) AS version",
        "o_totalprice AS quality",
        "o_orderstatus = 'F' AS promoted",
    )
    return C.update_status(history)
