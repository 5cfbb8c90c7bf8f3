"""Queries with parts that a user brings: a rule, a threshold function, an evaluator; and saved models and states."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from netsift.operators import drift as D
from netsift.operators import models as M
from netsift.operators import rules as R
from netsift.operators import thresholds as H
from netsift.operators.models.density import FittedDbscan
from netsift.plans.catalogue import query
from netsift.plans.live import replay, shared_folder
from netsift.plans.models import _DBSCAN, EPS, points
from netsift.plans.quality import FEATURES, _DRIFT, early_and_late
from netsift.plans.series import _EWMA, _ORDER, _SERIES, series
from netsift.plans.tables import packets, table, with_packets


@dataclass
class LongPayloadRule(R.SignatureRule):
    """Payloads of at least so many bytes towards one half of the ports."""

    least: int = 0
    kind = "long_payload"

    def column(self) -> Column:
        return (F.col("payload_len") >= self.least) & (F.col("dst_port") < 1024)


@query(
    "u1_rule_subclass",
    with_packets("""SELECT packet_id, CASE WHEN payload_len >= 150 AND dst_port < 1024 THEN 'LONG' ELSE 'PORT' END AS rule_id
      FROM packets WHERE (payload_len >= 150 AND dst_port < 1024) OR dst_port IN (22, 3306)"""),
)
def rule_subclass(spark, sf_dir):
    rules = [LongPayloadRule("LONG", "long payload", least=150), R.PortRule("PORT", "ports", port_list=[22, 3306])]
    return R.check_signatures(packets(spark, sf_dir), rules).select("packet_id", "rule_id")


def highest_so_far(df, keys=("feature",), ts="ts", tie="row_id", value="value", last=10):
    """A user's threshold: the largest of the last values."""
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    return df.withColumns({"threshold": F.max(value).over(order.rowsBetween(1 - last, 0)), "previous_threshold": F.max(value).over(order.rowsBetween(-last, -1))})


@query(
    "u4_threshold_function",
    f"""WITH {_SERIES}, t AS (SELECT *, max(value) OVER ({_ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS p FROM s)
    SELECT feature, row_id, CASE WHEN feature <> 'error' THEN p END AS previous_threshold, coalesce(feature <> 'error' AND value > p, false) AS is_anomaly FROM t""",
)
def threshold_function(spark, sf_dir):
    rows = series(spark, sf_dir)
    known = [r[0] for r in rows.select("feature").where(F.col("feature") != "error").distinct().collect()]  # event types
    plan = [H.ThresholdPlan(f, highest_so_far, {"last": 10}) for f in sorted(known)]
    return H.apply_thresholds(rows, plan).select("feature", "row_id", "previous_threshold", "is_anomaly")


@query(
    "u6_evaluator",
    f"""WITH {_DRIFT}, p AS (SELECT avg(l_discount) AS p FROM items WHERE NOT early)
    SELECT (SELECT count(*) FROM items WHERE NOT early) AS rows, round(max(ks), 6) AS drift_score, round((SELECT p FROM p), 6) AS current_performance,
      (SELECT p FROM p) < 0.2 - 0.1 AS performance_degradation FROM d""",
)
def evaluator(spark, sf_dir):
    """The evaluator is a function of the current sample."""
    report = D.drift_report(*early_and_late(spark, sf_dir), FEATURES, performance=lambda current: current.agg(F.avg("l_discount")).first()[0], baseline=0.2)
    return report.select("rows", F.round("drift_score", 6).alias("drift_score"), F.round("current_performance", 6).alias("current_performance"), "performance_degradation")


@query("k1_packet_stream", with_packets("SELECT packet_id, ts, protocol, src_ip, dst_ip, src_port, dst_port, length, payload, urg FROM packets"))
def packet_stream(spark, sf_dir):
    """JSON lines through a stream, folder by folder."""
    found = replay(spark, packets(spark, sf_dir), lambda stream: stream.where("packet_id IS NOT NULL"), "packets", slices=2)
    return found.select("packet_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "protocol", "src_ip", "dst_ip", "src_port", "dst_port", "length", "payload", F.col("tcp_flags.urg").alias("urg"))


@query(
    "j8_saved_detector",
    f"""WITH {_DBSCAN}, s AS (SELECT s_suppkey, s_acctbal / 900 AS a, CAST(s_nationkey AS DOUBLE) + 0.3 AS b, 9.0 AS c FROM supplier)
    SELECT s_suppkey, round(coalesce(min(d), 1), 6) AS score, coalesce(min(d), 1) > {EPS} AS is_anomaly
    FROM (SELECT s_suppkey, sqrt((s.a - p.a) ** 2 + (s.b - p.b) ** 2 + (s.c - p.c) ** 2) AS d FROM s LEFT JOIN (p SEMI JOIN core ON core.i = p.id) ON true) GROUP BY 1""",
)
def saved_detector(spark, sf_dir):
    """A detector that is fitted, saved, loaded and applied to other rows."""
    path = shared_folder(spark, "detector")
    M.Dbscan(["a", "b", "c"], "c_custkey", EPS, 5).fit(points(spark, sf_dir)).save(path)
    fitted = FittedDbscan.load(spark, path)
    fitted.id_col = "s_suppkey"
    new = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal / 900 AS a", "CAST(s_nationkey AS DOUBLE) + 0.3D AS b", "9D AS c")
    return fitted.transform(new).select("s_suppkey", F.round("score", 6).alias("score"), "is_anomaly")


@query(
    "f15_saved_state",
    f"""WITH {_EWMA}, last AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY feature ORDER BY i DESC) = 1)
    SELECT feature, round(m, 4) AS ewma, round(v, 3) AS ewmvar, least(i, 100) AS recent FROM last""",
)
def saved_state(spark, sf_dir):
    """The state that a later run starts from: the last mean and variance, and how many recent values are kept."""
    path = os.path.join(shared_folder(spark, "thresholds"), "saved")
    H.save_threshold_state(H.ewma_threshold(series(spark, sf_dir)), path)
    state, recent = H.load_threshold_state(spark, path)
    counts = recent.groupBy(F.col("feature").alias("_f")).agg(F.count(F.lit(1)).alias("recent"))
    return state.join(counts, F.col("feature") == F.col("_f")).select("feature", F.round("ewma", 4).alias("ewma"), F.round("ewmvar", 3).alias("ewmvar"), "recent")
