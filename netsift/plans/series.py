"""Threshold and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import detections as D
from netsift.operators import thresholds as H
from netsift.plans.catalogue import query
from netsift.plans.tables import table


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def series(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), "ts", F.col("event_id").alias("row_id"), "value")


_SERIES = "s AS (SELECT event_type AS feature, ts, event_id AS row_id, value FROM events)"
_ORDER = "PARTITION BY feature ORDER BY ts, row_id"


@query(
    "f3_moving_threshold",
    f"""WITH {_SERIES}, m AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w + 3 * stddev_pop(value) OVER w AS t, lag(value) OVER (ORDER BY ts) AS x FROM s
      WINDOW w AS ({_ORDER} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
    SELECT feature, row_id, round(CASE WHEN n > 1 THEN t END, 4) AS threshold,
      round(CASE WHEN lag(n) OVER ({_ORDER}) > 1 THEN lag(t) OVER ({_ORDER}) END, 4) AS previous_threshold FROM m""",
)
def moving_threshold(spark, sf_dir):
    out = H.moving_threshold(series(spark, sf_dir))
    finite = {c: F.when(F.col(c) < float("inf"), F.round(c, 4)) for c in ("threshold", "previous_threshold")}
    return out.withColumns(finite).select("feature", "row_id", "threshold", "previous_threshold")


_EWMA = f"""RECURSIVE {_SERIES}, o AS MATERIALIZED (SELECT *, row_number() OVER ({_ORDER}) AS i FROM s),
  e AS (SELECT feature, row_id, i, value, CAST(value AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM o WHERE i = 1
    UNION ALL SELECT o.feature, o.row_id, o.i, o.value, 0.3::DOUBLE * o.value + 0.7::DOUBLE * e.m, 0.7::DOUBLE * (e.v + 0.3::DOUBLE * (o.value - e.m) ** 2)
    FROM e JOIN o ON o.feature = e.feature AND o.i = e.i + 1)"""


@query("f4_ewma_threshold", f"WITH {_EWMA} SELECT feature, row_id, round(m, 4) AS ewma, round(m + 3 * sqrt(v), 4) AS threshold FROM e")
def ewma_threshold(spark, sf_dir):
    out = H.ewma_threshold(series(spark, sf_dir))
    return _round(out.select("feature", "row_id", "ewma", "threshold"), "ewma", "threshold", digits=4)


_SEASONAL = f"""{_SERIES}, o AS (SELECT *, row_number() OVER ({_ORDER}) AS rn, (row_number() OVER ({_ORDER}) - 1) % 24 AS phase FROM s),
  t AS (SELECT *, CASE WHEN rn >= 24 THEN avg(value) OVER (PARTITION BY feature ORDER BY rn ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) END AS t FROM o),
  d AS (SELECT *, value - t AS d FROM t),
  z AS (SELECT *, avg(d) OVER (PARTITION BY feature, phase ORDER BY rn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS z FROM d),
  r AS (SELECT *, d - z AS e, CASE WHEN rn = 1 THEN 0 ELSE value END AS raw FROM z),
  q AS (SELECT *, CASE WHEN rn < 48 THEN stddev_pop(raw) OVER w ELSE stddev_pop(e) OVER w END AS sd FROM r
    WINDOW w AS (PARTITION BY feature ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
  f AS (SELECT feature, row_id, rn, value, CASE WHEN rn < 48 THEN 0 ELSE t END AS trend, CASE WHEN rn < 48 THEN 0 ELSE z END AS seasonal, sd FROM q),
  u AS (SELECT *, trend + seasonal + 3 * sd AS threshold, coalesce(trend - lag(trend) OVER (PARTITION BY feature ORDER BY rn), 0) AS slope FROM f)"""


@query("f5_seasonal_threshold", f"WITH {_SEASONAL} SELECT feature, row_id, round(trend, 8) AS trend, round(seasonal, 8) AS seasonal, round(threshold, 6) AS threshold FROM u")
def seasonal_threshold(spark, sf_dir):
    out = H.seasonal_threshold(series(spark, sf_dir)).select("feature", "row_id", "trend", "seasonal", "threshold")
    return _round(_round(out, "threshold"), "trend", "seasonal", digits=8)


@query(
    "f5_stl_threshold",
    f"""WITH {_SERIES}, o AS (SELECT *, row_number() OVER ({_ORDER}) AS rn FROM s),
      r AS (SELECT *, CASE WHEN rn = 1 THEN 0 ELSE value END AS raw FROM o),
      e AS (SELECT *, 3 * stddev_pop(raw) OVER (PARTITION BY feature ORDER BY rn ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS early FROM r)
    SELECT feature, row_id, rn AS position, CASE WHEN rn = 1 THEN 0 ELSE round(value, 6) END AS recomposed, CASE WHEN rn < 48 THEN round(early, 6) END AS early_threshold, true AS above FROM e""",
)
def stl_threshold(spark, sf_dir):
    """Parts add up to the values, thresholds lie above trend and season, and before two periods they are determined."""
    out = H.stl_threshold(series(spark, sf_dir)).withColumn("recomposed", F.col("trend") + F.col("seasonal") + F.col("residual"))
    early = F.when(F.col("position") < 48, F.round("threshold", 6))
    return out.select("feature", "row_id", "position", F.round("recomposed", 6).alias("recomposed"), early.alias("early_threshold"), (F.col("threshold") >= F.col("trend") + F.col("seasonal")).alias("above"))


@query(
    "f6_seasonal_forecast",
    f"""WITH {_SEASONAL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rn DESC) AS back FROM u) WHERE back = 1)
    SELECT l.feature, CAST(h AS INT) AS step, round(l.trend + l.slope * h + u.seasonal, 8) AS forecast, round(l.trend + l.slope * h + u.seasonal + 3 * l.sd, 6) AS threshold
    FROM l, range(1, 37) t(h), u WHERE u.feature = l.feature AND u.rn = l.rn - 24 + (h - 1) % 24 + 1""",
)
def seasonal_forecast(spark, sf_dir):
    out = H.seasonal_forecast(H.seasonal_threshold(series(spark, sf_dir)), 36)
    return _round(_round(out, "threshold"), "forecast", digits=8)


@query(
    "f7_flag_over_threshold",
    f"""WITH {_EWMA} SELECT feature, count(*) AS rows, count(*) FILTER (WHERE value > p) AS anomalies FROM
      (SELECT *, lag(m + 3 * sqrt(v)) OVER (PARTITION BY feature ORDER BY i) AS p FROM e) GROUP BY 1""",
)
def flag_over_threshold(spark, sf_dir):
    out = H.flag_over_threshold(H.ewma_threshold(series(spark, sf_dir)))
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_anomaly").alias("anomalies"))


@query(
    "f8_apply_thresholds",
    f"""WITH {_EWMA}, a AS (SELECT feature, row_id, value, lag(m + 3 * sqrt(v)) OVER (PARTITION BY feature ORDER BY i) AS p FROM e WHERE feature = 'click'),
      b AS (SELECT feature, row_id, value, CASE WHEN n > 1 THEN t END AS p FROM (SELECT *, count(*) OVER w AS n, avg(value) OVER w + 2 * stddev_pop(value) OVER w AS t FROM s
        WHERE feature IN ('view', 'error') WINDOW w AS ({_ORDER} ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))),
      c AS (SELECT feature, row_id, NULL::DOUBLE AS value, NULL::DOUBLE AS p FROM s WHERE feature NOT IN ('click', 'view', 'error'))
    SELECT feature, row_id, coalesce(value > p, false) AS is_anomaly FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""",
)
def apply_thresholds(spark, sf_dir):
    moving = {"window": 50, "k": 2.0}
    plan = [H.ThresholdPlan("click", "ewma"), H.ThresholdPlan("view", "moving", moving), H.ThresholdPlan("error", "moving", moving)]
    return H.apply_thresholds(series(spark, sf_dir), plan).select("feature", "row_id", "is_anomaly")


@query(
    "f9_debounce",
    """WITH RECURSIVE h AS MATERIALIZED (SELECT event_type AS camera, epoch_us(ts) AS us, event_id FROM events),
    k AS (SELECT camera, min(us) AS us FROM h GROUP BY 1
      UNION ALL SELECT k.camera, (SELECT min(h.us) FROM h WHERE h.camera = k.camera AND h.us >= k.us + 3600000000) FROM k WHERE k.us IS NOT NULL)
    SELECT camera, event_id FROM h JOIN k USING (camera, us)""",
)
def debounce(spark, sf_dir):
    hits = table(spark, sf_dir, "events").select(F.col("event_type").alias("camera"), "ts", "event_id")
    return D.debounce(hits, "camera", "ts", 3600, "event_id", slice_seconds=86400).select("camera", "event_id")


@query("f10_sample_frames", "SELECT event_id FROM events WHERE event_id % 5 = 0 OR event_id = 1")
def sample_frames(spark, sf_dir):
    return D.sample_frames(table(spark, sf_dir, "events").select("event_id"), 5, "event_id")


def boxes(spark, sf_dir):
    """Regions of an image (a part) from order lines."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "concat('img-', CAST(l_partkey % 500 AS STRING)) AS image",
        "l_orderkey * 10 + l_linenumber AS box_id",
        "CAST(l_suppkey % 97 * 5 AS INT) AS x",
        "CAST(l_orderkey % 89 * 4 AS INT) AS y",
        "CAST(l_quantity * (4 + l_suppkey % 5) AS INT) AS w",
        "CAST(l_quantity * (1 + l_linenumber % 3) AS INT) AS h",
        "l_extendedprice AS confidence",
        "CAST(l_quantity * (4 + l_suppkey % 5) * (l_quantity * (1 + l_linenumber % 3)) AS DOUBLE) AS area",
        "l_orderkey",
    )


@query(
    "f11_plate_candidates",
    """WITH b AS (SELECT 'img-' || CAST(l_partkey % 500 AS VARCHAR) AS image, CAST(l_suppkey % 97 * 5 AS INT) AS x, CAST(l_orderkey % 89 * 4 AS INT) AS y,
      CAST(l_quantity * (4 + l_suppkey % 5) AS INT) AS w, CAST(l_quantity * (1 + l_linenumber % 3) AS INT) AS h,
      l_quantity * (4 + l_suppkey % 5) * (l_quantity * (1 + l_linenumber % 3)) AS area FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, x, y, w, h) AS k FROM b)
    SELECT image, x, y, w, h FROM r WHERE k <= 10 AND w / h > 2 AND w / h < 6 AND w > 100 AND h > 20""",
)
def plate_candidates(spark, sf_dir):
    return D.plate_candidates(boxes(spark, sf_dir)).select("image", "x", "y", "w", "h")


@query(
    "f12_nms",
    """WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY confidence DESC, box_id) AS rn FROM (
    SELECT 'img-' || CAST(l_partkey % 500 AS VARCHAR) AS image, l_orderkey * 10 + l_linenumber AS box_id, CAST(l_suppkey % 97 * 5 AS INT) AS x,
      CAST(l_orderkey % 89 * 4 AS INT) AS y, CAST(l_quantity * (4 + l_suppkey % 5) AS INT) AS w, CAST(l_quantity * (1 + l_linenumber % 3) AS INT) AS h,
      l_extendedprice AS confidence FROM lineitem)),
  step AS (SELECT image, rn, [rn] AS ids, [[x, y, x + w, y + h, w * h]] AS kept FROM b WHERE rn = 1
    UNION ALL SELECT image, rn, CASE WHEN stays THEN list_append(ids, rn) ELSE ids END, CASE WHEN stays THEN list_append(kept, own) ELSE kept END FROM (
      SELECT b.image, b.rn, s.ids, s.kept, [x, y, x + w, y + h, w * h] AS own,
        len(list_filter(s.kept, lambda k: greatest(least(x + w, k[3]) - greatest(x, k[1]), 0) * greatest(least(y + h, k[4]) - greatest(y, k[2]), 0)
          > 0.4 * (w * h + k[5] - greatest(least(x + w, k[3]) - greatest(x, k[1]), 0) * greatest(least(y + h, k[4]) - greatest(y, k[2]), 0)))) = 0 AS stays
      FROM step s JOIN b ON b.image = s.image AND b.rn = s.rn + 1)),
  ends AS (SELECT image, unnest(ids) AS rn FROM (SELECT image, arg_max(ids, rn) AS ids FROM step GROUP BY image))
SELECT image, box_id, x, y, w, h, confidence FROM ends JOIN b USING (image, rn)""",
)
def nms(spark, sf_dir):
    return D.nms(boxes(spark, sf_dir).withColumn("class", F.lit("license_plate")), 0.4).select("image", "box_id", "x", "y", "w", "h", "confidence")


@query(
    "e23_vote_plate",
    """WITH r AS (SELECT l_partkey % 900 AS video, l_orderkey AS o, regexp_replace(upper(substr(l_returnflag || l_linestatus || '-' || CAST(l_suppkey % 6 * 7 AS VARCHAR), 1, 5)), '[^A-Z0-9]', '', 'g') AS t FROM lineitem),
    c AS (SELECT video, t, count(*) AS n, min(o) AS f FROM r WHERE length(t) BETWEEN 4 AND 10 GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY n DESC, f, t) AS k FROM c)
    SELECT v.video, coalesce(b.t, 'No valid license plate detected') AS plate, coalesce(n, 0) AS votes FROM (SELECT DISTINCT video FROM r) v LEFT JOIN b ON b.video = v.video AND k = 1""",
)
def vote_plate(spark, sf_dir):
    readings = table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey % 900 AS video", "l_orderkey", "left(concat(l_returnflag, l_linestatus, '-', CAST(l_suppkey % 6 * 7 AS STRING)), 5) AS raw_text"
    )
    return D.vote_plate(readings, "video", "l_orderkey")
