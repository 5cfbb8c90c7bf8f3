"""Detector queries on the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from netsift.operators import learning as L
from netsift.operators import models as M
from netsift.plans.catalogue import query
from netsift.plans.tables import packets, table, with_packets


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


def points(spark, sf_dir):
    """Customers and their orders in three numbers, as low-dimensional points."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_acctbal / 1000 AS a", "CAST(c_nationkey AS DOUBLE) AS b", "CAST(length(c_mktsegment) AS DOUBLE) AS c"
    )


@query("j1_isolation_forest")
def isolation_forest(spark, sf_dir):
    df = vectors(spark, sf_dir)
    fitted = M.get_detector("isolation_forest", features=["embedding"], id_col="vec_id").fit(df)
    return fitted.transform(df).select("vec_id", F.round("score", 6).alias("score"), "is_anomaly")


@query("j2_score_packets")
def score_packets(spark, sf_dir):
    p = packets(spark, sf_dir).select("packet_id", "length", "ttl", F.coalesce("dst_port", F.lit(0)).alias("dst_port"))
    fitted = M.get_detector("isolation_forest", features=["length", "ttl", "dst_port"], id_col="packet_id").fit(p)
    return fitted.transform(p).select("packet_id", F.round("score", 6).alias("score"), "is_anomaly")


EPS = 0.6
_POINTS = """p AS MATERIALIZED (SELECT c_custkey AS id, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b, CAST(length(c_mktsegment) AS DOUBLE) AS c FROM customer)"""
_DBSCAN = f"""RECURSIVE {_POINTS},
  e AS MATERIALIZED (SELECT x.id AS i, y.id AS j FROM p x JOIN p y ON x.b = y.b AND x.c = y.c AND abs(x.a - y.a) <= {EPS}),
  core AS MATERIALIZED (SELECT i FROM e GROUP BY i HAVING count(*) >= 5),
  links AS MATERIALIZED (SELECT e.i, e.j FROM e SEMI JOIN core c ON e.i = c.i SEMI JOIN core d ON e.j = d.i),
  reach AS (SELECT i, i AS root FROM core UNION SELECT links.j, reach.root FROM reach JOIN links ON links.i = reach.i),
  root AS MATERIALIZED (SELECT i, min(root) AS root FROM reach GROUP BY i),
  num AS MATERIALIZED (SELECT root, CAST(row_number() OVER (ORDER BY root) - 1 AS INT) AS cluster FROM (SELECT DISTINCT root FROM root)),
  lab AS (SELECT e.i AS id, min(num.cluster) AS cluster FROM e JOIN root ON root.i = e.j JOIN num USING (root) GROUP BY e.i)"""


@query("j3_dbscan", f"WITH {_DBSCAN} SELECT id AS c_custkey, coalesce(cluster, -1) AS cluster FROM p LEFT JOIN lab USING (id)")
def dbscan(spark, sf_dir):
    df = points(spark, sf_dir)
    return M.Dbscan(["a", "b", "c"], "c_custkey", EPS, 5).fit(df).labels(df)


@query(
    "j4_dbscan_score",
    f"""WITH {_DBSCAN}, s AS (SELECT s_suppkey, s_acctbal / 900 AS a, CAST(s_nationkey AS DOUBLE) + 0.3 AS b, 9.0 AS c FROM supplier)
    SELECT s_suppkey, round(coalesce(min(d), 1), 6) AS score, coalesce(min(d), 1) > {EPS} AS is_anomaly
    FROM (SELECT s_suppkey, sqrt((s.a - p.a) ** 2 + (s.b - p.b) ** 2 + (s.c - p.c) ** 2) AS d FROM s LEFT JOIN (p SEMI JOIN core ON core.i = p.id) ON true) GROUP BY 1""",
)
def dbscan_score(spark, sf_dir):
    fitted = M.Dbscan(["a", "b", "c"], "c_custkey", EPS, 5).fit(points(spark, sf_dir))
    fitted.id_col = "s_suppkey"
    new = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_acctbal / 900 AS a", "CAST(s_nationkey AS DOUBLE) + 0.3D AS b", "9D AS c")
    return fitted.transform(new).select("s_suppkey", F.round("score", 6).alias("score"), "is_anomaly")


_LOF = """e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings), tr AS MATERIALIZED (SELECT * FROM e),
  pairs AS MATERIALIZED (SELECT q, p, d FROM (SELECT a.id AS q, b.id AS p, list_distance(a.x, b.x) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM tr a, tr b WHERE a.id <> b.id) WHERE r <= 20),
  kd AS MATERIALIZED (SELECT q AS id, max(d) AS kd FROM pairs GROUP BY 1),
  lrd AS MATERIALIZED (SELECT q AS id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM pairs JOIN kd ON kd.id = p GROUP BY 1),
  tl AS MATERIALIZED (SELECT q AS id, avg(o.lrd) / max(m.lrd) AS lof FROM pairs JOIN lrd o ON o.id = p JOIN lrd m ON m.id = q GROUP BY 1),
  cut AS (SELECT quantile_cont(lof, 0.9) AS c FROM tl),
  np AS MATERIALIZED (SELECT q, p, d FROM (SELECT a.id AS q, b.id AS p, list_distance(a.x, b.x) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS r FROM e a, tr b) WHERE r <= 20),
  nl AS MATERIALIZED (SELECT q AS id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM np JOIN kd ON kd.id = p GROUP BY 1),
  s AS (SELECT q AS id, avg(o.lrd) / max(m.lrd) - max(c) AS score FROM np JOIN lrd o ON o.id = p JOIN nl m ON m.id = q, cut GROUP BY 1)"""


@query("j5_lof", f"WITH {_LOF} SELECT id AS vec_id, round(score, 5) AS score, score > 0 AS is_anomaly FROM s")
def lof(spark, sf_dir):
    df = vectors(spark, sf_dir)
    fitted = M.Lof(["embedding"], "vec_id", 20, 0.1).fit(df)
    return fitted.transform(df).select("vec_id", F.round("score", 5).alias("score"), "is_anomaly")


@query("j6_one_class_svm")
def one_class_svm(spark, sf_dir):
    df = vectors(spark, sf_dir)
    fitted = M.OneClassSvm(["embedding"]).fit(df)
    return fitted.transform(df).select("vec_id", F.round("score", 6).alias("score"), "is_anomaly")


@query("j7_train_and_score")
def train_and_score(spark, sf_dir):
    """Two kinds of detector through the common interface."""
    p = points(spark, sf_dir)
    out = None
    for kind, options in (
        ("isolation_forest", {"features": ["a", "b", "c"], "id_col": "c_custkey"}),
        ("one_class_svm", {"features": ["a", "b", "c"]}),
    ):
        part = M.score(M.train(p, kind, **options), p).select(F.lit(kind).alias("detector"), "c_custkey", F.round("score", 6).alias("score"), "is_anomaly")
        out = part if out is None else out.unionByName(part)
    return out


@query("j15_refine_uncertain")
def refine_uncertain(spark, sf_dir):
    rows = points(spark, sf_dir).selectExpr("c_custkey", "a", "b", "c", "a AS score", "false AS is_anomaly", "true AS is_uncertain")
    out = L.refine_uncertain(rows, ["a", "b", "c"], "score", "c_custkey")
    return out.select("c_custkey", "cluster", "is_anomaly", "is_uncertain")


def _logistic(frame):
    z = (frame["length"] - 200) / 50.0 + (frame["ttl"] == 32) * 0.5
    return 1.0 / (1.0 + np.exp(-z.to_numpy(dtype=float)))


@query(
    "j21_score_with",
    with_packets("""SELECT packet_id, round(p, 6) AS probability FROM
      (SELECT packet_id, 1 / (1 + exp(-((length - 200) / 50.0::DOUBLE + CASE WHEN ttl = 32 THEN 0.5 ELSE 0 END))) AS p FROM packets) WHERE p > 0.7"""),
)
def score_with(spark, sf_dir):
    p = packets(spark, sf_dir).select("packet_id", "length", "ttl")
    return M.score_with(p, _logistic, 0.7).select("packet_id", F.round("probability", 6).alias("probability"))
