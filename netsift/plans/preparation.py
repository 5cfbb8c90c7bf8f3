"""Cleaning and feature preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netsift.operators import flows
from netsift.operators import prepare as P
from netsift.plans.catalogue import query
from netsift.plans.tables import packets, table, with_packets
from netsift.sources.datasets import read_dataset


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# line items with gaps: every 7th price, every 11th discount and every 5th flag is missing
GAPS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS row_id, CASE WHEN l_orderkey % 7 > 0 THEN l_extendedprice END AS price,
  CASE WHEN l_partkey % 11 > 0 THEN l_discount END AS discount, l_quantity AS quantity,
  CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS flag, l_linestatus AS status, CAST(l_suppkey % 2 AS INT) AS label FROM lineitem"""


def gaps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS row_id",
        "CASE WHEN l_orderkey % 7 > 0 THEN l_extendedprice END AS price",
        "CASE WHEN l_partkey % 11 > 0 THEN l_discount END AS discount",
        "l_quantity AS quantity",
        "CASE WHEN l_partkey % 5 > 0 THEN l_returnflag END AS flag",
        "l_linestatus AS status",
        "CAST(l_suppkey % 2 AS INT) AS label",
    )


_COLUMNS = ["row_id", "price", "discount", "quantity", "flag", "status", "label"]


@query("a1_read_dataset", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
def read(spark, sf_dir):
    df = read_dataset(spark, f"{sf_dir}/lineitem.parquet")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    "c1_missing_report",
    f"WITH g AS ({GAPS_SQL}) " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(*) AS rows FROM g""" for c in _COLUMNS),
)
def missing_report(spark, sf_dir):
    return P.missing_report(gaps(spark, sf_dir))


@query(
    "c2_impute_median",
    f"""WITH g AS ({GAPS_SQL}), m AS (SELECT quantile_cont(price, 0.5) AS p, quantile_cont(discount, 0.5) AS d FROM g)
    SELECT row_id, round(coalesce(price, p), 6) AS price, round(coalesce(discount, d), 6) AS discount FROM g, m""",
)
def impute_median(spark, sf_dir):
    out = P.impute_median(gaps(spark, sf_dir), ["price", "discount"])
    return _round(out.select("row_id", "price", "discount"), "price", "discount")


@query(
    "c3_impute_mode",
    f"""WITH g AS ({GAPS_SQL}), m AS (SELECT flag AS f FROM g WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT row_id, coalesce(flag, f) AS flag, status FROM g, m""",
)
def impute_mode(spark, sf_dir):
    return P.impute_mode(gaps(spark, sf_dir)).select("row_id", "flag", "status")


@query("c4_dedupe", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def dedupe(spark, sf_dir):
    return P.dedupe(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query(
    "c5_factorize",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS priority, 'c' || CAST(o_custkey AS VARCHAR) AS customer FROM orders),
    a AS (SELECT priority AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM o WHERE priority IS NOT NULL GROUP BY 1),
    b AS (SELECT customer AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM o GROUP BY 1)
    SELECT o_orderkey, CAST(coalesce(a.code, -1) AS INT) AS priority, CAST(b.code AS INT) AS customer FROM o LEFT JOIN a ON priority = a.v JOIN b ON customer = b.v""",
)
def factorize(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS priority", "concat('c', o_custkey) AS customer"
    )
    return P.factorize(o, ["priority", "customer"], "o_orderkey")


@query("c6_split_label", "SELECT o_orderkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def split_label(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    features, labels = P.split_label(orders, "o_orderstatus", "o_orderkey")
    return features.join(labels, "o_orderkey")


@query(
    "c7_standard_scale",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS quantity,
      round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS tax, CAST(0 AS DOUBLE) AS one FROM lineitem""",
)
def standard_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS quantity", "l_tax AS tax", "1D AS one")
    return _round(P.standard_scale(df, ["quantity", "tax", "one"]), "quantity", "tax", "one")


@query(
    "c8_minmax_scale",
    """SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()), 6) AS quantity,
      CAST(0 AS DOUBLE) AS one FROM lineitem""",
)
def minmax_scale(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS quantity", "1D AS one")
    return _round(P.minmax_scale(df, ["quantity", "one"]), "quantity", "one")


@query(
    "c9_preprocess",
    f"""WITH g AS ({GAPS_SQL}),
    m AS (SELECT quantile_cont(price, 0.5) AS p, quantile_cont(discount, 0.5) AS d FROM g),
    f AS (SELECT flag AS f FROM g WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    c AS (SELECT min(row_id) AS row_id, coalesce(price, p) AS price, coalesce(discount, d) AS discount, quantity, coalesce(flag, f) AS flag, status, label
      FROM g, m, f GROUP BY 2, 3, 4, 5, 6, 7),
    cf AS (SELECT flag AS v, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM c GROUP BY 1),
    cs AS (SELECT status AS v, row_number() OVER (ORDER BY min(row_id)) - 1 AS code FROM c GROUP BY 1),
    e AS (SELECT row_id, price, discount, quantity, cf.code AS flag, cs.code AS status, label FROM c JOIN cf ON flag = cf.v JOIN cs ON status = cs.v)
    SELECT row_id, """
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 5) AS {c}" for c in ("price", "discount", "quantity", "flag", "status"))
    + ", label FROM e",
)
def preprocess(spark, sf_dir):
    _, out = P.Preprocessor("row_id", label="label").fit_transform(gaps(spark, sf_dir))
    return _round(out, "price", "discount", "quantity", "flag", "status", digits=5)


@query(
    "c10_prepare_flows",
    with_packets("""SELECT coalesce(src_port % 4, 0) AS src_port, coalesce(dst_port, 0) AS dst_port, count(*) AS packet_count,
      CAST(protocol = 'TCP' AS INT) AS "protocol_TCP", CAST(protocol = 'UDP' AS INT) AS "protocol_UDP", CAST(protocol = 'ICMP' AS INT) AS "protocol_ICMP",
      CAST(CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256
        + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS DOUBLE) AS src_ip_numeric,
      CAST(CAST(split_part(dst_ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(dst_ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(dst_ip, '.', 3) AS BIGINT) * 256
        + CAST(split_part(dst_ip, '.', 4) AS BIGINT) AS DOUBLE) AS dst_ip_numeric
    FROM packets GROUP BY src_ip, dst_ip, protocol, 1, 2"""),
)
def prepare_flows(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("src_port", F.col("src_port") % 4)
    f = flows.flow_features(p).select("protocol", "src_ip", "src_port", "dst_ip", "dst_port", "packet_count")
    return P.prepare_flows(f)


_NUMBERS = ["price", "discount", "quantity"]


@query(
    "c11_profile",
    f"WITH g AS ({GAPS_SQL}) "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing, count(*) AS rows, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
        round(max({c}), 4) AS max FROM g"""
        for c in _NUMBERS
    )
    + """ UNION ALL SELECT 'flag', count(*) - count(flag), count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g""",
)
def profile(spark, sf_dir):
    out = P.profile(gaps(spark, sf_dir).select(*_NUMBERS, "flag")).drop("type")
    return _round(out, "mean", "std", "min", "q25", "q50", "q75", "max", digits=4)
