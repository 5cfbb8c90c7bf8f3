"""Compare queries with their SQL checks: ``python tools/check.py [--sf DIR] [name prefix ...]``."""

from __future__ import annotations

import argparse
import datetime as dt
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netsift.plans import catalogue  # noqa: E402
from netsift.plans.tables import TABLES  # noqa: E402


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    return value


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plan = df._jdf.queryExecution().executedPlan().toString()
    cross = [j for j in ("CartesianProduct", "BroadcastNestedLoopJoin") if j in plan]
    nested = [f"{n}:{t}" for n, t in types.items() if t.startswith(("array", "map", "struct", "decimal"))]
    sql = catalogue.ORACLES.get(name)
    if sql is None:
        return took, f"rows only ({len(got)})" + (f" CROSS {cross}" if cross else "")
    start = time.time()
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    sql_took = time.time() - start
    cols, have = rows_of(df.columns, got)
    if cols != want_cols:
        return took, f"FAIL columns {cols} != {want_cols}"
    if len(have) != len(want):
        return took, f"FAIL rows {len(have)} != {len(want)}; first: {have[:2]} {want[:2]}"
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    note = f" nested {nested}" if nested else ""
    empty = " EMPTY" if not have else ""
    if bad:
        return took, f"FAIL {len(bad)} of {len(have)} rows, columns {cols}: {bad[0]}{note}"
    mixed = [
        f"{c}" for i, c in enumerate(cols) if have and type(have[0][i]) is not type(want[0][i]) and None not in (have[0][i], want[0][i])
    ]
    return took, f"ok {len(have)} rows, sql {sql_took:.1f}s{empty}{note}" + (f" TYPES {mixed}" if mixed else "") + (f" CROSS {cross}" if cross else "")


def main():
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    catalogue.load()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{opts.sf}/{t}.parquet'")
    failed = 0
    for name in catalogue.QUERIES:
        if opts.names and not any(name.startswith(p) for p in opts.names):
            continue
        try:
            took, text = compare(spark, con, name, opts.sf)
        except Exception as error:
            took, text = 0.0, f"ERROR {type(error).__name__}: {str(error)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += text.startswith(("FAIL", "ERROR"))
        print(f"{name:34s} {took:6.1f}s  {text}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
