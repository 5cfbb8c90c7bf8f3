import random

import numpy as np
from pyspark.sql import functions as F

from netsift.operators import ordering as O


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")


def test_order_values_narrow_to_the_exact_ranks(spark):
    rng = random.Random(1)
    values = [rng.choice([1.0, 2.0, 2.0, 2.0, rng.random() * 100]) for _ in range(3000)]
    df = numbers(spark, values).repartition(5)
    ranks = [0, 1, 700, 1500, 2250, 2998, 2999]
    n, found = O.order_values(df, {"v": lambda n: ranks}, exact_limit=50)["v"]
    assert n == 3000
    assert [found[k] for k in ranks] == [sorted(values)[k] for k in ranks]


def test_quantiles_interpolate_and_skip_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (float("nan"),), (10.0,)], "v double")
    got = O.quantiles(df, {"v": [0.25, 0.5, 0.9]})["v"]
    want = np.quantile([1, 2, 4, 10], [0.25, 0.5, 0.9])
    assert np.allclose([got[0.25], got[0.5], got[0.9]], want)


def test_running_totals_over_parts(spark):
    rng = random.Random(2)
    rows = [(k, float(v), rng.randint(0, 9)) for k in ("a", "b") for v in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k string, v double, n long").repartition(4)
    for descending in (False, True):
        got = O.running_totals(df, "v", {"t": "n"}, key="k", descending=descending, next_value="nx", parts=7)
        got = {(r.k, r.v): (r.t, r.nx) for r in got.collect()}
        for key in ("a", "b"):
            ordered = sorted([r for r in rows if r[0] == key], key=lambda r: r[1], reverse=descending)
            total = 0
            for i, (k, v, n) in enumerate(ordered):
                total += n
                following = ordered[i + 1][1] if i + 1 < len(ordered) else None
                assert got[(k, v)] == (total, following)


def test_row_numbers_with_small_slices(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.randint(0, 5000), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, s long, i long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r._rn for r in O.row_numbers(df, ["k"], "ts", ["i"], slice_seconds=60).collect()}
    for key in ("x", "y", None):
        ordered = sorted([(s, i) for k, s, i in rows if k == key])
        assert [got[i] for _, i in ordered] == list(range(1, len(ordered) + 1))


def test_time_slices_spread_a_key_and_keep_its_past(spark):
    rng = random.Random(4)
    seconds = [rng.randint(0, 4000) for _ in range(300)] + [None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "i long, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows = O.time_slices(df, "ts", 50).collect()
    own = [r for r in rows if r._own]
    assert sorted(r.i for r in own) == list(range(301))
    assert len({r._slice for r in own}) > 15 and len(rows) < 1.5 * 301
    held = {}
    for r in rows:
        held.setdefault(r._slice, set()).add(r.i)
    for r in own:
        if r.s is not None:
            assert {i for i, s in enumerate(seconds) if s is not None and r.s - 50 <= s <= r.s} <= held[r._slice]
