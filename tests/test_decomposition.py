"""The seasonal-trend decomposition against plain loops."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from netsift.operators import decomposition as D
from netsift.operators import thresholds as H

START = dt.datetime(2024, 1, 1)


def fit_at(y, span, at, first, last, robust):
    """One local regression, or None where all weights are 0."""
    n = len(y)
    reach = max(at - first, last - at) + (max(span - n, 0) // 2)
    weights = {}
    for j in range(first, last + 1):
        far = abs(j - at)
        if far <= 0.999 * reach:
            weights[j] = (1.0 if far <= 0.001 * reach else (1 - (far / reach) ** 3) ** 3) * (1 if robust is None else robust[j - 1])
    total = sum(weights.values())
    if total <= 0:
        return None
    weights = {j: w / total for j, w in weights.items()}
    mean = sum(w * j for j, w in weights.items())
    spread = sum(w * (j - mean) ** 2 for j, w in weights.items())
    if spread**0.5 > 0.001 * (n - 1):
        weights = {j: w * ((at - mean) / spread * (j - mean) + 1) for j, w in weights.items()}
    return sum(w * y[j - 1] for j, w in weights.items())


def smooth(y, span, robust):
    n, out, first, last = len(y), [], 1, min(span, len(y))
    for i in range(1, n + 1):
        if span < n and i > (span + 1) // 2 and last != n:
            first, last = first + 1, last + 1
        found = fit_at(y, span, i, first, last, robust)
        out.append(y[i - 1] if found is None else found)
    return out


def moving(y, q):
    return [sum(y[i : i + q]) / q for i in range(len(y) - q + 1)]


def plain(y, period, robust=True, seasonal=7):
    n = len(y)
    trend_span, low_span = D.odd_above(1.5 * period / (1 - 1.5 / seasonal)), D.odd_above(period + 1)
    inner, outer = (2, 15) if robust else (5, 0)
    trend, weights = [0.0] * n, None
    for turn in range(outer + 1):
        for _ in range(inner):
            detrended, cycle = [a - b for a, b in zip(y, trend, strict=True)], [0.0] * (n + 2 * period)
            for phase in range(period):
                own, w = detrended[phase::period], None if weights is None else weights[phase::period]
                m, middle = len(own), smooth(own, seasonal, w)
                low = fit_at(own, seasonal, 0, 1, min(seasonal, m), w)
                high = fit_at(own, seasonal, m + 1, max(1, m - seasonal + 1), m, w)
                cycle[phase::period] = [middle[0] if low is None else low, *middle, middle[-1] if high is None else high]
            low = smooth(moving(moving(moving(cycle, period), period), 3), low_span, None)
            season = [cycle[period + i] - low[i] for i in range(n)]
            trend = smooth([a - b for a, b in zip(y, season, strict=True)], trend_span, weights)
        if turn < outer:
            rest = [abs(a - b - c) for a, b, c in zip(y, trend, season, strict=True)]
            limit = 6 * statistics.median(rest)
            weights = [1.0 if r <= 0.001 * limit else (1 - (r / limit) ** 2) ** 2 if r <= 0.999 * limit else 0.0 for r in rest]
    return trend, season


def wave(rng, n, period):
    y = [float(5 * np.sin(2 * np.pi * i / period) + 0.05 * i + rng.gauss(0, 1)) for i in range(n)]
    y[n // 2] += 25
    return y


@pytest.mark.parametrize(("n", "period", "robust"), [(100, 24, True), (90, 24, False), (61, 7, True), (20, 4, True), (33, 8, False)])
def test_decomposition_equals_a_plain_loop(n, period, robust):
    rng = random.Random(n)
    rows = [wave(rng, n, period) for _ in range(3)]
    trend, season = D.decompose(np.array(rows), period, robust)
    for k, y in enumerate(rows):
        want = plain(y, period, robust)
        assert np.allclose(trend[k], want[0], atol=1e-8) and np.allclose(season[k], want[1], atol=1e-8)


def test_thresholds_in_chunks_equal_a_plain_loop(spark):
    rng = random.Random(5)
    series = {"a": wave(rng, 75, 4), "b": wave(rng, 9, 4), "c": [3.0]}
    rows = [(f, START + dt.timedelta(minutes=i // 2), i, v) for f, y in series.items() for i, v in enumerate(y)] + [("b", START, -1, None)]
    df = spark.createDataFrame(rows, "feature string, ts timestamp, row_id long, value double")
    got = {(r.feature, r.row_id): r for r in H.stl_threshold(df, period=4, window=20, slice_seconds=60).collect()}
    assert len(got) == sum(map(len, series.values()))
    for feature, y in series.items():
        before, rests = None, []
        for i in range(len(y)):
            own = y[max(0, i - 19) : i + 1]
            if i + 1 < 8:
                rests.append(0.0 if i == 0 else y[i])
                trend, season, rest, spread = 0.0, 0.0, rests[-1], statistics.pstdev(rests)
            else:
                t, s = plain(own, 4)
                left = [a - b - c for a, b, c in zip(own, t, s, strict=True)]
                trend, season, rest, spread = t[-1], s[-1], left[-1], statistics.pstdev(left)
            r = got[feature, i]
            assert r.position == i + 1
            if len(own) > 8:  # with two values in every phase the residuals are rounding errors, and so are their weights
                assert abs(r.trend - trend) < 1e-6 and abs(r.seasonal - season) < 1e-6 and abs(r.residual - rest) < 1e-6
                assert abs(r.threshold - (trend + season + 3 * spread)) < 1e-6
            if i and len(y[max(0, i - 20) : i]) > 8:
                assert abs(r.previous_threshold - before) < 1e-6
            before = r.threshold
        assert got[feature, 0].previous_threshold is None and got[feature, 0].threshold == 0


def test_a_plan_may_use_the_decomposition(spark):
    rng = random.Random(7)
    rows = [("x", START + dt.timedelta(hours=i), i, v) for i, v in enumerate(wave(rng, 60, 24))]
    df = spark.createDataFrame(rows, "feature string, ts timestamp, row_id long, value double")
    found = H.apply_thresholds(df, [H.ThresholdPlan("x", "stl", {"period": 24})])
    assert found.count() == 60 and found.where("is_anomaly").count() > 0
    assert H.stl_threshold(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        H.stl_threshold(df, window=30)


def test_smoothings_of_a_turn_share_their_weights(monkeypatch):
    """The low-pass filter is one matrix, phases of one length are one table, and weights are worked out once a turn."""
    y = np.random.default_rng(3).normal(10, 3, (20, 100)).round(2)
    calls = []
    made = D.smoother
    monkeypatch.setattr(D, "smoother", lambda *a, **b: calls.append(a[:2]) or made(*a, **b))
    D._low_pass.cache_clear()
    D._by_phase.cache_clear()
    trend, season = D.decompose(y, 24)
    assert len(calls) == 1 + 16 * 3
    alone = [D.decompose(row[None, :], 24) for row in y]
    assert np.allclose(trend, np.vstack([a[0] for a in alone]), atol=1e-8) and np.allclose(season, np.vstack([a[1] for a in alone]), atol=1e-8)
    cycle = np.random.default_rng(4).normal(0, 1, (5, 148))
    plain = D.loess(D.moving_mean(D.moving_mean(D.moving_mean(cycle, 24), 24), 3), 25)
    assert np.allclose(cycle @ D._low_pass(100, 24), plain, atol=1e-12)
