"""Seasonal-trend decomposition by loess, for a threshold that follows trend and season.

The decomposition (inner loop: cycle-subseries smoothing, low-pass filter, trend smoothing; outer loop:
robustness weights from the residuals) runs on the last ``window`` values before every threshold. Its local
regressions stand on equally spaced points, so for many windows of one length each smoothing is a few matrix
products over all windows at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netsift.operators.ordering import row_chunks, row_numbers

#: windows that are decomposed at once
BATCH = 512


def odd_above(x: float) -> int:
    """The smallest odd number that is at least ``x``."""
    n = math.ceil(x)
    return n + (n % 2 == 0)


@cache
def _neighbours(n: int, span: int, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places to fit (with ``ends`` one more on either side) and the weights of the ``n`` points at each."""
    places = np.arange(0, n + 2) if ends else np.arange(1, n + 1)
    weights = np.zeros((len(places), n))
    for row, at in enumerate(places):
        # the nearest ``span`` points, kept inside the series
        first = min(max(at - (span + 1) // 2 + 1, 1), max(n - span + 1, 1))
        last = min(first + span - 1, n)
        reach = max(at - first, last - at) + (max(span - n, 0) // 2)
        far = np.abs(np.arange(first, last + 1) - at)
        own = np.where(far <= 0.001 * reach, 1.0, (1 - np.minimum(far / max(reach, 1e-12), 1) ** 3) ** 3)
        weights[row, first - 1 : last] = np.where(far <= 0.999 * reach, own, 0.0)
    return places, weights


@cache
def _moments(n: int, span: int, ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights of :func:`_neighbours` times distance to the power of 0, 1 and 2, a column for each place to fit."""
    places, w0 = _neighbours(n, span, ends)
    gap = np.arange(1, n + 1)[None, :] - places[:, None]
    return tuple(np.ascontiguousarray(w.T) for w in (w0, w0 * gap, w0 * gap**2))


def smoother(moments: tuple[np.ndarray, np.ndarray, np.ndarray], robust: np.ndarray | None = None, ends: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """:func:`loess` for one set of weights: a fit is a sum of two weighted sums, whose factors depend on the weights alone."""
    w0, w1, w2 = moments
    n = len(w0)
    r = np.ones((1, n)) if robust is None else robust
    s0, s1, s2 = r @ w0, r @ w1, r @ w2
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s1 / s0
        spread = s2 / s0 - mean**2
        bent = np.sqrt(np.maximum(spread, 0)) > 0.001 * (n - 1)
        tilt = np.where(bent, mean / spread, 0.0)
        by_level, by_slope = (1 + tilt * mean) / s0, tilt / s0
    lost = s0 <= 0

    def smooth(y: np.ndarray) -> np.ndarray:
        weighted = y if robust is None else r * y
        fit = weighted @ w0
        fit *= by_level
        fit -= (weighted @ w1) * by_slope
        if lost.any():
            stays = np.concatenate([y[:, :1], y, y[:, -1:]], axis=1) if ends else y
            fit = np.where(lost, stays, fit)
        return fit

    return smooth


def loess(y: np.ndarray, span: int, robust: np.ndarray | None = None, ends: bool = False) -> np.ndarray:
    """Local linear regressions of the rows of ``y`` at each of their places. Where all weights are 0 the value stays."""
    return smoother(_moments(y.shape[1], span, ends), robust, ends)(y)


def moving_mean(y: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(y, n, axis=1).mean(axis=2)


@cache
def _low_pass(n: int, period: int) -> np.ndarray:
    """The low-pass filter as a matrix: it knows no weights, so every place is a fixed sum of the cycle's places."""
    means = moving_mean(moving_mean(moving_mean(np.eye(n + 2 * period), period), period), 3)
    return np.ascontiguousarray(loess(means, odd_above(period + 1)))


@cache
def _by_phase(n: int, period: int, trend_span: int) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, tuple[np.ndarray, ...]]:
    """Places phase by phase; phases of one length together (columns from and to, and the length); the low-pass filter and the trend's moments in that order."""
    many, k = n % period, n // period
    groups = [(phases, size) for phases, size in ((np.arange(many), k + 1), (np.arange(many, period), k)) if len(phases)]
    order = np.concatenate([(p[:, None] + period * np.arange(size)).ravel() for p, size in groups])
    cycle = np.concatenate([(p[:, None] + period * np.arange(size + 2)).ravel() for p, size in groups])
    ends = np.cumsum([0, *(len(p) * size for p, size in groups)])
    columns = [(int(ends[i]), int(ends[i + 1]), size) for i, (_, size) in enumerate(groups)]
    reorder = lambda w, rows: np.ascontiguousarray(w[rows][:, order])
    return order, columns, reorder(_low_pass(n, period), cycle), tuple(reorder(w, order) for w in _moments(n, trend_span, False))


def decompose(y: np.ndarray, period: int, robust: bool = True, seasonal: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season of each row of ``y``, rows being series of one length of at least two periods."""
    count, n = y.shape
    inner, outer = (2, 15) if robust else (5, 0)
    order, groups, low_pass, moments = _by_phase(n, period, odd_above(1.5 * period / (1 - 1.5 / seasonal)))
    y = np.ascontiguousarray(y[:, order])
    trend, season, weights = np.zeros_like(y), np.zeros_like(y), None
    for turn in range(outer + 1):
        # the weights hold for a whole turn; phases of one length are smoothed as one table
        by_phase = [smoother(_moments(size, seasonal, True), None if weights is None else weights[:, lo:hi].reshape(-1, size), ends=True) for lo, hi, size in groups]
        by_time = smoother(moments, weights)
        for _ in range(inner):
            rest = y - trend
            cycle = [smooth(rest[:, lo:hi].reshape(-1, size)) for (lo, hi, size), smooth in zip(groups, by_phase, strict=True)]
            season = np.concatenate([c[:, 1:-1].reshape(count, -1) for c in cycle], axis=1)
            season -= np.concatenate([c.reshape(count, -1) for c in cycle], axis=1) @ low_pass
            trend = by_time(y - season)
        if turn < outer:
            rest = np.abs(y - trend - season)
            limit = 6 * np.median(rest, axis=1, keepdims=True)
            share = np.minimum(rest / np.maximum(limit, 1e-300), 1)
            weights = np.where(rest <= 0.001 * limit, 1.0, np.where(rest <= 0.999 * limit, (1 - share**2) ** 2, 0.0))
    back = np.argsort(order)
    return trend[:, back], season[:, back]


def thresholds(values: np.ndarray, first: int, period: int, window: int, k: float, robust: bool) -> pd.DataFrame:
    """Trend, season, residual and threshold after each of a series' values; ``first`` is the number of the first one.

    With fewer than two periods so far trend and season are 0 and the residuals are the values, 0 for the first of all.
    """
    numbers = first + np.arange(len(values))
    out = {c: np.full(len(values), np.nan) for c in ("trend", "seasonal", "residual", "threshold")}
    sizes = np.minimum(np.minimum(numbers, window), np.arange(len(values)) + 1)
    raw = np.where(numbers == 1, 0.0, values)
    # rows that look back further than the values at hand are not the caller's own
    known = sizes == np.minimum(numbers, window)
    for at in np.flatnonzero(known & (numbers < 2 * period)):
        out["trend"][at] = out["seasonal"][at] = 0.0
        out["residual"][at] = raw[at]
        out["threshold"][at] = k * raw[at - sizes[at] + 1 : at + 1].std()
    late = known & (numbers >= 2 * period)
    for size in np.unique(sizes[late]):
        rows = np.flatnonzero(late & (sizes == size))
        for part in np.array_split(rows, math.ceil(len(rows) / BATCH)):
            y = values[part[:, None] - size + 1 + np.arange(size)]
            trend, season = decompose(y, period, robust)
            rest = y - trend - season
            out["trend"][part], out["seasonal"][part], out["residual"][part] = trend[:, -1], season[:, -1], rest[:, -1]
            out["threshold"][part] = trend[:, -1] + season[:, -1] + k * rest.std(axis=1)
    return pd.DataFrame(out)


def stl_threshold(
    df: DataFrame,
    keys: Sequence[str] = ("feature",),
    ts: str = "ts",
    tie: str = "row_id",
    value: str = "value",
    period: int = 24,
    window: int = 100,
    k: float = 3.0,
    robust: bool = True,
    slice_seconds: float = 3600.0,
) -> DataFrame:
    """Trend plus season plus ``k`` deviations of the residuals of the last ``window`` values, after each value.

    Adds ``position``, ``trend``, ``seasonal``, ``residual``, ``threshold`` and ``previous_threshold``. A series is
    numbered and cut into chunks of rows that get the rows they look back at, so a long series is many tasks.
    Rows without a value are left out.
    """
    if window < 2 * period:
        raise ValueError("the window must hold two periods")
    keys = list(keys)
    narrow = df.where(F.col(value).isNotNull()).select(*keys, ts, tie, F.col(value).cast("double").alias(value))
    chunks = row_chunks(row_numbers(narrow, keys, ts, [tie], slice_seconds), window)
    names = ["trend", "seasonal", "residual", "threshold", "previous_threshold"]
    schema = T.StructType([*narrow.schema.fields, T.StructField("position", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rn", kind="stable").reset_index(drop=True)
        found = thresholds(rows[value].to_numpy(dtype=float), int(rows["_rn"].iloc[0]), period, window, k, robust)
        found["previous_threshold"] = found["threshold"].shift()
        rows = pd.concat([rows, found], axis=1).rename(columns={"_rn": "position"})
        return rows.loc[rows["_own"], schema.fieldNames()]

    out = chunks.groupBy(*keys, "_chunk").applyInPandas(run, schema)
    return out.withColumn("previous_threshold", F.when(~F.isnan("previous_threshold"), F.col("previous_threshold")))
