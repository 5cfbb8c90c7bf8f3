"""Density clusters on the grid, and beyond three features, against brute force."""

import random

import numpy as np
import pytest

from netsift.operators import models as M
from netsift.operators.models import grid


def brute(x, eps, least):
    """Cluster of each row, numbered by least core row; -1 is noise."""
    near = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label, number = np.full(len(x), -1), 0
    for seed in range(len(x)):
        if not core[seed] or label[seed] >= 0:
            continue
        front = [seed]
        while front:
            i = front.pop()
            if core[i] and label[i] < 0:
                label[i] = number
                front += [j for j in np.flatnonzero(near[i] & core) if label[j] < 0]
        number += 1
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        if len(reached):
            label[i] = reached.min()
    return label


def blobs(rng, d, n):
    """Dense and thin groups, lines, copies and noise, below zero too."""
    rows = [[rng.gauss(5 * (k % 3) - 5, 0.25 if k % 2 else 0.9) for _ in range(d)] for k in range(n)]
    rows += [[0.11 * k - 4] + [8.0] * (d - 1) for k in range(60)] + [[1.5] * d] * 6
    rows += [[rng.uniform(-12, 12) for _ in range(d)] for _ in range(n // 4)]
    return np.array(rows)


@pytest.mark.parametrize(("d", "eps", "least"), [(1, 0.05, 4), (2, 0.4, 5), (2, 0.9, 12), (3, 0.7, 5), (3, 0.25, 1), (5, 1.2, 5)])
def test_clusters_equal_brute_force(spark, monkeypatch, d, eps, least):
    monkeypatch.setattr(grid, "BLOCK", 7)
    x = blobs(random.Random(d * 10 + least), d, 240)
    names = [f"f{k}" for k in range(d)]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(9999, *[None] * d)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    used = grid.fits(spark.createDataFrame([(list(map(float, v)),) for v in x], "x array<double>"), eps)
    assert used == (d <= 3)
    got = {r.id: r.cluster for r in M.Dbscan(names, "id", eps, least, cell_rows=40).fit(df).labels(df).collect()}
    want = brute(x, eps, least)
    assert got == dict(enumerate(want.tolist())) and want.max() > 0


def test_dense_neighbours_that_stay_apart(spark):
    # two crowded walls in neighbouring cells, farther apart than eps everywhere but at one end
    walls = [(0.0, 0.02 * k) for k in range(60)] + [(1.02, 0.02 * k) for k in range(60)] + [(0.0, 40 + 0.02 * k) for k in range(60)] + [(1.02, 40 + 0.02 * k) for k in range(60)] + [(0.05, 41.18), (0.99, 41.18)]
    x = np.array(walls)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double")
    got = {r.id: r.cluster for r in M.Dbscan(["a", "b"], "id", 1.0, 5).fit(df).labels(df).collect()}
    want = brute(x, 1.0, 5)
    assert got == dict(enumerate(want.tolist())) and want.max() == 2


def test_numbers_too_large_for_the_grid(spark):
    df = spark.createDataFrame([(k, 1e300 if k == 0 else 0.1 * k) for k in range(20)], "id long, a double")
    got = {r.id: r.cluster for r in M.Dbscan(["a"], "id", 0.15, 3).fit(df).labels(df).collect()}
    assert got[0] == -1 and {got[k] for k in range(1, 20)} == {0}
