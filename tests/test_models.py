import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netsift.operators import lifecycle as C
from netsift.operators import models as M
from netsift.operators.models import neighbors as N
from netsift.operators.models.components import connected_components


def frame(spark, x, names="abc"):
    cols = ", ".join(f"{n} double" for n in names[: x.shape[1]])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"id long, {cols}")


def planted(seed=0, n=600):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    x[:12] += 9.0
    return x


def test_isolation_forest(spark, tmp_path):
    df = frame(spark, planted())
    model = M.get_detector("isolation_forest", features=["a", "b", "c"], id_col="id", n_trees=40)
    fitted = model.fit(df)
    got = {r.id: r for r in fitted.transform(df).collect()}
    lowest = sorted(got, key=lambda i: got[i].score)[:12]
    assert set(lowest) == set(range(12))
    assert sum(r.is_anomaly for r in got.values()) == 60
    again = model.fit(df.repartition(9)).transform(df)
    assert all(abs(r.score - got[r.id].score) < 1e-12 for r in again.collect())
    fitted.save(str(tmp_path / "forest"))
    back = M.load_detector(spark, str(tmp_path / "forest")).transform(df)
    assert all(r.score == got[r.id].score for r in back.collect())
    gap = spark.createDataFrame([(1, None, 1.0, 1.0)], "id long, a double, b double, c double")
    row = fitted.transform(gap).first()
    assert row.score is None and row.is_anomaly is False


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = (d <= eps).sum(axis=1) >= least
    labels, label = np.full(len(x), -1), 0
    for i in range(len(x)):
        if not core[i] or labels[i] >= 0:
            continue
        todo = [i]
        labels[i] = label
        while todo:
            p = todo.pop()
            if not core[p]:
                continue
            for q in np.flatnonzero(d[p] <= eps):
                if labels[q] < 0:
                    labels[q] = label
                    todo.append(q)
        label += 1
    return labels, core


def test_dbscan_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(150, 2)), rng.normal(size=(120, 2)) + [6, 0], np.tile([[20.0, 20.0]], (40, 1)), rng.uniform(-8, 14, size=(60, 2))])
    x = np.round(rng.permutation(x), 3)
    df = frame(spark, x)
    fitted = M.Dbscan(["a", "b"], "id", 0.6, 5, cell_rows=30).fit(df)
    got = {r.id: r.cluster for r in fitted.labels(df).collect()}
    want, core = brute_dbscan(x, 0.6, 5)
    assert [got[i] for i in range(len(x))] == want.tolist()
    new = frame(spark, rng.uniform(-10, 22, size=(50, 2)))
    fitted.save(str(tmp_path / "dbscan"))
    scored = M.load_detector(spark, str(tmp_path / "dbscan")).transform(new)
    cx = x[core]
    for r in scored.collect():
        d = np.sqrt(((cx - [r.a, r.b]) ** 2).sum(axis=1)).min()
        assert abs(r.score - d) < 1e-9 and r.is_anomaly == (d > 0.6)


def test_dbscan_of_noise_scores_one(spark):
    df = frame(spark, np.array([[0.0, 0], [10, 0], [20, 0]]))
    fitted = M.Dbscan(["a", "b"], "id").fit(df)
    assert {r.cluster for r in fitted.labels(df).collect()} == {-1}
    assert [r.score for r in fitted.transform(df).collect()] == [1.0] * 3


def test_knn_join_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(200, 12)), np.zeros((60, 12))])
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in N.knn_join(points, points, 7, skip_self=True, cell_rows=25, block_rows=20).collect():
        got.setdefault(r.qid, []).append((round(r.distance, 9), r.pid))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        want = sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)[:7]
        assert sorted(got[i]) == want


def test_lof_finds_planted_outliers(spark, tmp_path):
    df = frame(spark, planted(2, 300))
    fitted = M.get_detector("lof", features=["a", "b", "c"], id_col="id", k=20).fit(df)
    scores = {r.id: r.score for r in fitted.transform(df.where("id >= 0")).collect()}
    assert len(scores) == 300
    far = spark.createDataFrame([(1000, 30.0, -30.0, 0.0)], "id long, a double, b double, c double")
    fitted.save(str(tmp_path / "lof"))
    row = M.load_detector(spark, str(tmp_path / "lof")).transform(far).first()
    assert row.is_anomaly and row.score > 1


def test_one_class_svm(spark, tmp_path):
    df = frame(spark, planted(4))
    fitted = M.OneClassSvm(["a", "b", "c"], nu=0.1).fit(df)
    rows = fitted.transform(df).collect()
    assert 0.08 <= np.mean([r.is_anomaly for r in rows]) <= 0.1
    centre = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 40.0, -40.0, 40.0)], "id long, a double, b double, c double")
    fitted.save(str(tmp_path / "svm"))
    near, far = M.load_detector(spark, str(tmp_path / "svm")).transform(centre).orderBy("id").collect()
    assert not near.is_anomaly and near.score > far.score


def test_unknown_detector():
    with pytest.raises(ValueError):
        M.get_detector("nothing")


def test_connected_components(spark):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(30)] + [(int(a), int(b)) for a, b in rng.integers(50, 90, size=(30, 2))] + [(99, 99)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_retrain(spark, tmp_path):
    x = planted(7, 700)
    x[:60] += 9.0
    df = frame(spark, x).withColumn("is_anomaly", F.col("id") < 60)
    result = C.retrain(
        df, ["a", "b", "c"], "id", lambda s: M.train(s, features=["a", "b", "c"], id_col="id", n_trees=30), str(tmp_path / "model"),
        F.lit("2024-01-01 00:00:00").cast("timestamp"),
    )
    assert result.samples == 120 and result.version == 1
    registry = C.Registry(spark, str(tmp_path / "model" / "registry"))
    assert [r.stage for r in registry.versions().collect()] == [result.stage]
    history = spark.read.parquet(str(tmp_path / "model" / "history"))
    status = C.update_status(history).first()
    assert status.updates == 1 and status.last_quality == result.quality
    assert spark.read.parquet(str(tmp_path / "model" / "drift_reference")).select("feature").distinct().count() == 3
    assert result.profile.count() == 3


def test_clustering_of_many_rows_in_few_partitions(spark, monkeypatch):
    from netsift.operators import learning as L

    rows = [(i, float(i % 3) * 10 + i % 5 / 10, float(i % 3)) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, a double, score double").selectExpr("*", "false AS is_anomaly", "true AS is_uncertain").coalesce(1)
    monkeypatch.setattr(L, "CLUSTER_ROWS", 50)
    found = L.refine_uncertain(frame, ["a"], "score", "id")
    assert "RepartitionByExpression [id" in found._jdf.queryExecution().analyzed().toString()
    got = found.collect()
    assert len(got) == 300 and len({(r.cluster, r.id % 3) for r in got}) == 3
    assert {r.id % 3 for r in got if r.is_anomaly} == {0}


def test_neighbour_tasks_hold_a_bounded_number_of_distances(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 3)]) for i in range(400)]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    monkeypatch.setattr(N, "DISTANCES", 700)
    sizes = []
    plain = N.squared_distances
    monkeypatch.setattr(N, "squared_distances", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    centres = np.array([x for _, x in rows[:30]])
    pieces = list(N._pieces(np.array([x for _, x in rows]), len(centres)))
    assert max(map(len, pieces)) == 23 and sum(map(len, pieces)) == 400
    part = pd.DataFrame(rows, columns=["id", "x"])
    got = N._top_k(part, part, 4, True)
    assert max(sizes) <= 700 and len(got) == 1600
    x = np.array([v for _, v in rows])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(np.sort(d, axis=1)[:, :4].ravel(), got.sort_values(["qid", "distance"])["distance"])
    found = {(r.qid, r.pid) for r in N.knn_join(points, points, 4, skip_self=True, cell_rows=20).collect()}
    assert found == set(zip(got["qid"], got["pid"], strict=True))


def test_a_query_travels_once_to_a_block_of_cells(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(300, 16)), np.zeros((20, 16))])
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    # 80 cells, of which none can be left out: a query went to each of them and now goes to four blocks
    centres = N.choose_pivots(points, 320, 4)
    pivots = N.Pivots(centres, np.ones(len(centres)), np.full(len(centres), 4), np.zeros((len(centres), 1)))
    first, split, block = N._blocks(pivots, 100_000, 4)
    assert len(centres) == 80 and len(block) == 80 and len(set(block)) == 4
    assert all(split == 1) and list(first) == list(range(80))
    first, split, block = N._blocks(pivots, 40, 4)
    assert max(np.bincount(block)) * 4 <= 40
    first, split, block = N._blocks(N.Pivots(centres, pivots.radius, np.array([100] + [1] * 79), pivots.near), 30, 2)
    assert split[0] == 4 and first[1] == 4 and len(block) == 83
    got = {}
    for r in N.knn_join(points, points, 5, skip_self=True, cell_rows=4).collect():
        got.setdefault(r.qid, []).append((round(r.distance, 9), r.pid))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert all(sorted(got[i]) == sorted((round(d[i, j], 9), j) for j in range(len(x)) if j != i)[:5] for i in range(len(x)))
