"""K-means fits whose rounds run together."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans

from ratecard.operators import segments as sg


def frame(spark, n=600):
    rng = np.random.default_rng(4)
    rows = [(i, *rng.normal(size=6).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "customer_id long, " + ", ".join(f"{c} double" for c in sg.SEGMENT_FEATURES))


def test_fits_run_together_and_equal_mllib(spark, monkeypatch):
    monkeypatch.setattr(sg, "BLOCK_ROWS", 50)
    data = sg.freeze(sg._scaled(frame(spark)))
    one = [KMeans(k=4, seed=s, maxIter=300, tol=1e-7).fit(data) for s in range(5)]
    starts = [KMeans(k=4, seed=s, maxIter=0).fit(data).clusterCenters() for s in range(5)]
    spark.sparkContext.setJobGroup("together", "K-means")
    try:
        got = sg.lloyd(data, starts, 300, 1e-7)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for model, (centres, cost) in zip(one, got):
        assert np.allclose(centres, model.clusterCenters(), atol=1e-9)
        assert cost == pytest.approx(model.summary.trainingCost, rel=1e-9)
    # a job per round of the slowest fit, not per round of every fit
    rounds = [m.summary.numIter for m in one]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("together"))
    assert jobs == max(rounds) < sum(rounds)


def test_the_cheapest_restart_is_taken(spark):
    rows = frame(spark)
    model, data = sg.kmeans_fit(rows, 4, seed=1, restarts=4)
    costs = [KMeans(k=4, seed=1 + r, maxIter=300, tol=1e-7).fit(data).summary.trainingCost for r in range(4)]
    sums = sum(sg._nearest(np.array([r["features"].toArray() for r in data.collect()]).T,
                           np.array(model.clusterCenters()))[1])
    assert sums == pytest.approx(min(costs), rel=1e-9) and max(costs) > min(costs)
    assert model.transform(data).select("cluster").distinct().count() == 4


def test_a_centre_without_rows_stays(spark):
    data = sg._scaled(frame(spark, 40))
    far = np.full(6, 99.0)
    (centres, _), = sg.lloyd(data, [np.array([np.zeros(6), far])], 5, 1e-7)
    assert np.array_equal(centres[1], far) and np.allclose(centres[0], 0, atol=1e-12)


def test_the_sweep_takes_all_distances_once(spark, monkeypatch):
    rows, calls = frame(spark, 300), []
    inner = sg.silhouettes_of
    monkeypatch.setattr(sg, "silhouettes_of", lambda points, key, columns, features: (
        calls.append(list(columns)), inner(points, key, columns, features))[1])
    got = {r["k"]: r for r in sg.kmeans_k_sweep(rows, (2, 4, 3), seed=1, restarts=2).collect()}
    assert len(calls) == 1 and len(calls[0]) == 3 and sorted(got) == [2, 3, 4]
    for k, r in got.items():
        model, data = sg.kmeans_fit(rows, k, seed=1, restarts=2)
        at = model.transform(data).select("cluster", "features").collect()
        x, c = np.array([a["features"].toArray() for a in at]), np.array([a["cluster"] for a in at])
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        s = []
        for i in range(len(c)):
            own = far[i, c == c[i]].sum() / (c == c[i]).sum().clip(2) / (1 - 1 / (c == c[i]).sum().clip(2))
            other = min(far[i, c == o].mean() for o in range(k) if o != c[i])
            s.append((other - own) / max(other, own))
        assert r["silhouette"] == pytest.approx(np.mean(s), abs=1e-9)
        assert r["inertia"] == pytest.approx(sum(((x[c == o] - x[c == o].mean(axis=0)) ** 2).sum() for o in range(k)))
