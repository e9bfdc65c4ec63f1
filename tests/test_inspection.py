"""Model inspection: permutations, banded AUC, vector dependence, certificates, one-pass metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecard.operators import churn as ch
from ratecard.operators import inspection as ins
from ratecard.operators import ranking as rk
from ratecard.operators import segments as sg


def auc(score, y):
    up = (score[y == 1][:, None] > score[y == 0][None]).mean()
    return up + (score[y == 1][:, None] == score[y == 0][None]).mean() / 2


def frame(spark, n=1200, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=n), np.round(rng.normal(size=n), 1)
    c = rng.choice(["x", "y", "z"], n)
    y = (1.5 * a + b + 2.0 * (c == "x") + rng.logistic(size=n) > 0.7).astype(int)
    rows = [(i, float(a[i]), float(b[i]), str(c[i]), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, y int").repartition(5), a, b, c, y


def stub(df):
    return df.withColumn("score", F.round(1.5 * F.col("a") + F.col("b") + 2.0 * (F.col("c") == "x").cast("int"), 2))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bucket_rows", [10_000, 50, 1])
def test_neighbours_are_a_permutation(spark, bucket_rows):
    df = frame(spark, 400)[0].withColumn("self", F.col("id"))
    got = ins.cyclic_neighbours(df, ["self", "a"], ["id"], 3, 7, bucket_rows).select("_r", "id", "a", "_other").collect()
    assert len(got) == 3 * 400
    for r in range(3):
        rows = [x for x in got if x["_r"] == r]
        assert sorted(x["_other"]["self"] for x in rows) == sorted(x["id"] for x in rows)
        still = sum(x["_other"]["self"] == x["id"] for x in rows)
        assert still == 0 if bucket_rows == 10_000 else still < 350
    values = {x["id"]: x["a"] for x in got}
    assert all(values[x["_other"]["self"]] == x["_other"]["a"] for x in got)
    orders = [tuple(x["_other"]["self"] for x in sorted(got, key=lambda x: x["id"]) if x["_r"] == r) for r in range(3)]
    assert len(set(orders)) == 3


def test_importance_against_numpy_permutations(spark):
    df, a, b, c, y = frame(spark)
    got = {r["feature"]: r for r in ins.permutation_importance(stub, df, ["a", "b", "c"], "y", ["id"]).collect()}
    score = lambda a, b, c: np.round(1.5 * a + b + 2.0 * (c == "x"), 2)
    base, rng = auc(score(a, b, c), y), np.random.default_rng(5)
    for name in "abc":
        drops = []
        for _ in range(60):
            values = {"a": a, "b": b, "c": c}
            values[name] = rng.permutation(values[name])
            drops.append(base - auc(score(**values), y))
        assert abs(got[name]["importance_mean"] - np.mean(drops)) < 4 * np.std(drops) / np.sqrt(8) + 1e-3
        assert 0 < got[name]["importance_std"] < 4 * np.std(drops)


def test_importance_has_no_range_exchange(spark):
    plan = plan_of(ins.permutation_importance(stub, frame(spark, 60)[0], ["a", "b", "c"], "y", ["id"]))
    assert "rangepartitioning" not in plan and "hashpartitioning" in plan


def test_banded_auc_at_any_edges(spark):
    df, *_ = frame(spark, 900)
    rows = stub(df).withColumn("score", F.when(F.col("id") % 3 == 0, 1.25).otherwise(F.col("score")))
    rows = rows.withColumn("g", F.col("id") % 2)
    data = rows.toPandas()
    want = {g: auc(d["score"].to_numpy(), d["y"].to_numpy()) for g, d in data.groupby("g")}
    cuts = rk.score_edges(rows, "score", band_rows=60)
    assert 3 < len(cuts) < 16 and rk.score_edges(rows, "score") == []
    for edges in ([], cuts, [1.25], [-99.0, 99.0]):
        got = {r["g"]: r["roc_auc"] for r in rk.banded_auc_by(rows, ["g"], "score", "y", edges).collect()}
        assert got == pytest.approx(want, abs=1e-12)


def test_dependence_equals_the_exploded_form(spark):
    df, *_ = frame(spark, 500)
    model = ch.fit_gbt(df, ["c"], ["a", "b"], "y", max_depth=3, step=0.2, max_iter=8)
    assert any(x is not None for t in ins.tree_arrays(model.stages[-1]) for x in t.categories)
    for feature in ("a", "b"):
        got = {r["grid_value"]: r["avg_prediction"] for r in ins.partial_dependence(model, df, feature, 12).collect()}
        lo, hi = np.quantile(df.toPandas()[feature], [0.05, 0.95])
        assert sorted(got) == pytest.approx(np.linspace(lo, hi, 12).tolist())
        # the grid's own values and those of the tree thresholds
        grid = spark.createDataFrame([(g,) for g in got], "grid double")
        many = ch.positive_probability(model, df.drop(feature).crossJoin(grid).withColumn(feature, F.col("grid")), "p")
        want = {r["grid"]: r["p"] for r in many.groupBy("grid").agg(F.avg("p").alias("p")).collect()}
        assert got == pytest.approx(want, abs=1e-9)
    trees = ins.tree_arrays(model.stages[-1])
    cuts = sorted({x for t in trees for x in t.cuts(4)})
    assert cuts and len(cuts) < 100
    x = np.array([[0.0, 1.0, 0.0, 0.0, 0.0, 0.5]])
    assert ins.grid_margins(trees, x, 4, np.array(cuts))[0] == pytest.approx(
        [sum(t.weight * t.predict(np.array([[0, 1.0, 0, 0, v, 0.5]]))[0] for t in trees) for v in cuts])
    plan = plan_of(ins.partial_dependence(model, df, "a", 12))
    below = plan[plan.index("HashAggregate"):] if "HashAggregate" in plan else plan[plan.index("ObjectHashAggregate"):]
    assert "Generate" in plan and "Generate" not in below
    assert ins.partial_dependence(model, df.where("id < 0"), "a", 12).count() == 0


def test_logistic_certificate_tells_a_fit_from_a_half_fit(spark):
    df, *_ = frame(spark, 600)
    df = df.withColumn("w", F.when(F.col("y") == 1, 1.5).otherwise(0.8))
    largest = []
    for rounds in (200, 1):
        model = ch.fit_logistic(df, ["c"], ["a", "b"], "y", weight_col="w", max_iter=rounds)
        rows = ins.logistic_gradient(model, df, "y", ["a", "b"], "w").collect()
        assert {r["coefficient"] for r in rows} >= {"c=x", "c=y", "c=z", "a", "b", "intercept"}
        largest.append(max(abs(r["gradient"]) for r in rows))
    assert largest[0] < 5e-6 and largest[1] > 1e-3


def rfm(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *(rng.normal(size=6) + 3 * (i % 4)).tolist()) for i in range(200)]
    return spark.createDataFrame(rows, "customer_id long, " + ", ".join(f"{c} double" for c in sg.SEGMENT_FEATURES))


def test_kmeans_and_pca_certificates(spark):
    model, data = sg.kmeans_fit(rfm(spark), 4, restarts=2)
    good = ins.kmeans_certificate(model, data).collect()
    assert len(good) == 4 and all(r["nearer_elsewhere"] == 0 and r["centre_gap"] < 1e-9 for r in good)
    half, data = sg.kmeans_fit(rfm(spark).where("customer_id % 3 > 0"), 4, restarts=1, max_iter=1)
    assert max(r["centre_gap"] for r in ins.kmeans_certificate(half, sg._scaled(rfm(spark))).collect()) > 1e-3
    model, data = sg.pca_fit(rfm(spark))
    parts, ratios = model.pc.toArray(), [float(x) for x in model.explainedVariance]
    for r in ins.pca_certificate(parts, ratios, data).collect():
        assert r["residual"] < 1e-9 and abs(r["length"] - 1) < 1e-12 and abs(r["product_with_next"]) < 1e-12
    turned = np.linalg.qr(np.random.default_rng(0).normal(size=(6, 2)))[0]
    assert max(r["residual"] for r in ins.pca_certificate(turned, ratios, data).collect()) > 0.1


def test_boosting_loss(spark):
    df, *_ = frame(spark, 400)
    losses = ins.boosting_losses(ch.fit_gbt(df, ["c"], ["a", "b"], "y", max_iter=6, max_depth=2), df, "y")
    assert len(losses) == 6 and ins.loss_rises(losses) == 0 and losses[-1] < losses[0]
    assert ins.loss_rises([3.0, 2.0, 2.5, 2.5, 2.6]) == 2


def test_encoding_and_scoring_seen_from_outside(spark):
    df, *_ = frame(spark, 300)
    logit = ch.fit_logistic(df, ["c"], ["a", "b"], "y")
    boosted = ch.fit_gbt(df, ["c"], ["a", "b"], "y", max_iter=5, max_depth=3)
    hot = {r["id"]: (r["name"], r["value"]) for r in ins.hot_entries(logit, df, "id").collect()}
    assert hot == {r["id"]: (f"c={r['c']}", 1.0) for r in df.collect()}
    for model in (logit, boosted):
        row = ins.scoring_differences(model, df).first()
        assert row["n_rows"] == 300 and row["difference"] < 1e-12
    assert ins.scoring_differences(boosted, df.where("id < 0")).first()["n_rows"] == 0


def two_models(spark):
    df, *_ = frame(spark, 700)
    scored = stub(df).withColumn("p", F.round(1 / (1 + F.exp(-F.col("score"))), 2))
    return scored, scored.select("y", F.inline(F.array(
        F.struct(F.lit("m").alias("model"), F.col("p")),
        F.struct(F.lit("flat").alias("model"), F.round(F.col("p"), 0).alias("p")))))


@pytest.mark.parametrize("buckets", [1, 5])
def test_all_metrics_from_one_table(spark, buckets):
    scored, both = two_models(spark)
    got = {r["model"]: r for r in rk.metrics_of_scores(rk.cumulative_scores(both, "model", "p", "y", buckets)).collect()}
    for name, rows in (("m", scored), ("flat", scored.withColumn("p", F.round("p", 0)))):
        assert got[name]["roc_auc"] == pytest.approx(rk.roc_auc(rows, "p", "y").first()[0], abs=1e-12)
        assert got[name]["average_precision"] == pytest.approx(rk.average_precision(rows, "p", "y").first()[0])
        loss = rk.log_loss_brier(rows, "p", "y").first()
        assert (got[name]["log_loss"], got[name]["brier"], got[name]["n"]) == pytest.approx(tuple(loss))


@pytest.mark.parametrize("points", [1, 3, 10, 50])
def test_thinned_curves_keep_their_area(spark, points):
    _, both = two_models(spark)
    cum = rk.cumulative_scores(both, "model", "p", "y")
    full, thin = (rk.curves_of_scores(cum, q).toPandas().sort_values(["model", "fpr", "tpr"]) for q in (None, points))
    area = lambda d: np.trapezoid([0, *d["tpr"]], [0, *d["fpr"]])
    for model, d in full.groupby("model"):
        t = thin[thin["model"] == model]
        p, n = d["tp"].max(), d["fp"].max()
        assert len(t) <= points + 2 and t["tp"].max() == p and t["fp"].max() == n
        assert set(map(tuple, t.to_numpy())) <= set(map(tuple, d.to_numpy()))
        assert abs(area(t) - area(d)) <= 5 * (p + n) ** 2 / (8 * points * p * n)


def test_one_range_exchange_for_all_models(spark, monkeypatch):
    _, both = two_models(spark)
    calls = []
    inner = rk.running_totals
    monkeypatch.setattr(rk, "running_totals", lambda *a, **k: calls.append(1) or inner(*a, **k))
    rk.long_metrics(rk.metrics_of_scores(rk.cumulative_scores(both, "model", "p", "y"))).collect()
    assert len(calls) == 1


@pytest.mark.parametrize("accuracy", [20, 400])
def test_approximate_quantiles_stay_within_their_rank_error(spark, accuracy):
    rng = np.random.default_rng(4)
    rows = [("g" if i % 5 else "h", float(v)) for i, v in enumerate(np.round(rng.gamma(2.0, 10, 6000), 2))]
    df = spark.createDataFrame([*rows, ("none", None), ("g", float("nan"))], "g string, v double").repartition(7)
    qs = [0.0, 0.1, 0.5, 0.97, 1.0]
    got = rk.approx_quantiles(df, ["g"], "v", qs, accuracy).collect()
    assert len(got) == 2 * len(qs)
    for r in got:
        values = np.sort([v for g, v in rows if g == r["g"]])
        n, slack = len(values), len(values) / accuracy + 1
        assert np.searchsorted(values, r["value"]) - slack <= r["q"] * n <= np.searchsorted(values, r["value"], "right") + slack
    check = rk.quantile_rank_check(df, ["g"], "v", qs, accuracy).collect()
    assert len(check) == 2 * len(qs) and all(r["rank_in_bound"] for r in check)


def test_a_wrong_quantile_is_told(spark, monkeypatch):
    df = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    exact = rk.approx_quantiles
    monkeypatch.setattr(rk, "approx_quantiles", lambda *a: exact(*a).withColumn("value", F.col("value") + 60.0))
    got = rk.quantile_rank_check(df, ["g"], "v", [0.5, 0.9], 100).collect()
    assert [r["rank_in_bound"] for r in got] == [False, False]


def test_importance_by_trees_equals_full_scoring(spark, monkeypatch):
    monkeypatch.setattr(ins, "REPLICA_ROWS", 70)
    df, *_ = frame(spark, 700)
    model = ch.fit_gbt(df, ["c"], ["a", "b"], "y", max_depth=3, step=0.2, max_iter=8)
    # a category that the fit has not seen and rows that come twice
    rows = df.where("id % 3 > 0").withColumn("c", F.when(F.col("id") % 50 == 1, "new").otherwise(F.col("c")))
    rows = rows.unionByName(rows.where("id < 40"))
    args = (ch.scorer(model), rows, ["a", "c", "b"], "y", ["id"], 3)
    want = {r["feature"]: r for r in ins.permutation_importance(*args).collect()}
    got = {r["feature"]: r for r in ins.permutation_importance(*args, model=model).collect()}
    assert sorted(got) == ["a", "b", "c"] and want["a"]["importance_mean"] > 0.05
    for f, r in got.items():
        assert tuple(r) == pytest.approx(tuple(want[f]), abs=1e-12)


def test_a_replica_asks_only_the_trees_of_its_feature(spark, monkeypatch):
    tree = lambda f, cut, w: ins.Tree(w, (f, -1, -1), (cut, np.nan, np.nan), (None,) * 3, (1, -1, -1), (2, -1, -1),
                                      (0.0, -1.0, 1.0))
    trees = [tree(0, 0.5, 1.0), tree(1, 0.5, 0.1), tree(0, 1.5, 0.1)]
    x, other = np.array([[0.0, 1.0, 2.0], [0.0, 0.0, 1.0]]), np.array([[2.0, 0.0, 1.0], [1.0, 0.0, 0.0]])
    want = [sum(t.weight * t.predict(v.T) for t in trees)
            for v in (x, np.array([other[0], x[1]]), np.array([x[0], other[1]]))]
    calls, plain = [], ins.Tree.by_columns
    monkeypatch.setattr(ins.Tree, "by_columns", lambda self, v, node=0: (calls.append(node), plain(self, v, node))[1])
    got = list(ins.replica_margins(trees, x, other, [np.array([0]), np.array([1])]))
    assert np.allclose(got, want) and calls.count(0) == len(trees) + 2 + 1


def test_losses_equal_mllib_without_its_pass(spark, monkeypatch):
    monkeypatch.setattr(ins, "LOSS_ROWS", 70)
    df, *_ = frame(spark, 700)
    model = ch.fit_gbt(df, ["c"], ["a", "b"], "y", max_depth=3, step=0.2, max_iter=8)
    # rows of another table, with a category that the fit has not seen
    rows = df.where("id % 3 > 0").withColumn("c", F.when(F.col("id") % 50 == 1, "new").otherwise(F.col("c")))
    coded = ins.PipelineModel(model.stages[:-1]).transform(rows).withColumn("y", F.col("y").cast("double"))
    want = model.stages[-1].evaluateEachIteration(coded.withColumnRenamed("y", model.stages[-1].getLabelCol()))
    monkeypatch.setattr(type(model.stages[-1]), "evaluateEachIteration", None)
    assert ins.boosting_losses(model, rows, "y") == pytest.approx(want, abs=1e-12) and len(want) == 8
    with pytest.raises(Exception, match="0 or 1"):
        ins.boosting_losses(model, rows.withColumn("y", F.lit(None).cast("int")), "y")


def test_a_tree_by_columns_equals_row_by_row(spark):
    df, *_ = frame(spark, 500)
    model = ch.fit_gbt(df, ["c"], ["a", "b"], "y", max_depth=4, step=0.2, max_iter=6)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 2, (400, 4)), np.round(rng.normal(size=(400, 2)), 1)])
    x[::40, 4:] = np.nan
    for t in ins.tree_arrays(model.stages[-1]):
        x[1::40, 4] = t.cuts(4)[0] if t.cuts(4) else 0.0
        assert (t.by_columns(np.ascontiguousarray(x.T)) == t.predict(x)).all()
    assert ins.Tree(1.0, (-1,), (np.nan,), (None,), (-1,), (-1,), (0.5,)).by_columns(x.T) == 0.5
