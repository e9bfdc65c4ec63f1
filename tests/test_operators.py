"""Operator semantics on small literal frames (edges, ties, nulls)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratecard.functions.calendar import add_months
from ratecard.operators import experiment as ex
from ratecard.operators import features as fe
from ratecard.operators import forecast as fc
from ratecard.operators import pricing as pr
from ratecard.operators import segments as sg
from ratecard.params import AnalysisParams

D = dt.date


def test_month_end_arithmetic():
    assert add_months(D(2026, 8, 31), -6) == D(2026, 2, 28)
    assert add_months(D(2024, 3, 31), -1) == D(2024, 2, 29)


ACC_SCHEMA = ("customer_id long, true_segment string, signup_date date, industry string, "
              "region string, contract_type string")
Q_SCHEMA = ("customer_id long, segment string, quote_date date, service_level string, "
            "price_ratio double, quoted_price double, accepted int")


def test_churn_label_edges(spark):
    p = AnalysisParams(as_of=D(2026, 8, 20))
    w = fe.churn_windows(p)
    assert (w["cutoff"], w["label_end"], w["prior_start"]) == (D(2025, 8, 20), D(2026, 2, 20),
                                                                D(2024, 8, 20))
    acc = spark.createDataFrame([
        (1, "A", D(2020, 1, 1), "i", "r", "Spot"),      # active, accepts in label window
        (2, "A", D(2020, 1, 1), "i", "r", "Spot"),      # only rejected in label -> churned
        (3, "A", add_months(D(2025, 8, 20), 0) - dt.timedelta(days=89), "i", "r", "Spot"),  # 89 d
        (4, "A", D(2025, 8, 20) - dt.timedelta(days=90), "i", "r", "Spot"),  # exactly 90 d
        (5, "A", D(2020, 1, 1), "i", "r", "Spot"),      # no prior accepted -> ineligible
        (6, "A", D(2020, 1, 1), "i", "r", "Spot"),      # quote exactly on cutoff counts as label
    ], ACC_SCHEMA)
    q = spark.createDataFrame([
        (1, "A", D(2024, 8, 20), "Express", 1.0, 10.0, 1),   # first day of prior window
        (1, "A", D(2025, 9, 1), "Standard", 1.1, 11.0, 1),
        (2, "A", D(2025, 1, 1), "Standard", 1.0, 10.0, 1),
        (2, "A", D(2025, 9, 1), "Standard", 1.0, 10.0, 0),
        (3, "A", D(2025, 8, 1), "Standard", 1.0, 10.0, 1),
        (4, "A", D(2025, 8, 1), "Standard", 1.0, 10.0, 1),
        (5, "A", D(2025, 1, 1), "Standard", 1.0, 10.0, 0),
        (6, "A", D(2025, 8, 19), "Standard", 0.9, 10.0, 1),  # last prior day
        (6, "A", D(2025, 8, 20), "Standard", 1.0, 10.0, 1),  # cutoff day: label window
        (6, "A", D(2026, 2, 20), "Standard", 1.0, 10.0, 1),  # label end: excluded
    ], Q_SCHEMA)
    lab = {r.customer_id: r for r in fe.churn_labels(acc, q, p).collect()}
    assert set(lab) == {1, 2, 4, 6}
    assert lab[1].churned == 0 and lab[2].churned == 1 and lab[6].churned == 0
    assert lab[4].tenure_days_at_cutoff == 90
    assert lab[1].n_quotes_12m == 1 and lab[1].express_share_12m == 1.0
    assert lab[1].price_ratio_trend is None          # no quote in the last 3 months
    assert lab[6].price_ratio_trend is None          # no quote in the first 3 months
    assert lab[6].avg_price_ratio_12m == pytest.approx(0.9)


def test_drop_open_month_only_when_as_of_month(spark):
    panel = spark.createDataFrame([(D(2026, 7, 1), "A", 1.0, 1), (D(2026, 8, 1), "A", 2.0, 1)],
                                  "month date, segment string, revenue double, shipments long")
    assert fe.drop_open_month(panel, D(2026, 8, 20)).count() == 1
    assert fe.drop_open_month(panel, D(2026, 9, 2)).count() == 2


def test_rfm_zero_monetary_and_tenure_floor(spark):
    acc = spark.createDataFrame([(1, "A", D(2026, 8, 1), "i", "r", "Spot")], ACC_SCHEMA)
    q = spark.createDataFrame([(1, "A", D(2026, 8, 10), "Express", 1.0, 10.0, 0)],
                              Q_SCHEMA).withColumn("weight_kg", F.lit(2.0)).withColumn(
                                  "distance_km", F.lit(3.0))
    r = fe.rfm_features(acc, q, D(2026, 8, 20)).first()
    assert r.monetary == 0.0 and r.recency_days == 10 and r.tenure_years == 0.08


def test_ari_and_dominant_tier_ties(spark):
    rows = [(i, "A" if i < 4 else "B", 0 if i < 4 else 1) for i in range(8)]
    df = spark.createDataFrame(rows, "customer_id long, true_segment string, cluster int")
    assert sg.adjusted_rand_index(df, "cluster", "true_segment").first().ari == pytest.approx(1.0)
    tie = spark.createDataFrame([(0, "B", 0), (1, "A", 0)], "customer_id long, true_segment string, cluster int")
    d = sg.dominant_tier(tie, "cluster", "true_segment", ("A", "B")).first()
    assert d.dominant_tier == "A"   # first in tier order wins ties


def test_ari_matches_formula(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, 200)
    b = (a + (rng.random(200) < 0.3)) % 3
    df = spark.createDataFrame([(int(i), int(x), int(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "id long, a int, b int")
    got = sg.adjusted_rand_index(df, "a", "b").first().ari
    from math import comb
    cont = np.zeros((3, 3), int)
    for x, y in zip(a, b):
        cont[x, y] += 1
    sij = sum(comb(int(v), 2) for v in cont.ravel())
    sa = sum(comb(int(v), 2) for v in cont.sum(1))
    sb = sum(comb(int(v), 2) for v in cont.sum(0))
    e = sa * sb / comb(200, 2)
    assert got == pytest.approx((sij - e) / ((sa + sb) / 2 - e), rel=1e-12)


def test_arms_balanced_within_segment(spark):
    acc = spark.createDataFrame([(i, "S" if i % 3 else "T", D(2020, 1, 1), "i", "r", "Spot")
                                 for i in range(101)], ACC_SCHEMA)
    a = ex.assign_arms(acc, "salt").groupBy("true_segment", "arm").count().toPandas()
    for seg, g in a.groupby("true_segment"):
        c = dict(zip(g.arm, g["count"]))
        assert c["treatment"] - c["control"] in (0, 1)   # control gets the smaller half


def test_typical_shipment_mode_ties_and_fallback(spark):
    schema = ("segment string, weight_kg double, distance_km double, competitor_price double, "
              "mode string, service_level string, contract_type string")
    test = spark.createDataFrame([("A", 1.0, 2.0, 10.0, "Air", "Express", "Spot"),
                                  ("A", 3.0, 4.0, 20.0, "Ground", "Standard", "Contract")], schema)
    train = spark.createDataFrame([("B", 5.0, 6.0, 30.0, "Ocean", "Standard", "Spot")], schema)
    t = {r.segment: r for r in pr.typical_shipment(test, train).collect()}
    assert t["A"].weight_kg == 2.0 and t["A"].mode == "Air" and t["A"].contract_type == "Contract"
    assert t["B"].competitor_price == 30.0   # segment absent from test falls back to train


def test_recommendation_prefers_first_grid_point_on_ties(spark):
    curves = spark.createDataFrame(
        [("A", 0.9, 0.5, 1.0, True), ("A", 1.0, 0.5, 1.0, True), ("A", 1.1, 0.5, 2.0, False)],
        "segment string, price_ratio double, pred_accept_prob double, expected_revenue double, "
        "well_supported boolean")
    quotes = spark.createDataFrame([("A", 1.0)], "segment string, price_ratio double")
    r = pr.recommend_price(curves, quotes).first()
    assert r.recommended_price_ratio == 0.9 and r.optimum_still_rising_at_data_edge is False


def test_trend_fit_equals_dummy_regression(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s, base in (("A", 100.0), ("B", 40.0)):
        for i in range(30):
            m = D(2020 + i // 12, i % 12 + 1, 1)
            rows.append((s, m, float(base + 2.0 * i + 5 * np.sin(2 * np.pi * m.month / 12)
                         + rng.normal(0, 1)), i))
    df = spark.createDataFrame(rows, "segment string, month date, revenue double, time_idx int")
    coefs = {r.segment: r for r in fc.fit_trend(df).collect()}
    X = np.array([[1.0 if r[0] == "A" else 0.0, 1.0 if r[0] == "B" else 0.0, r[3],
                   np.sin(2 * np.pi * r[1].month / 12), np.cos(2 * np.pi * r[1].month / 12)]
                  for r in rows])
    y = np.array([r[2] for r in rows])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert coefs["A"].alpha == pytest.approx(beta[0], rel=1e-9)
    assert coefs["B"].b_t == pytest.approx(beta[2], rel=1e-9)


def test_recursive_forecast_feeds_predictions_back(spark):
    rows = [("A", add_months(D(2020, 1, 1), i), float(i)) for i in range(24)]
    dense = spark.createDataFrame(rows, "segment string, month date, revenue double")
    out = fc.recursive_forecast(dense, F.lit(D(2021, 7, 1)), 3, fc.stub_recursive_model)
    got = [r.forecast for r in out.orderBy("month").collect()]
    y = [float(i) for i in range(24)]
    p1 = 0.6 * y[17] + 0.4 * y[6]
    p2 = 0.6 * p1 + 0.4 * y[7]
    p3 = 0.6 * p2 + 0.4 * y[8]
    assert got == pytest.approx([p1, p2, p3], rel=1e-12)


def test_dense_panel_fills_gaps(spark):
    panel = spark.createDataFrame([(D(2020, 1, 1), "A", 1.0, 1), (D(2020, 3, 1), "A", 3.0, 1),
                                   (D(2020, 2, 1), "B", 2.0, 1)],
                                  "month date, segment string, revenue double, shipments long")
    d = fc.dense_panel(panel)
    assert d.count() == 6
    assert d.where("segment = 'A' AND month = DATE '2020-02-01'").first().revenue == 0.0
