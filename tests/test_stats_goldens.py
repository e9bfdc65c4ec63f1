"""Statistical functions and the published golden numbers (copied here as
literals) recomputed with our operators."""

import math

import pytest
from pyspark.sql import functions as F

from ratecard.functions.stats import betainc_reg, erfc, t_two_sided_p_scalar
from ratecard.operators import experiment as ex
from ratecard.operators import forecast as fc


def test_erfc_column_matches_math(spark):
    xs = [-3.0, -1.0, -0.2, 0.0, 0.1, 0.5, 1.0, 2.0, 3.5, 4.6446 / math.sqrt(2)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(erfc("x").alias("e")).collect()
    for x, r in zip(xs, got):
        assert abs(r.e - math.erfc(x)) <= 1.2e-7 * math.erfc(x) + 1e-15


def test_student_t_pvalue_known_values():
    # t = 2.228 at 10 df is the two-sided 5% point; t = 0 gives 1
    assert abs(t_two_sided_p_scalar(2.228138851986274, 10.0) - 0.05) < 1e-9
    assert abs(t_two_sided_p_scalar(0.0, 7.0) - 1.0) < 1e-12
    # 1 df is Cauchy: p = 1 - 2/pi * atan(|t|)
    assert abs(t_two_sided_p_scalar(1.5, 1.0) - (1 - 2 / math.pi * math.atan(1.5))) < 1e-12
    assert abs(betainc_reg(2.0, 3.0, 0.4) - 0.5248) < 1e-12


def _wide_counts(spark, rows):
    """(segment, arm, n, accepted) literal counts -> experiment rows with
    revenue 0 (the proportion tests only need counts)."""
    out = []
    for seg, arm, n, x in rows:
        out += [(seg, arm, 1, 0.0)] * x + [(seg, arm, 0, 0.0)] * (n - x)
    return spark.createDataFrame(out, "segment string, arm string, accepted int, revenue double")


# G5 / G6: published arm counts and p-values (fixed values)
G5 = [("Enterprise", 262, 248, 255, 237, 0.41839216302831383),
      ("Mid-Market", 819, 758, 797, 700, 0.0013951543126267119),
      ("SMB", 550, 501, 521, 453, 0.029834959840701503),
      ("Occasional", 162, 145, 166, 130, 0.005895891101408646)]


def test_g5_g6_two_proportion_ztest(spark):
    rows = []
    for seg, nc, xc, nt, xt, _ in G5:
        rows += [(seg, "control", nc, xc), (seg, "treatment", nt, xt)]
    exp = _wide_counts(spark, rows)
    eff = ex.segment_effects(exp).toPandas().set_index("segment")
    for seg, nc, xc, nt, xt, p in G5:
        assert eff.loc[seg, "n_control"] == nc
        assert eff.loc[seg, "accept_pval"] == pytest.approx(p, rel=2e-6)
    z = ex.ztest(exp).first()
    assert (z.n_control, z.n_treatment) == (1793, 1739)
    assert z.z == pytest.approx(-4.6446, abs=1e-4)
    assert z.accept_pval == pytest.approx(3.4069989574003756e-06, rel=2e-6)
    assert z.accept_control == pytest.approx(0.9213608477412158, abs=1e-15)


def test_guardrail_is_strict(spark):
    eff = spark.createDataFrame([("a", -0.03), ("b", -0.0300001), ("c", 0.01)],
                                "segment string, accept_diff double")
    g = {r.segment: r.breached for r in ex.guardrail(eff, 0.03).collect()}
    assert g == {"a": False, "b": True, "c": False}


def test_g7_decile_cumulative(spark):
    # published decile sizes and churners (fixed values)
    n = [69, 69, 69, 69, 68, 69, 69, 69, 69, 69]
    c = [26, 19, 11, 7, 3, 5, 1, 1, 0, 0]
    assert sum(n) == 689 and sum(c) == 73
    cum = [sum(c[: i + 1]) for i in range(10)]
    assert cum[1] / 73 == pytest.approx(0.6164383561643836)
    assert cum[4] / 73 == pytest.approx(0.9041095890410958)


def test_g4_mape_and_winner(spark):
    # Enterprise rows of the published backtest (fixed values)
    rows = [("Enterprise", "2026-02-01", 54638.3, 52161.64, 69368.13186047919, 65495.536248229735),
            ("Enterprise", "2026-03-01", 53959.21, 48338.66, 70179.06930278553, 65633.47010258392),
            ("Enterprise", "2026-04-01", 56480.99, 51797.64, 71136.93249085323, 72502.32752123353),
            ("Enterprise", "2026-05-01", 57157.38, 56985.36, 72246.9286740048, 74205.0732374879),
            ("Enterprise", "2026-06-01", 55474.69, 50208.08, 73473.50118838783, 76863.07400162722),
            ("Enterprise", "2026-07-01", 74725.56, 58312.59, 74749.8568363399, 77615.389977504)]
    bt = spark.createDataFrame(rows, "segment string, month string, revenue double, "
                                     "naive_forecast double, trend_forecast double, forecast double")
    m = fc.backtest_metrics(bt).first()
    assert m.naive_mape == pytest.approx(0.091666723316703, rel=1e-12)
    assert m.trend_seasonal_mape == pytest.approx(0.23640723279603848, rel=1e-12)
    assert m.recursive_mape == pytest.approx(0.23686782946460216, rel=1e-12)
    assert m.best_method == "trend_seasonal"


def test_g8_implied_move_uses_rounded_ratios(spark):
    # published: current 1.04, recommended 1.17 -> +12.5 %
    df = spark.createDataFrame([(1.04, 1.17)], "c double, r double")
    v = df.select((F.col("r") / F.col("c") - 1).alias("m")).first().m
    assert v == pytest.approx(0.125, abs=1e-12)


def test_g9_annual_volume_times_lift():
    # published impact / lift per quote = trailing-year quote volume
    lift = 192.44661871953693 - 175.82173786027406
    assert round(355822.3250308033 / lift) == 21403


def test_sample_size_per_arm(spark):
    # SURVEY check: 2,554 quotes per arm to see 2 points from a 92 % baseline
    n_q = 10_000
    rows = [("A", 1 if i < 9_200 else 0) for i in range(n_q)]
    q = spark.createDataFrame(rows, "segment string, accepted int")
    r = ex.sample_size(q, q.limit(0), 0.02, 0.05, 0.80).first()
    assert r.baseline_rate == pytest.approx(0.92)
    assert r.n_needed_per_arm == 2554
    assert r.available_quotes == 0
