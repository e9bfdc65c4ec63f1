"""Segment-level revenue forecasting on the monthly panel.

The panel has one row per (segment, month) -- its size is fixed by the
calendar and the number of segments, not by the fact table -- so windows
partitioned by segment are the natural tool here.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAGS = (1, 2, 3, 6, 12)
FEATURE_COLS = ("time_idx", "month_sin", "month_cos", "lag1", "lag2", "lag3", "lag6", "lag12",
                "roll3", "roll6")
EPS = 2.220446049250313e-16


def _cyc(month_col: str = "month"):
    angle = F.lit(2 * math.pi) * F.month(F.col(month_col)).cast("double") / F.lit(12.0)
    return F.sin(angle).alias("month_sin"), F.cos(angle).alias("month_cos")


def dense_panel(panel: DataFrame) -> DataFrame:
    """Gap-free (segment x month) spine, missing months filled with 0:
    positional lags need one row per month."""
    lo = panel.agg(F.min("month")).scalar()
    hi = panel.agg(F.max("month")).scalar()
    spine = (panel.select("segment").distinct()
             .withColumn("_lo", lo).withColumn("_hi", hi)
             .select("segment", F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH")))
                     .alias("month")))
    return (spine.join(panel, ["segment", "month"], "left")
            .select("segment", "month", F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
                    F.coalesce("shipments", F.lit(0)).cast("long").alias("shipments")))


def with_time_index(dense: DataFrame) -> DataFrame:
    w = Window.partitionBy("segment").orderBy("month")
    return dense.withColumn("time_idx", (F.row_number().over(w) - 1).cast("int"))


def lag_features(dense: DataFrame, warmup: int = 12) -> DataFrame:
    """Lags 1,2,3,6,12, trailing means of 3 and 6 (current row excluded),
    cyclical month, time index; rows with fewer than ``warmup``
    predecessors are dropped."""
    w = Window.partitionBy("segment").orderBy("month")
    d = with_time_index(dense)
    lags = {f"lag{k}": F.lag("revenue", k).over(w) for k in range(1, 13)}
    d = d.select("*", *[v.alias(k) for k, v in lags.items()])
    roll3 = (F.col("lag1") + F.col("lag2") + F.col("lag3")) / F.lit(3.0)
    roll6 = (F.col("lag1") + F.col("lag2") + F.col("lag3") + F.col("lag4") + F.col("lag5")
             + F.col("lag6")) / F.lit(6.0)
    return (d.where(F.col("time_idx") >= warmup)
            .select("segment", "month", "time_idx", *_cyc(),
                    *[F.col(f"lag{k}") for k in LAGS], roll3.alias("roll3"),
                    roll6.alias("roll6"), F.col("revenue").alias("target")))


def holdout_start(dense: DataFrame, months: int) -> F.Column:
    """First holdout month = newest month - (months - 1)."""
    return F.add_months(dense.agg(F.max("month")).scalar(), -(months - 1))


def seasonal_naive(dense: DataFrame, rows: DataFrame) -> DataFrame:
    """Value of the same segment 12 calendar months earlier (null if absent):
    a self-join on the shifted month, not a positional lag."""
    shifted = dense.select("segment", F.add_months("month", 12).alias("month"),
                           F.col("revenue").alias("naive_forecast"))
    return rows.join(shifted, ["segment", "month"], "left")


# ---- trend + season regression, closed form ------------------------------------

def fit_trend(train: DataFrame) -> DataFrame:
    """OLS of revenue on time_idx, sin, cos with one intercept per segment
    (pooled slopes), via within-segment centring.

    Spark computes the per-segment means and the nine centred cross-product
    sums in two small aggregations; the resulting 3x3 normal equations (one
    row of nine numbers, like any ML fit's coefficient vector) are solved
    on the driver. Returns (segment, alpha, b_t, b_s, b_c)."""
    import numpy as np
    x = train.select("segment", F.col("time_idx").cast("double").alias("t"), *_cyc(),
                     F.col("revenue").alias("y"))
    x = x.withColumnRenamed("month_sin", "s").withColumnRenamed("month_cos", "c")
    means = x.groupBy("segment").agg(*[F.avg(c).alias(f"m_{c}") for c in ("t", "s", "c", "y")])
    means = means.persist()   # one row per segment, held while the sums are taken
    cen = x.join(means, "segment").select(
        "segment", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in ("t", "s", "c", "y")])
    pairs = [("t", "t"), ("t", "s"), ("t", "c"), ("s", "s"), ("s", "c"), ("c", "c"),
             ("t", "y"), ("s", "y"), ("c", "y")]
    S = cen.agg(*[F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs]).first()
    means.unpersist()
    A = np.array([[S.tt, S.ts, S.tc], [S.ts, S.ss, S.sc], [S.tc, S.sc, S.cc]], dtype=float)
    b = np.array([S.ty, S.sy, S.cy], dtype=float)
    bt, bs, bc = (float(v) for v in np.linalg.solve(A, b))
    return means.select(
        "segment",
        (F.col("m_y") - F.lit(bt) * F.col("m_t") - F.lit(bs) * F.col("m_s")
         - F.lit(bc) * F.col("m_c")).alias("alpha"),
        F.lit(bt).alias("b_t"), F.lit(bs).alias("b_s"), F.lit(bc).alias("b_c"))


def predict_trend(rows: DataFrame, coefs: DataFrame, out: str = "trend_forecast") -> DataFrame:
    s, c = _cyc()
    return (rows.join(coefs, "segment")
            .withColumn(out, F.col("alpha") + F.col("b_t") * F.col("time_idx").cast("double")
                        + F.col("b_s") * s + F.col("b_c") * c)
            .drop("alpha", "b_t", "b_s", "b_c"))


# ---- recursive multi-step forecasting ---------------------------------------------

def _next_month_columns(w) -> list:
    """For every history row: the feature row of the month after it, were
    it the newest (lags are the row's value and its 11 predecessors)."""
    v = F.col("value")
    lag = {1: v, **{k: F.lag("value", k - 1).over(w) for k in range(2, 13)}}
    return [F.add_months("month", 1).alias("month"), (F.col("time_idx") + 1).alias("time_idx"),
            *[lag[k].alias(f"lag{k}") for k in range(1, 13)]]


def recursive_forecast(dense: DataFrame, start: F.Column | None, steps: int,
                       predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Walk forward ``steps`` months from ``start`` (None = after the newest
    month); each prediction becomes history for the next step.

    One step is one window pass over the (calendar-bounded) panel: every
    row computes next-month features, the model scores them, and the
    newest row of each segment emits itself plus the predicted month
    (``explode``). History is referenced once per step, so the plan grows
    linearly with the horizon and the whole walk runs as a single job; the
    driver loops over steps only, never over series.
    """
    hist = with_time_index(dense)
    if start is not None:
        hist = hist.where(F.col("month") < start)
    hist = hist.select("segment", "month", F.col("revenue").alias("value"), "time_idx",
                       F.lit(False).alias("_pred"))
    w = Window.partitionBy("segment").orderBy("month")
    newest = Window.partitionBy("segment").orderBy(F.col("month").desc())
    keep = ["segment", "month", "value", "time_idx", "_pred"]
    for _ in range(steps):
        nxt = hist.select("segment", *[F.col(c).alias(f"_cur_{c}") for c in keep[1:]],
                          (F.row_number().over(newest) == 1).alias("_newest"),
                          *_next_month_columns(w))
        roll3 = (F.col("lag1") + F.col("lag2") + F.col("lag3")) / F.lit(3.0)
        roll6 = (F.col("lag1") + F.col("lag2") + F.col("lag3") + F.col("lag4") + F.col("lag5")
                 + F.col("lag6")) / F.lit(6.0)
        nxt = nxt.select("*", *_cyc(), roll3.alias("roll3"), roll6.alias("roll6"))
        scored = predict(nxt)
        cur = F.struct(F.col("segment"), *[F.col(f"_cur_{c}").alias(c) for c in keep[1:]])
        new = F.struct(F.col("segment"), F.col("month"),
                       F.col("prediction").cast("double").alias("value"),
                       F.col("time_idx"), F.lit(True).alias("_pred"))
        hist = (scored.select(F.explode(F.when(F.col("_newest"), F.array(cur, new))
                                        .otherwise(F.array(cur))).alias("_r"))
                .select("_r.*"))
    return hist.where("_pred").select("segment", "month", F.col("value").alias("forecast"))


def stub_recursive_model(feats: DataFrame) -> DataFrame:
    """Fixed linear model of the lags (checkable stand-in for a fitted one)."""
    return feats.withColumn("prediction", F.lit(0.6) * F.col("lag1") + F.lit(0.4) * F.col("lag12"))


def gbt_model(train_features: DataFrame, max_iter: int = 250, seed: int = 42):
    """Boosted regressor on segment one-hot + lag features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    stages = [StringIndexer(inputCol="segment", outputCol="_seg_ix", handleInvalid="keep"),
              OneHotEncoder(inputCols=["_seg_ix"], outputCols=["_seg_oh"], handleInvalid="keep"),
              VectorAssembler(inputCols=["_seg_oh", *FEATURE_COLS], outputCol="features",
                              handleInvalid="keep"),
              GBTRegressor(featuresCol="features", labelCol="target", maxDepth=3, stepSize=0.07,
                           maxIter=max_iter, maxBins=255, seed=seed, checkpointInterval=25)]
    model = Pipeline(stages=stages).fit(train_features)

    def predict(feats: DataFrame) -> DataFrame:
        return model.transform(feats).drop("features", "_seg_ix", "_seg_oh")
    return predict


# ---- evaluation ----------------------------------------------------------------------

def mape(actual: str, forecast: str) -> F.Column:
    return F.avg(F.abs(F.col(actual) - F.col(forecast))
                 / F.greatest(F.abs(F.col(actual)), F.lit(EPS)))


def backtest_metrics(bt: DataFrame, candidates=("trend_seasonal", "recursive")) -> DataFrame:
    """MAPE per segment on rows where naive and trend exist; winner among
    the fitted candidates, first listed wins ties."""
    rows = bt.where(F.col("naive_forecast").isNotNull() & F.col("trend_forecast").isNotNull())
    m = rows.groupBy("segment").agg(
        mape("revenue", "naive_forecast").alias("naive_mape"),
        mape("revenue", "trend_forecast").alias("trend_seasonal_mape"),
        mape("revenue", "forecast").alias("recursive_mape"))
    a, b = candidates
    return m.withColumn("best_method", F.when(F.col(f"{a}_mape") <= F.col(f"{b}_mape"), a)
                        .otherwise(b))


def blend(bt: DataFrame, metrics: DataFrame) -> DataFrame:
    return (bt.join(metrics.select("segment", "best_method"), "segment", "left")
            .withColumn("blended_forecast",
                        F.when(F.col("best_method") == "trend_seasonal", F.col("trend_forecast"))
                        .otherwise(F.col("forecast")))
            .drop("best_method"))
