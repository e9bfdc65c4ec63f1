"""Willingness-to-pay: time split, response models, demand curves and
support-capped price recommendations per segment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratecard.functions.exact import dec_avg
from ratecard.functions.stats import isclose, logistic
from ratecard.operators.selection import selected_quantiles
from ratecard.session import freeze

# The names of the model's columns.
NUM_FEATURES = ("price_ratio", "weight_kg", "distance_km", "competitor_price")
CAT_FEATURES = ("segment", "service_level", "mode", "contract_type")
TYPICAL_NUM = ("weight_kg", "distance_km", "competitor_price")
TYPICAL_CAT = ("mode", "service_level", "contract_type")


def with_contract(quotes: DataFrame, accounts: DataFrame) -> DataFrame:
    """Fact left-join the account dimension on customer_id (J1)."""
    return quotes.join(accounts.select("customer_id", "contract_type"), "customer_id", "left")


def holdout_cutoff(quotes: DataFrame, months: int) -> F.Column:
    """max(quote_date) - months, as a scalar subquery."""
    return F.add_months(quotes.agg(F.max("quote_date")).scalar(), -months)


def time_split(quotes: DataFrame, months: int) -> DataFrame:
    """Tag every quote train (< cutoff) or test (>= cutoff)."""
    cut = holdout_cutoff(quotes, months)
    return (quotes.withColumn("cutoff", cut)
            .withColumn("split", F.when(F.col("quote_date") < F.col("cutoff"), "train")
                        .otherwise("test")))


def support_bound(quotes: DataFrame, q: float = 0.97) -> DataFrame:
    """Per-segment exact quantile of price_ratio (linear interpolation), by
    radix selection: the ratios are neither sorted nor exchanged. The quotes
    are read a few times: they should be a stored table."""
    return selected_quantiles(quotes, ["segment"], ["price_ratio"], [q], written=True).select(
        "segment", F.col("value").alias("support_upper"))


def typical_shipment(test: DataFrame, train: DataFrame) -> DataFrame:
    """Per segment: medians of the numeric shipment columns and modes
    (smallest value on ties) of the categorical ones, from the test rows,
    falling back to the training rows for segments absent from test. The
    test rows are written once, with these columns only; training rows are
    read beyond their segment only if a segment is absent."""
    cols = ["segment", *TYPICAL_NUM, *TYPICAL_CAT]
    rows = freeze(test.select(*cols))
    absent = freeze(train.select("segment").distinct()
                    .join(rows.select("segment").distinct(), "segment", "left_anti"))
    if not absent.isEmpty():
        rows = rows.unionByName(freeze(train.select(*cols).join(absent, "segment", "left_semi")))
    med = (selected_quantiles(rows, ["segment"], TYPICAL_NUM, [0.5], written=True)
           .groupBy("segment").pivot("column", list(TYPICAL_NUM)).agg(F.first("value")))
    # the combinations are counted first: only their few rows are unfolded
    combos = rows.groupBy("segment", *TYPICAL_CAT).agg(F.count(F.lit(1)).alias("_n"))
    cat = combos.select("segment", "_n", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in TYPICAL_CAT])))
    counts = cat.groupBy("segment", "feature", "v").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("segment", "feature").orderBy(F.col("_n").desc(), F.col("v"))
    modes = (counts.withColumn("_r", F.row_number().over(w)).where("_r = 1")
             .groupBy("segment").pivot("feature", list(TYPICAL_CAT)).agg(F.first("v")))
    return med.join(modes, "segment")


def price_grid(typical: DataFrame, start: float, step: float, points: int) -> DataFrame:
    """Each segment's typical shipment at every grid price ratio: a bounded
    explode (segments x points), no join."""
    return (typical.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("price_ratio", F.round(F.lit(start) + F.col("_i") * F.lit(step), 2))
            .drop("_i"))


def stub_accept_prob(df: DataFrame) -> F.Column:
    """Fixed-coefficient logistic response (stands in for a fitted model
    where results are checked against SQL)."""
    z = (F.lit(2.0) - F.lit(8.0) * (F.col("price_ratio") - F.lit(1.0))
         + F.lit(0.4) * (F.col("service_level") == "Express").cast("double"))
    return F.round(logistic(z), 6)


def demand_curve(typical: DataFrame, support: DataFrame, score: Callable[[DataFrame], DataFrame],
                 start: float = 0.70, step: float = 0.01, points: int = 66) -> DataFrame:
    """Score the grid; ``score`` adds ``pred_accept_prob`` (stub or model)."""
    grid = price_grid(typical, start, step, points)
    scored = score(grid)
    return (scored.join(support, "segment")
            .withColumn("quoted_price", F.col("price_ratio") * F.col("competitor_price"))
            .withColumn("expected_revenue", F.col("quoted_price") * F.col("pred_accept_prob"))
            .withColumn("well_supported", F.col("price_ratio") <= F.col("support_upper")))


def unsupported_tail(curves: DataFrame) -> DataFrame:
    """The curve beyond the supported range, joined to it: the last supported
    point (``is_edge``) and all points after it, for segments that have any."""
    w = Window.partitionBy("segment")   # grid points of one segment
    sup = F.col("well_supported")
    marked = (curves.withColumn("_edge", F.max(F.when(sup, F.col("price_ratio"))).over(w))
              .withColumn("_beyond", F.count(F.when(~sup, F.lit(1))).over(w)))
    return (marked.where(~sup | ((F.col("_beyond") > 0) & (F.col("price_ratio") == F.col("_edge"))))
            .select("segment", "price_ratio", "expected_revenue", sup.alias("is_edge")))


def current_ratio(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("segment").agg(dec_avg("price_ratio").alias("_current"))


def recommend_price(curves: DataFrame, quotes: DataFrame) -> DataFrame:
    """Expected-revenue arg-max inside the supported range, per segment;
    flag optima sitting on the support edge. The implied move divides the
    *rounded* recommendation by the *rounded* current ratio."""
    sup = curves.where(F.col("well_supported"))
    w = Window.partitionBy("segment").orderBy(F.col("expected_revenue").desc(),
                                              F.col("price_ratio"))
    edge = sup.groupBy("segment").agg(F.max("price_ratio").alias("_edge"))
    best = sup.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    out = (best.join(edge, "segment").join(current_ratio(quotes), "segment")
           .select("segment",
                   F.round("_current", 3).alias("current_avg_price_ratio"),
                   F.round("price_ratio", 3).alias("recommended_price_ratio"),
                   F.round("pred_accept_prob", 3).alias("recommended_accept_prob"),
                   F.round("expected_revenue", 2).alias("expected_revenue_at_recommendation"),
                   isclose(F.col("price_ratio"), F.col("_edge"))
                   .alias("optimum_still_rising_at_data_edge")))
    return out.withColumn("implied_price_move",
                          F.col("recommended_price_ratio") / F.col("current_avg_price_ratio") - 1)


# ---- fitted response models (Spark ML) --------------------------------------

def fit_response_model(train: DataFrame, which: str, gbt_iter: int = 300, seed: int = 42):
    """One acceptance model: ``Logistic Regression`` or ``Gradient Boosting``."""
    from ratecard.operators.churn import fit_gbt, fit_logistic
    if which == "Logistic Regression":
        return fit_logistic(train, CAT_FEATURES, NUM_FEATURES, "accepted")
    return fit_gbt(train, CAT_FEATURES, NUM_FEATURES, "accepted", max_depth=4, step=0.08,
                   max_iter=gbt_iter, seed=seed)


def model_scorer(model) -> Callable[[DataFrame], DataFrame]:
    from ratecard.operators.churn import positive_probability

    def score(df: DataFrame) -> DataFrame:
        return positive_probability(model, df, "pred_accept_prob")
    return score
