"""Account- and panel-level feature tables (churn labels, RFM, monthly panel)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecard.functions.calendar import add_months, month_start
from ratecard.functions.exact import dec_sum, money_sum
from ratecard.params import AnalysisParams


# ---- B2 / B3: monthly revenue panel ---------------------------------------

def monthly_revenue(quotes: DataFrame, start: dt.date | None = None) -> DataFrame:
    """Accepted quotes rolled up to (month, segment): revenue and shipments.

    Partial aggregation happens map-side; the shuffle carries one row per
    (task, month, segment), so the panel is tiny whatever the fact size.
    """
    acc = quotes.where(F.col("accepted") == 1)
    if start is not None:
        acc = acc.where(F.col("quote_date") >= F.lit(start))
    return (acc.groupBy(month_start("quote_date").alias("month"), "segment")
            .agg(money_sum("quoted_price").alias("revenue"),
                 F.count(F.lit(1)).alias("shipments")))


def drop_open_month(panel: DataFrame, as_of: dt.date) -> DataFrame:
    """Remove the newest month only when it is the (incomplete) as-of month."""
    newest = panel.agg(F.max("month")).scalar()   # scalar subquery
    open_month = F.lit(as_of.replace(day=1))
    return panel.where(~((newest == open_month) & (F.col("month") == newest)))


# ---- B1: leakage-safe churn labels -----------------------------------------

def churn_windows(p: AnalysisParams) -> dict:
    cutoff = add_months(p.as_of, -p.label_offset_months)
    label_end = add_months(p.as_of, -(p.label_offset_months - p.label_window_months))
    prior_start = add_months(cutoff, -p.prior_window_months)
    return dict(cutoff=cutoff, label_end=label_end, prior_start=prior_start,
                early_end=add_months(prior_start, p.trend_edge_months),
                late_start=add_months(cutoff, -p.trend_edge_months))


def churn_labels(accounts: DataFrame, quotes: DataFrame, p: AnalysisParams) -> DataFrame:
    """Features from [prior_start, cutoff), label from [cutoff, label_end).

    One pass over the fact table: every window is a conditional aggregate
    of the same groupBy(customer_id), after one range filter that reaches
    the scan. churned = no *accepted* quote in the label window.
    """
    w = churn_windows(p)
    d = F.col("quote_date")
    prior = (d >= F.lit(w["prior_start"])) & (d < F.lit(w["cutoff"]))
    label = (d >= F.lit(w["cutoff"])) & (d < F.lit(w["label_end"]))
    early = prior & (d < F.lit(w["early_end"]))
    late = prior & (d >= F.lit(w["late_start"]))
    q = quotes.where((d >= F.lit(w["prior_start"])) & (d < F.lit(w["label_end"])))
    one = F.lit(1)
    agg = q.groupBy("customer_id").agg(
        F.count(F.when(prior, one)).alias("n_quotes_12m"),
        F.sum(F.when(prior, F.col("accepted"))).cast("long").alias("n_accepted_12m"),
        dec_sum(F.when(prior, F.col("price_ratio"))).alias("_ratio_sum"),
        money_sum(F.when(prior & (F.col("accepted") == 1), F.col("quoted_price"))).alias("_rev"),
        F.count(F.when(prior & (F.col("service_level") == "Express"), one)).alias("_n_express"),
        dec_sum(F.when(early, F.col("price_ratio"))).alias("_early_sum"),
        F.count(F.when(early, one)).alias("_early_n"),
        dec_sum(F.when(late, F.col("price_ratio"))).alias("_late_sum"),
        F.count(F.when(late, one)).alias("_late_n"),
        F.sum(F.when(label, F.col("accepted"))).alias("_label_acc"),
    )
    n = F.col("n_quotes_12m")
    tenure = F.datediff(F.lit(w["cutoff"]), F.col("signup_date"))
    out = (accounts.join(agg, "customer_id")
           .withColumn("tenure_days_at_cutoff", tenure)
           .where((F.col("tenure_days_at_cutoff") >= p.min_tenure_days)
                  & (F.coalesce(F.col("n_accepted_12m"), F.lit(0)) >= p.min_prior_accepted)))
    return out.select(
        "customer_id", "true_segment", "signup_date", "industry", "region", "contract_type",
        "tenure_days_at_cutoff", "n_quotes_12m", "n_accepted_12m",
        (F.col("_ratio_sum") / n).alias("avg_price_ratio_12m"),
        F.coalesce(F.col("_rev"), F.lit(0.0)).alias("revenue_12m"),
        (F.col("_n_express") / n).alias("express_share_12m"),
        (F.col("n_accepted_12m") / n).alias("acceptance_rate_12m"),
        (F.col("_late_sum") / F.nullif(F.col("_late_n"), F.lit(0))
         - F.col("_early_sum") / F.nullif(F.col("_early_n"), F.lit(0))).alias("price_ratio_trend"),
        F.when(F.coalesce(F.col("_label_acc"), F.lit(0)) == 0, 1).otherwise(0).alias("churned"),
    )


def segment_rate(labels: DataFrame, tier_order, segment_col: str = "true_segment",
                 label_col: str = "churned") -> DataFrame:
    """Churn rate per tier with the tier's display position (B11)."""
    order = F.array(*[F.lit(t) for t in tier_order])
    return (labels.groupBy(F.col(segment_col).alias("segment"))
            .agg(F.count(F.lit(1)).alias("n_accounts"),
                 F.sum(label_col).cast("long").alias("churners"))
            .withColumn("churn_rate", F.col("churners") / F.col("n_accounts"))
            .withColumn("tier_rank", F.array_position(order, F.col("segment")).cast("int")))


# ---- B4: RFM + behaviour features ------------------------------------------

def rfm_features(accounts: DataFrame, quotes: DataFrame, as_of: dt.date) -> DataFrame:
    """Recency/frequency/monetary and pricing behaviour per account, one
    groupBy over the fact table (the monetary sum is a conditional
    aggregate, not a second pass)."""
    agg = quotes.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.sum("accepted").alias("_n_acc"),
        dec_sum("price_ratio").alias("_ratio_sum"),
        F.count(F.when(F.col("service_level") == "Express", 1)).alias("_n_express"),
        dec_sum("weight_kg", scale=1).alias("_w_sum"),
        dec_sum("distance_km", scale=1).alias("_d_sum"),
        F.max("quote_date").alias("_last"),
        money_sum(F.when(F.col("accepted") == 1, F.col("quoted_price"))).alias("_monetary"),
    )
    f = F.col("frequency")
    base = accounts.join(agg, "customer_id").select(
        "customer_id", "true_segment", "signup_date", "industry", "region", "contract_type",
        F.datediff(F.lit(as_of), F.col("_last")).alias("recency_days"),
        "frequency",
        F.coalesce(F.col("_monetary"), F.lit(0.0)).alias("monetary"),
        (F.col("_n_acc") / f).alias("acceptance_rate"),
        (F.col("_ratio_sum") / f).alias("avg_price_ratio"),
        (F.col("_n_express") / f).alias("express_share"),
        (F.col("_w_sum") / f).alias("avg_weight_kg"),
        (F.col("_d_sum") / f).alias("avg_distance_km"),
        F.greatest(F.datediff(F.lit(as_of), F.col("signup_date")) / F.lit(365.25),
                   F.lit(0.08)).alias("tenure_years"),
    )
    return (base
            .withColumn("frequency_per_year", F.col("frequency") / F.col("tenure_years"))
            .withColumn("monetary_per_year", F.col("monetary") / F.col("tenure_years"))
            .withColumn("log_frequency", F.log1p("frequency_per_year"))
            .withColumn("log_monetary", F.log1p("monetary_per_year"))
            .withColumn("log_recency", F.log1p(F.col("recency_days").cast("double"))))


RFM_SUMMARY_COLS = ("recency_days", "frequency_per_year", "monetary_per_year",
                    "acceptance_rate", "avg_price_ratio", "express_share")


def numeric_summary(df: DataFrame, cols=RFM_SUMMARY_COLS) -> DataFrame:
    """mean / sample std / min / max per column, one row per column (A19).

    One aggregation pass computes every statistic; ``stack`` transposes the
    single result row.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`, `{c}__min`, `{c}__max`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean, std, min, max)")


# ---- B13: overview KPIs ----------------------------------------------------

def overview_kpis(accounts: DataFrame, quotes: DataFrame, labels: DataFrame) -> DataFrame:
    """Single-row headline numbers: one global aggregate over the fact
    table, the other two tables enter as scalar subqueries."""
    n_accounts = accounts.agg(F.count(F.lit(1))).scalar()
    n_eligible = labels.agg(F.count(F.lit(1))).scalar()
    n_churned = labels.agg(F.sum("churned").cast("long")).scalar()
    q = quotes.agg(F.count(F.lit(1)).alias("n_quotes"),
                   F.sum("accepted").cast("long").alias("n_accepted"),
                   money_sum(F.when(F.col("accepted") == 1, F.col("quoted_price")))
                   .alias("accepted_revenue"))
    return q.select(
        n_accounts.alias("n_accounts"), "n_quotes", "n_accepted", "accepted_revenue",
        (F.col("n_accepted") / F.col("n_quotes")).alias("acceptance_rate"),
        n_eligible.alias("churn_eligible_accounts"), n_churned.alias("churned_accounts"),
        (n_churned / n_eligible).alias("churn_rate_6m"))
