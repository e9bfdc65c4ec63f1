"""The registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the testdata tables through the logical-table mapping
and runs one operator family over the whole tables. Column names equal
those of the matching oracle SQL in ``ratecard.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecard.operators import features as fe
from ratecard.plans.context import Tables
from ratecard.session import ensure_checkpoint_dir, freeze, small_splits
from ratecard.sources.conformed import source_key
from ratecard.sources.io import (ACCOUNT_SCHEMA, RECOMMENDATION_SCHEMA, file_overlaps, rank_from_files, read_table,
                                 write_sorted, write_table)
from ratecard.sources.versions import publish, read_newest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# queries whose result comes from a fitted model / iterative algorithm:
# checked by row count and schema only (no oracle SQL)
ROWS_ONLY: set[str] = set()


def query(name: str, rows_only: bool = False):
    def deco(fn):
        QUERIES[name] = fn
        if rows_only:
            ROWS_ONLY.add(name)
        return fn
    return deco


def R(c, n: int):
    """Round a derived double (hides last-bit differences between engines)."""
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ---- panel ------------------------------------------------------------------

def monthly_of(t: Tables) -> DataFrame:
    """The monthly revenue, months x segments rows kept for the session."""
    return fitted(t, "monthly revenue", lambda: freeze(fe.monthly_revenue(t.quotes_once(), t.p.panel_start)))


@query("monthly_revenue")
def q_monthly_revenue(spark, sf_dir):
    return monthly_of(Tables(spark, sf_dir))


@query("open_month_dropped")
def q_open_month_dropped(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fe.drop_open_month(monthly_of(t),
                              t.p.as_of)


@query("holdout_month_labels")
def q_holdout_month_labels(spark, sf_dir):
    """The months of the forecast holdout with their printed label."""
    t = Tables(spark, sf_dir)
    panel = fe.drop_open_month(monthly_of(t), t.p.as_of)
    months = panel.select("month").distinct()
    cut = F.add_months(months.agg(F.max("month")).scalar(), -t.p.holdout_months)
    return months.where(F.col("month") > cut).select(
        F.date_format("month", "yyyy-MM").alias("label"), "month")


@query("accounts_from_csv")
def q_accounts_from_csv(spark, sf_dir):
    """The account table written as CSV and read back with its declared schema."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/accounts-csv-{uuid.uuid4().hex}"
    write_table(Tables(spark, sf_dir).accounts(), path, fmt="csv")
    return read_table(spark, path, ACCOUNT_SCHEMA, fmt="csv")


# ---- churn labels / RFM / KPIs ---------------------------------------------

def churn_labels_of(t: Tables) -> DataFrame:
    return fe.churn_labels(t.accounts(), t.quotes(), t.p)


@query("churn_labels")
def q_churn_labels(spark, sf_dir):
    return churn_labels_of(Tables(spark, sf_dir))


@query("churn_rate_by_segment")
def q_churn_rate_by_segment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fe.segment_rate(churn_labels_of(t), t.p.tier_order)


def rfm_of(t: Tables) -> DataFrame:
    """One row per account, kept for the session: clusters, profiles and scales read it several times."""
    return fitted(t, "rfm", lambda: freeze(fe.rfm_features(
        t.accounts(), t.quotes_once(by_order=True), t.p.as_of)))


@query("rfm_features")
def q_rfm_features(spark, sf_dir):
    df = rfm_of(Tables(spark, sf_dir))
    return df.select(*[R(c, 9).alias(c) if c in ("frequency_per_year", "monetary_per_year",
                                                 "log_frequency", "log_monetary", "log_recency",
                                                 "tenure_years")
                       else F.col(c) for c in df.columns])


@query("rfm_summary")
def q_rfm_summary(spark, sf_dir):
    s = fe.numeric_summary(rfm_of(Tables(spark, sf_dir)))
    return s.select("feature", R("mean", 6).alias("mean"), R("std", 6).alias("std"),
                    R("min", 9).alias("min"), R("max", 9).alias("max"))


@query("overview_kpis")
def q_overview_kpis(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return fe.overview_kpis(t.accounts(), t.quotes(), churn_labels_of(t))


# ---- segmentation (rule clusters: SQL-checkable) ---------------------------

from ratecard.operators import segments as sg  # noqa: E402
from ratecard.operators import silhouette as si  # noqa: E402


def rule_clusters_of(t: Tables) -> DataFrame:
    return sg.rule_clusters(rfm_of(t))


@query("tier_crosstab")
def q_tier_crosstab(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sg.crosstab(rule_clusters_of(t), "cluster", "true_segment", t.p.tier_order)


@query("tier_crosstab_pct")
def q_tier_crosstab_pct(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ct = sg.crosstab(rule_clusters_of(t), "cluster", "true_segment", t.p.tier_order)
    return sg.crosstab_row_pct(ct, "cluster", t.p.tier_order)


@query("adjusted_rand_index")
def q_adjusted_rand_index(spark, sf_dir):
    return sg.adjusted_rand_index(rule_clusters_of(Tables(spark, sf_dir)), "cluster", "true_segment")


@query("cluster_profile_names")
def q_cluster_profile_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    prof = sg.cluster_profile(rule_clusters_of(t), t.p.tier_order)
    return prof.select("cluster", *[R(c, 6).alias(c) for c in sg.PROFILE_COLS],
                       "n_customers", "dominant_tier", "cluster_name")


@query("misfiled_accounts")
def q_misfiled_accounts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    feat = rule_clusters_of(t)
    return sg.misfiled_accounts(feat, sg.cluster_profile(feat, t.p.tier_order))


@query("misfiled_share")
def q_misfiled_share(spark, sf_dir):
    t = Tables(spark, sf_dir)
    feat = rule_clusters_of(t)
    return sg.misfiled_share(feat, sg.cluster_profile(feat, t.p.tier_order))


@query("misfiled_top10")
def q_misfiled_top10(spark, sf_dir):
    """The ten most frequent (tier, cluster) pairs of misfiled accounts."""
    return (q_misfiled_accounts(spark, sf_dir)
            .orderBy(F.col("n_accounts").desc(), "true_segment", "cluster_name").limit(10))


@query("silhouette_rule_clusters")
def q_silhouette_rule_clusters(spark, sf_dir):
    """Mean silhouette (Euclidean, standardised features) of the rule clusters, each and overall."""
    feat = rule_clusters_of(Tables(spark, sf_dir))
    z = ch.zscores(feat, sg.SEGMENT_FEATURES).join(feat.select("customer_id", "cluster"), "customer_id")
    m = si.mean_silhouette(z, "customer_id", "cluster", [f"z_{c}" for c in sg.SEGMENT_FEATURES])
    return m.select("cluster", "n", R("silhouette", 9).alias("silhouette"))


def kmeans_of(t: Tables) -> tuple:
    """The fitted clusters and the standardised features, shared by the queries of a session."""
    return fitted(t, "kmeans", lambda: sg.kmeans_fit(rfm_of(t), t.p.k, t.p.seed))


@query("kmeans_segments", rows_only=True)
def q_kmeans_segments(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sg.kmeans_segments(*kmeans_of(t), t.p.tier_order)


@query("kmeans_k_sweep", rows_only=True)
def q_kmeans_k_sweep(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sg.kmeans_k_sweep(rfm_of(t), t.p.k_range, seed=t.p.seed)


@query("kmeans_tier_ari", rows_only=True)
def q_kmeans_tier_ari(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sg.adjusted_rand_index(sg.kmeans_segments(*kmeans_of(t), t.p.tier_order), "cluster", "true_segment")


@query("pca_2d", rows_only=True)
def q_pca_2d(spark, sf_dir):
    return sg.pca_2d(rfm_of(Tables(spark, sf_dir)))


# ---- churn preparation and ranking metrics (fixed arithmetic score) --------

from ratecard.operators import churn as ch  # noqa: E402
from ratecard.operators import inspection as ins  # noqa: E402
from ratecard.operators import ranking as rk  # noqa: E402


def stub_scored(t: Tables) -> DataFrame:
    lab = churn_labels_of(t)
    return lab.select("customer_id", "churned", ch.stub_risk_score(lab).alias("score"))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return rk.roc_auc(stub_scored(Tables(spark, sf_dir)), "score", "churned")


@query("average_precision")
def q_average_precision(spark, sf_dir):
    ap = rk.average_precision(stub_scored(Tables(spark, sf_dir)), "score", "churned")
    return ap.select(R("average_precision", 12).alias("average_precision"))


@query("roc_points")
def q_roc_points(spark, sf_dir):
    pts = rk.threshold_points(stub_scored(Tables(spark, sf_dir)), "score", "churned")
    return pts.select("threshold", "tp", "fp", "tpr", "fpr")


@query("pr_points")
def q_pr_points(spark, sf_dir):
    pts = rk.threshold_points(stub_scored(Tables(spark, sf_dir)), "score", "churned")
    return pts.select("threshold", "precision", "recall")


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    pts = rk.threshold_points(stub_scored(Tables(spark, sf_dir)), "score", "churned")
    return rk.curve_with_ends(pts, "fpr", "tpr", (0.0, 0.0))


@query("pr_curve")
def q_pr_curve(spark, sf_dir):
    pts = rk.threshold_points(stub_scored(Tables(spark, sf_dir)), "score", "churned")
    return rk.curve_with_ends(pts, "recall", "precision", (0.0, 1.0))


@query("decile_lift")
def q_decile_lift(spark, sf_dir):
    return rk.decile_lift(stub_scored(Tables(spark, sf_dir)), "score", "churned", "customer_id")


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = ch.stratified_split(churn_labels_of(t), "churned", "customer_id", t.p.test_fraction, t.p.salt)
    return s.select("customer_id", "churned", "split")


@query("stratified_split_counts")
def q_stratified_split_counts(spark, sf_dir):
    s = q_stratified_split(spark, sf_dir)
    return s.groupBy("split", "churned").agg(F.count(F.lit(1)).alias("n"))


@query("median_imputed")
def q_median_imputed(spark, sf_dir):
    mf = ch.model_frame(churn_labels_of(Tables(spark, sf_dir)))
    out = ch.median_impute(mf, "price_ratio_trend")
    return out.select("customer_id", R("price_ratio_trend_imputed", 12)
                      .alias("price_ratio_trend_imputed"), "trend_missing")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return ch.class_weights(churn_labels_of(Tables(spark, sf_dir)), "churned")


@query("zscore_features")
def q_zscore_features(spark, sf_dir):
    z = ch.zscores(churn_labels_of(Tables(spark, sf_dir)))
    return z.select("customer_id", *[R(c, 9).alias(c) for c in z.columns if c != "customer_id"])


@query("quote_sequence")
def q_quote_sequence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    q = t.quotes()
    # these name a line item; only they are sorted and carried
    order = ["customer_id", "quote_date", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    seq = rk.sequence_id(q.select(*order), order, "quote_id")
    return seq.select("quote_id", "customer_id", "quote_date", "l_orderkey", "l_linenumber")


QUOTE_ORDER = ["customer_id", "quote_date", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def sorted_quotes(t: Tables) -> DataFrame:
    """The quotes' keys as a table in global order, a file per range (written once per session)."""
    def make():
        path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/sorted-quotes-{uuid.uuid4().hex}"
        q = t.quotes().select(*QUOTE_ORDER)
        write_sorted(q, path, QUOTE_ORDER, rk.bucket_count(q))
        return path
    return read_table(t.spark, fitted(t, "sorted quotes", make))


@query("sorted_quotes_overlaps")
def q_sorted_quotes_overlaps(spark, sf_dir):
    """Rows of the sorted table, and files whose key range meets another's."""
    return file_overlaps(sorted_quotes(Tables(spark, sf_dir)), QUOTE_ORDER)


@query("sorted_quotes_rank")
def q_sorted_quotes_rank(spark, sf_dir):
    """Every quote's rank, read off its place in the sorted files."""
    ranked = rank_from_files(sorted_quotes(Tables(spark, sf_dir)), QUOTE_ORDER, "quote_id")
    return ranked.select("quote_id", "customer_id", "quote_date", "l_orderkey", "l_linenumber")


# ---- pricing ------------------------------------------------------------------

from ratecard.operators import pricing as pr  # noqa: E402


def priced_quotes(t: Tables) -> DataFrame:
    """The quotes with their contracts, only the columns that the pricing queries read, kept for the
    session: they are read several times, but need neither the keys nor the order of the stored quotes."""
    columns = dict.fromkeys(["quote_date", *pr.NUM_FEATURES, *pr.CAT_FEATURES, "accepted"])
    return fitted(t, "priced quotes", lambda: freeze(t.priced_once().select(*columns)))


def typical_of(t: Tables, q: DataFrame) -> DataFrame:
    split = pr.time_split(q, t.p.holdout_months)
    typ = pr.typical_shipment(split.where("split = 'test'").drop("split", "cutoff"),
                              split.where("split = 'train'").drop("split", "cutoff"))
    # medians of 2-decimal money / 1-decimal sizes: 6 decimals are exact
    return typ.select("segment", *[R(c, 6).alias(c) for c in pr.TYPICAL_NUM], *pr.TYPICAL_CAT)


def stub_curves(t: Tables) -> DataFrame:
    q = priced_quotes(t)
    return pr.demand_curve(typical_of(t, q), pr.support_bound(q, t.p.support_quantile),
                           lambda g: g.withColumn("pred_accept_prob", pr.stub_accept_prob(g)),
                           t.p.grid_start, t.p.grid_step, t.p.grid_points)


def stub_recommendation(t: Tables) -> DataFrame:
    return pr.recommend_price(stub_curves(t), priced_quotes(t))


@query("time_split_counts")
def q_time_split_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = pr.time_split(t.quotes(), t.p.holdout_months)
    return s.groupBy("split", "cutoff").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.sum("accepted").cast("long").alias("n_accepted"),
        (F.sum("accepted") / F.count(F.lit(1))).alias("acceptance_rate"))


@query("price_support_p97")
def q_price_support_p97(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = pr.support_bound(t.quotes(), t.p.support_quantile)
    return s.select("segment", R("support_upper", 10).alias("support_upper"))


@query("typical_shipment")
def q_typical_shipment(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return typical_of(t, priced_quotes(t))


@query("demand_curve_stub")
def q_demand_curve_stub(spark, sf_dir):
    c = stub_curves(Tables(spark, sf_dir))
    return c.select("segment", "price_ratio", "pred_accept_prob", "quoted_price",
                    "expected_revenue", "well_supported")


@query("demand_curve_tail")
def q_demand_curve_tail(spark, sf_dir):
    return pr.unsupported_tail(stub_curves(Tables(spark, sf_dir)))


@query("price_recommendation_stub")
def q_price_recommendation_stub(spark, sf_dir):
    return stub_recommendation(Tables(spark, sf_dir))


def stub_test_scores(t: Tables) -> DataFrame:
    s = pr.time_split(t.quotes(), t.p.holdout_months).where("split = 'test'")
    return s.select("accepted", pr.stub_accept_prob(s).alias("p"))


@query("log_loss_brier")
def q_log_loss_brier(spark, sf_dir):
    m = rk.log_loss_brier(stub_test_scores(Tables(spark, sf_dir)), "p", "accepted")
    return m.select(R("log_loss", 9).alias("log_loss"), R("brier", 9).alias("brier"), "n")


@query("calibration_bins")
def q_calibration_bins(spark, sf_dir):
    c = rk.calibration_bins(stub_test_scores(Tables(spark, sf_dir)), "p", "accepted")
    return c.select("bin", "n", R("mean_predicted", 9).alias("mean_predicted"),
                    R("fraction_positive", 9).alias("fraction_positive"))


def _scores_of(models: dict, test: DataFrame, label: str) -> DataFrame:
    """(model, p, label) of all models, one under the other."""
    parts = [ch.positive_probability(m, test, "p").select(F.lit(name).alias("model"), "p", label)
             for name, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _model_metrics(models: dict, test: DataFrame, label: str) -> DataFrame:
    """Long table (model, metric, value) from one scoring pass and one ordering of all models' scores."""
    return rk.long_metrics(rk.metrics_of_scores(
        rk.cumulative_scores(_scores_of(models, test, label), "model", "p", label)))


def stub_models(t: Tables) -> DataFrame:
    """Two fixed arithmetic scores of the churn rows, as two models."""
    lab = churn_labels_of(t)
    scores = F.array(F.struct(F.lit("risk").alias("model"), ch.stub_risk_score(lab).alias("p")),
                     F.struct(F.lit("tenure").alias("model"),
                              F.round(F.lit(1.0) / (1 + F.col("tenure_days_at_cutoff") / F.lit(365.0)), 3).alias("p")))
    return lab.select("churned", F.inline(scores))


@query("model_comparison_stub")
def q_model_comparison_stub(spark, sf_dir):
    """AUC, average precision, log-loss and Brier of two scores from one table."""
    m = rk.metrics_of_scores(rk.cumulative_scores(stub_models(Tables(spark, sf_dir)), "model", "p", "churned"))
    return m.select("model", *[R(c, 9).alias(c) for c in rk.METRICS], "n")


CURVE_POINTS = 20
SUPPORT_ACCURACY = 200


@query("curves_thinned_stub")
def q_curves_thinned_stub(spark, sf_dir):
    """ROC and precision-recall points of two scores, thinned to CURVE_POINTS steps."""
    cum = rk.cumulative_scores(stub_models(Tables(spark, sf_dir)), "model", "p", "churned")
    return rk.curves_of_scores(cum, CURVE_POINTS)


# fitted models by (source state, parameters, name): the queries of one
# session share a fit as long as the source tables stay as they are
_FITS: dict = {}
MODELS = ("Logistic Regression", "Gradient Boosting")
FIT_SPLIT_BYTES = 16 * 1024 * 1024


def fitted(t: Tables, name: str, make: Callable):
    key = (source_key(t.spark, t.sf_dir), t.p, name)
    if key not in _FITS:
        _FITS[key] = make()
    return _FITS[key]


def pricing_split(t: Tables) -> DataFrame:
    return pr.time_split(priced_quotes(t), t.p.holdout_months)


def pricing_model(t: Tables, which: str):
    """The acceptance model, trained before the holdout months."""
    def make():
        train = (pricing_split(t).where("split = 'train'")
                 .select(*pr.NUM_FEATURES, *pr.CAT_FEATURES, "accepted").persist())
        try:
            # a row takes some ten bytes in the files, and hundreds as the vector every pass reads
            with small_splits(t.spark, FIT_SPLIT_BYTES):
                return pr.fit_response_model(train, which, t.p.gbt_iter, t.p.seed)
        finally:
            train.unpersist()
    return fitted(t, f"pricing {which}", make)


@query("pricing_model_metrics", rows_only=True)
def q_pricing_model_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    models = {which: pricing_model(t, which) for which in MODELS}
    return _model_metrics(models, pricing_split(t).where("split = 'test'"), "accepted")


@query("price_support_approx")
def q_price_support_approx(spark, sf_dir):
    """The support quantile from a mergeable summary, with its rank beside the exact one: per segment
    whether the share of quotes at or below it is within the stated error."""
    t = Tables(spark, sf_dir)
    q = t.quotes().select("segment", "price_ratio")
    return rk.quantile_rank_check(q, ["segment"], "price_ratio", [0.5, t.p.support_quantile], SUPPORT_ACCURACY)


@query("gbt_demand_curve", rows_only=True)
def q_gbt_demand_curve(spark, sf_dir):
    t = Tables(spark, sf_dir)
    q = priced_quotes(t)
    curves = pr.demand_curve(typical_of(t, q), pr.support_bound(q, t.p.support_quantile),
                             pr.model_scorer(pricing_model(t, "Gradient Boosting")),
                             t.p.grid_start, t.p.grid_step, t.p.grid_points)
    return pr.recommend_price(curves, q)


# ---- experiment ------------------------------------------------------------------

import datetime as _dt  # noqa: E402

from ratecard.operators import experiment as ex  # noqa: E402


def window_of(t: Tables):
    return t.p.as_of - _dt.timedelta(days=t.p.experiment_days), t.p.as_of


def sampled_of(t: Tables) -> DataFrame:
    """The accounts that take part, drawn once per session and source state."""
    return fitted(t, "ab sample", lambda: freeze(ex.sample_accounts(t.accounts(), t.p.sample_fraction, t.p.salt)))


def assigned_of(t: Tables) -> DataFrame:
    """Their arms, likewise: every analysis of the test reads the one assignment."""
    return fitted(t, "ab assignment", lambda: freeze(ex.assign_arms(sampled_of(t), t.p.salt)))


def experiment_of(t: Tables) -> DataFrame:
    """The quotes of the test's days with their arms, kept for the session."""
    start, end = window_of(t)
    return fitted(t, "experiment rows", lambda: freeze(ex.experiment_rows(
        t.quotes_once(start, end), assigned_of(t), start, end)))


@query("ab_sample")
def q_ab_sample(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return sampled_of(t).select("customer_id", "true_segment")


@query("ab_assignment")
def q_ab_assignment(spark, sf_dir):
    return assigned_of(Tables(spark, sf_dir)).select("customer_id", "true_segment", "arm")


@query("ab_balance")
def q_ab_balance(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ex.balance(assigned_of(t), t.p.as_of)


@query("ab_segment_mix")
def q_ab_segment_mix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ex.segment_mix(assigned_of(t), t.p.tier_order)


@query("ab_experiment_rows")
def q_ab_experiment_rows(spark, sf_dir):
    return experiment_of(Tables(spark, sf_dir))


@query("ab_arm_rollup")
def q_ab_arm_rollup(spark, sf_dir):
    e = experiment_of(Tables(spark, sf_dir))
    a = ex.arm_stats(ex.segment_arm_stats(e))
    return a.select("arm", F.col("n").alias("quotes"), (F.col("x") / F.col("n")).alias("accept_rate"),
                    (F.col("s1").cast("double") / F.col("n")).alias("rev_per_quote"))


@query("ab_ztest")
def q_ab_ztest(spark, sf_dir):
    z = ex.ztest(experiment_of(Tables(spark, sf_dir)))
    return z.select(*[R(c, 9).alias(c) if c == "accept_pval" else F.col(c) for c in z.columns])


@query("ab_welch")
def q_ab_welch(spark, sf_dir):
    w = ex.welch(experiment_of(Tables(spark, sf_dir)))
    return w.select("n_control", "n_treatment", "rev_control", "rev_treatment",
                    R("rev_t", 9).alias("rev_t"), R("rev_df", 6).alias("rev_df"))


@query("ab_welch_pvalue")
def q_ab_welch_pvalue(spark, sf_dir):
    w = ex.welch_pvalue(experiment_of(Tables(spark, sf_dir)))
    return w.select("n_control", "n_treatment", "rev_control", "rev_treatment", R("rev_t", 9).alias("rev_t"),
                    R("rev_df", 6).alias("rev_df"), R("rev_pval", 9).alias("rev_pval"))


@query("ab_error_bars")
def q_ab_error_bars(spark, sf_dir):
    e = ex.error_bars(experiment_of(Tables(spark, sf_dir)))
    return e.select("arm", "n", "accept_rate", R("accept_err", 12).alias("accept_err"),
                    "rev_per_quote", R("rev_err", 9).alias("rev_err"))


def effects_of(t: Tables) -> DataFrame:
    return ex.segment_effects(experiment_of(t), t.p.min_arm_rows)


@query("ab_segment_effects")
def q_ab_segment_effects(spark, sf_dir):
    e = effects_of(Tables(spark, sf_dir))
    return e.select(*[R(c, 9).alias(c) if c == "accept_pval" else F.col(c) for c in e.columns])


@query("ab_guardrail")
def q_ab_guardrail(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ex.guardrail(effects_of(t), t.p.guardrail_drop)


@query("ab_annual_impact")
def q_ab_annual_impact(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return ex.annual_impact(experiment_of(t), t.quotes())


@query("ab_sample_size")
def q_ab_sample_size(spark, sf_dir):
    t = Tables(spark, sf_dir)
    start, end = window_of(t)
    return ex.sample_size(t.quotes(), t.quotes(start, end),
                          t.p.baseline_mde, t.p.alpha, t.p.power)


@query("ab_summary")
def q_ab_summary(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = ex.summary(experiment_of(t), t.quotes(), t.p.guardrail_drop, t.p.min_arm_rows)
    return s.select(*[R(c, 9).alias(c) if c == "accept_pval"
                      else R(c, 9).alias(c) if c in ("rev_t", "rev_pval")
                      else R(c, 6).alias(c) if c == "rev_df" else F.col(c) for c in s.columns])


def stored_recommendations(t: Tables) -> DataFrame:
    """The newest complete version of the price recommendations; the first use in a session (and the
    first after a source file changed) computes and publishes one."""
    def make():
        root = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/recommendations-{uuid.uuid4().hex}"
        publish(stub_recommendation(t), root, RECOMMENDATION_SCHEMA)
        return root
    return read_newest(t.spark, fitted(t, "recommendations", make), RECOMMENDATION_SCHEMA)


@query("price_recommendation_stored")
def q_price_recommendation_stored(spark, sf_dir):
    """The recommendations as read back from the stored lookup."""
    return stored_recommendations(Tables(spark, sf_dir))


@query("ab_decision")
def q_ab_decision(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = ex.decisions(effects_of(t), stored_recommendations(t), t.p.guardrail_drop)
    return d.select("segment", "accept_diff", "decision", R("next_price_ratio", 9).alias("next_price_ratio"))


# ---- forecasting -----------------------------------------------------------------

from ratecard.operators import forecast as fc  # noqa: E402


def dense_of(t: Tables) -> DataFrame:
    """The gap-free monthly panel. Its size is segments x months -- fixed by
    the calendar, not by the quote volume -- so it is kept in one partition:
    the forecasting windows then run one task per stage instead of
    ``spark.sql.shuffle.partitions`` near-empty ones."""
    panel = fe.drop_open_month(monthly_of(t),
                               t.p.as_of)
    return fc.dense_panel(panel).repartition(1)


def panel_of(t: Tables) -> DataFrame:
    """The same panel, kept in memory for the session: every branch of every forecast reads it. It has
    segments x months rows, however many quotes there are."""
    return fitted(t, "panel", lambda: dense_of(t).persist())


def backtest_of(t: Tables, boosted: bool = False) -> DataFrame:
    """Holdout rows with actual, seasonal-naive, trend and recursive
    forecasts (of the arithmetic stand-in, or of the boosted model)."""
    dense = panel_of(t)
    cut = fc.holdout_start(dense, t.p.holdout_months)
    tidx = fc.with_time_index(dense)
    coefs = fc.fit_trend(tidx.where(F.col("month") < cut))
    test = tidx.where(F.col("month") >= cut)
    trend = fc.predict_trend(test, coefs).select("segment", "month", "revenue", "trend_forecast")
    step = forecast_model(t, dense, cut) if boosted else fc.stub_recursive_model
    rec = fc.recursive_forecast(dense, cut, t.p.holdout_months, step)
    bt = fc.seasonal_naive(dense, trend).join(rec, ["segment", "month"], "left")
    return bt.select("segment", "month", "revenue", "naive_forecast", "trend_forecast", "forecast")


def _r4(df: DataFrame, cols) -> DataFrame:
    return df.select(*[R(c, 4).alias(c) if c in cols else F.col(c) for c in df.columns])


_FC = ("trend_forecast", "forecast", "blended_forecast", "naive_forecast")


@query("lag_features")
def q_lag_features(spark, sf_dir):
    f = fc.lag_features(dense_of(Tables(spark, sf_dir)))
    return f.select(*[R(c, 12).alias(c) if c in ("month_sin", "month_cos") else F.col(c)
                      for c in f.columns])


@query("seasonal_naive")
def q_seasonal_naive(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dense = panel_of(t)
    test = dense.where(F.col("month") >= fc.holdout_start(dense, t.p.holdout_months))
    return fc.seasonal_naive(dense, test.select("segment", "month", "revenue"))


@query("trend_forecast")
def q_trend_forecast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dense = panel_of(t)
    cut = fc.holdout_start(dense, t.p.holdout_months)
    tidx = fc.with_time_index(dense)
    coefs = fc.fit_trend(tidx.where(F.col("month") < cut))
    out = fc.predict_trend(tidx.where(F.col("month") >= cut), coefs)
    return _r4(out.select("segment", "month", "time_idx", "revenue", "trend_forecast"), _FC)


@query("recursive_forecast_stub")
def q_recursive_forecast_stub(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dense = panel_of(t)
    out = fc.recursive_forecast(dense, fc.holdout_start(dense, t.p.holdout_months),
                                t.p.holdout_months, fc.stub_recursive_model)
    return _r4(out, _FC)


def metrics_of(bt: DataFrame) -> DataFrame:
    return fc.backtest_metrics(bt)


@query("backtest_metrics")
def q_backtest_metrics(spark, sf_dir):
    m = metrics_of(backtest_of(Tables(spark, sf_dir)))
    return m.select("segment", *[R(c, 9).alias(c) for c in
                                 ("naive_mape", "trend_seasonal_mape", "recursive_mape")],
                    "best_method")


@query("mape_by_method")
def q_mape_by_method(spark, sf_dir):
    """The error table turned long: a method is its column's name without the suffix."""
    m = metrics_of(backtest_of(Tables(spark, sf_dir)))
    cols = [c for c in m.columns if c.endswith("_mape")]
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mape")) for c in cols])
    return m.select("segment", F.inline(lines)).select(
        "segment", F.regexp_replace("column", "_mape$", "").alias("method"), R("mape", 9).alias("mape"))


@query("forecast_winner")
def q_forecast_winner(spark, sf_dir):
    return metrics_of(backtest_of(Tables(spark, sf_dir))).select("segment", "best_method")


@query("backtest_table")
def q_backtest_table(spark, sf_dir):
    bt = backtest_of(Tables(spark, sf_dir))
    return _r4(fc.blend(bt, metrics_of(bt)), _FC)


@query("backtest_macro")
def q_backtest_macro(spark, sf_dir):
    m = metrics_of(backtest_of(Tables(spark, sf_dir)))
    return m.agg(R(F.avg("naive_mape"), 9).alias("naive"),
                 R(F.avg("trend_seasonal_mape"), 9).alias("trend_seasonal"),
                 R(F.avg("recursive_mape"), 9).alias("recursive"),
                 R(F.avg(F.least("trend_seasonal_mape", "recursive_mape")), 9).alias("blended"))


@query("bottom_up_total")
def q_bottom_up_total(spark, sf_dir):
    bt = backtest_of(Tables(spark, sf_dir))
    b = fc.blend(bt, metrics_of(bt))
    return b.groupBy("month").agg(R(F.sum("revenue"), 4).alias("actual"),
                                  R(F.sum("blended_forecast"), 4).alias("blended_forecast"))


def forward_of(t: Tables, boosted: bool = False) -> DataFrame:
    """Refit on the full history, roll ``forecast_horizon`` months forward
    with both methods and keep each segment's backtest winner."""
    dense = panel_of(t)
    tidx = fc.with_time_index(dense)
    coefs = fc.fit_trend(tidx)
    last = tidx.groupBy("segment").agg(F.max("month").alias("_m"), F.max("time_idx").alias("_i"))
    fut = (last.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(t.p.forecast_horizon))))
           .select("segment", F.add_months("_m", F.col("_k")).alias("month"),
                   (F.col("_i") + F.col("_k")).alias("time_idx")))
    trend = fc.predict_trend(fut, coefs)
    step = forecast_model(t, dense) if boosted else fc.stub_recursive_model
    rec = fc.recursive_forecast(dense, None, t.p.forecast_horizon, step)
    fwd = rec.join(trend.select("segment", "month", "trend_forecast"), ["segment", "month"])
    winners = metrics_of(backtest_of(t, boosted)).select("segment", "best_method")
    return (fwd.join(winners, "segment", "left")
            .withColumn("blended_forecast",
                        F.when(F.col("best_method") == "trend_seasonal", F.col("trend_forecast"))
                        .otherwise(F.col("forecast")))
            .select("segment", "month", "forecast", "trend_forecast", "blended_forecast"))


@query("forward_trend")
def q_forward_trend(spark, sf_dir):
    return _r4(forward_of(Tables(spark, sf_dir)), _FC)


@query("forward_pivot")
def q_forward_pivot(spark, sf_dir):
    t = Tables(spark, sf_dir)
    f = forward_of(t)
    wide = (f.withColumn("segment", sg.listed("segment", t.p.tier_order)).groupBy("month")
            .pivot("segment", list(t.p.tier_order)).agg(F.first("blended_forecast")))
    return wide.select("month", *[R(F.col(f"`{s}`"), 4).alias(s) for s in t.p.tier_order])


def forecast_model(t: Tables, dense: DataFrame, cut=None):
    """The boosted forecaster, trained on the months before ``cut`` (None: on all)."""
    def make():
        train = fc.lag_features(dense)
        return fc.gbt_model(train if cut is None else train.where(F.col("month") < cut),
                            t.p.forecast_gbt_iter, t.p.seed)
    return fitted(t, f"forecast {'all' if cut is None else 'backtest'}", make)


@query("gbt_recursive_forecast", rows_only=True)
def q_gbt_recursive_forecast(spark, sf_dir):
    t = Tables(spark, sf_dir)
    dense = panel_of(t)
    cut = fc.holdout_start(dense, t.p.holdout_months)
    model = forecast_model(t, dense, cut)
    out = fc.recursive_forecast(dense, cut, t.p.holdout_months, model)
    return out.join(dense.select("segment", "month", "revenue"), ["segment", "month"], "left")


# ---- churn models (fitted: rows-only) ----------------------------------------

def churn_frame(t: Tables) -> DataFrame:
    def make():
        w = fe.churn_windows(t.p)
        labels = freeze(fe.churn_labels(t.accounts(), t.quotes_once(w["prior_start"], w["label_end"]), t.p))
        return freeze(ch.churn_model_frame(labels, t.p.salt, t.p.test_fraction))
    return fitted(t, "churn frame", make)


def churn_model(t: Tables, which: str):
    return fitted(t, f"churn {which}", lambda: ch.fit_churn_model(
        churn_frame(t).where("split = 'train'"), which, t.p.gbt_iter, t.p.seed))


@query("churn_model_metrics", rows_only=True)
def q_churn_model_metrics(spark, sf_dir):
    t = Tables(spark, sf_dir)
    models = {which: churn_model(t, which) for which in MODELS}
    return _model_metrics(models, churn_frame(t).where("split = 'test'"), "churned")


def churn_scored(t: Tables, out: str = "score") -> DataFrame:
    return ch.positive_probability(churn_model(t, "Gradient Boosting"), churn_frame(t), out)


@query("churn_risk_scores", rows_only=True)
def q_churn_risk_scores(spark, sf_dir):
    scored = churn_scored(Tables(spark, sf_dir), "risk_score")
    return scored.select("customer_id", "segment", "churned", "risk_score",
                         (F.col("split") == "train").alias("in_train"))


@query("churn_decile_lift_model", rows_only=True)
def q_churn_decile_lift_model(spark, sf_dir):
    test = churn_scored(Tables(spark, sf_dir)).where("split = 'test'")
    return rk.decile_lift(test.select("customer_id", "churned", "score"), "score", "churned", "customer_id")


def churn_importance(t: Tables) -> DataFrame:
    def make():
        test, model = churn_frame(t).where("split = 'test'"), churn_model(t, "Gradient Boosting")
        return freeze(ins.permutation_importance(
            ch.scorer(model), test, [*ch.NUM_FEATURES, *ch.CAT_FEATURES],
            "churned", ["customer_id"], seed=t.p.seed, model=model))
    return fitted(t, "churn importance", make)


@query("permutation_importance", rows_only=True)
def q_permutation_importance(spark, sf_dir):
    return churn_importance(Tables(spark, sf_dir))


@query("pricing_permutation_importance", rows_only=True)
def q_pricing_permutation_importance(spark, sf_dir):
    """The same for the boosted acceptance model; a quote is named by its order line."""
    t = Tables(spark, sf_dir)
    model = pricing_model(t, "Gradient Boosting")
    return ins.permutation_importance(
        ch.scorer(model),
        pr.time_split(pr.with_contract(t.quotes(), t.accounts()), t.p.holdout_months).where("split = 'test'"),
        [*pr.NUM_FEATURES, *pr.CAT_FEATURES], "accepted", ["l_orderkey", "l_linenumber"], seed=t.p.seed, model=model)


@query("partial_dependence", rows_only=True)
def q_partial_dependence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    imp = churn_importance(t).where(F.col("feature").isin(*ch.NUM_FEATURES))
    top = imp.orderBy(F.col("importance_mean").desc(), "feature").first()["feature"]  # M25: top-1
    return ins.partial_dependence(churn_model(t, "Gradient Boosting"), churn_frame(t).where("split = 'test'"),
                                  top, t.p.dependence_points)


# ---- certificates: the fits are optimal (checked against constants) --------------

@query("logistic_certificate")
def q_logistic_certificate(spark, sf_dir):
    """The penalised gradient of both logistic models, a row per coefficient."""
    t = Tables(spark, sf_dir)
    fits = (("churn", churn_model(t, "Logistic Regression"), churn_frame(t).where("split = 'train'"), "churned",
             ch.NUM_FEATURES, "class_weight"),
            ("pricing", pricing_model(t, "Logistic Regression"), pricing_split(t).where("split = 'train'"),
             "accepted", pr.NUM_FEATURES, None))
    parts = [ins.logistic_gradient(m, train, label, num, weight).withColumn("model", F.lit(name))
             for name, m, train, label, num, weight in fits]
    out = parts[0].unionByName(parts[1])
    # + 0.0 turns a negative zero into zero
    return out.select("model", "coefficient", (R("gradient", 5) + F.lit(0.0)).alias("gradient"))


@query("one_hot_features")
def q_one_hot_features(spark, sf_dir):
    """Every account's categories as the churn model's pipeline encodes them."""
    t = Tables(spark, sf_dir)
    return ins.hot_entries(churn_model(t, "Logistic Regression"), churn_frame(t), "customer_id")


@query("scoring_certificate")
def q_scoring_certificate(spark, sf_dir):
    """Rows scored by each churn model over the whole book, and by how much its probabilities differ
    from the same computed from coefficients or trees."""
    t = Tables(spark, sf_dir)
    parts = [ins.scoring_differences(churn_model(t, which), churn_frame(t)).withColumn("model", F.lit(which))
             for which in MODELS]
    out = parts[0].unionByName(parts[1])
    return out.select("model", "n_rows", R("difference", 9).alias("difference"))


@query("importance_of_stub")
def q_importance_of_stub(spark, sf_dir):
    """Permutation importance of the arithmetic churn score: which features move its AUC at all."""
    mf = ch.model_frame(churn_labels_of(Tables(spark, sf_dir))).withColumn("churned", F.col("churned").cast("int"))
    features = ["acceptance_rate_12m", "express_share_12m", "n_quotes_12m", "revenue_12m", "region"]
    rows = freeze(mf.select("customer_id", "churned", *features))
    imp = ins.permutation_importance(lambda df: df.withColumn("score", ch.stub_risk_score(df)), rows, features,
                                     "churned", ["customer_id"])
    moves = (F.abs("importance_mean") > 1e-9) | (F.col("importance_std") > 1e-9)
    return imp.select("feature", moves.alias("matters"))


@query("kmeans_certificate")
def q_kmeans_certificate(spark, sf_dir):
    t = Tables(spark, sf_dir)
    c = ins.kmeans_certificate(*kmeans_of(t))
    return c.select("cluster", "nearer_elsewhere", R("centre_gap", 6).alias("centre_gap"))


@query("pca_certificate")
def q_pca_certificate(spark, sf_dir):
    model, data = sg.pca_fit(rfm_of(Tables(spark, sf_dir)))
    c = ins.pca_certificate(model.pc.toArray(), [float(x) for x in model.explainedVariance], data)
    return c.select("component", R("residual", 9).alias("residual"), R("length", 9).alias("length"),
                    F.abs(R("product_with_next", 9)).alias("product_with_next"))


@query("boosting_certificate")
def q_boosting_certificate(spark, sf_dir):
    """Boosting rounds of both boosted classifiers, and in how many the training loss rose."""
    t = Tables(spark, sf_dir)
    fits = (("churn", churn_model(t, "Gradient Boosting"), churn_frame(t).where("split = 'train'"), "churned"),
            ("pricing", pricing_model(t, "Gradient Boosting"), pricing_split(t).where("split = 'train'"), "accepted"))
    rows = []
    for name, model, train, label in fits:
        losses = ins.boosting_losses(model, train, label)
        rows.append((name, len(losses), ins.loss_rises(losses), losses[-1] < losses[0]))
    return spark.createDataFrame(rows, "model string, rounds long, rises long, falls boolean")


@query("gbt_backtest_metrics", rows_only=True)
def q_gbt_backtest_metrics(spark, sf_dir):
    """Backtest with the boosted recursive forecaster as the second fitted
    candidate (trend+season vs boosted, naive reported as the floor)."""
    t = Tables(spark, sf_dir)
    dense = panel_of(t)
    cut = fc.holdout_start(dense, t.p.holdout_months)
    tidx = fc.with_time_index(dense)
    coefs = fc.fit_trend(tidx.where(F.col("month") < cut))
    trend = fc.predict_trend(tidx.where(F.col("month") >= cut), coefs).select(
        "segment", "month", "revenue", "trend_forecast")
    model = forecast_model(t, dense, cut)
    rec = fc.recursive_forecast(dense, cut, t.p.holdout_months, model)
    bt = fc.seasonal_naive(dense, trend).join(rec, ["segment", "month"], "left")
    m = fc.backtest_metrics(bt, ("trend_seasonal", "recursive"))
    return m.select("segment", "naive_mape", "trend_seasonal_mape",
                    F.col("recursive_mape").alias("gbm_recursive_mape"),
                    F.regexp_replace("best_method", "^recursive$", "gbm_recursive").alias("best_method"))


def _pricing_single_model(spark, sf_dir, which: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _model_metrics({which: pricing_model(t, which)}, pricing_split(t).where("split = 'test'"),
                          "accepted")


@query("logit_metrics", rows_only=True)
def q_logit_metrics(spark, sf_dir):
    """Held-out AUC, average precision, log-loss and Brier of the L2 logistic
    acceptance model (time split: last 6 months)."""
    return _pricing_single_model(spark, sf_dir, "Logistic Regression")


@query("gbt_metrics", rows_only=True)
def q_gbt_metrics(spark, sf_dir):
    """The same metrics for the boosted acceptance model."""
    return _pricing_single_model(spark, sf_dir, "Gradient Boosting")


@query("gbt_backtest_table", rows_only=True)
def q_gbt_backtest_table(spark, sf_dir):
    """Backtest with the boosted forecaster, blended by its own winners."""
    bt = backtest_of(Tables(spark, sf_dir), boosted=True)
    return _r4(fc.blend(bt, metrics_of(bt)), _FC)


@query("gbt_bottom_up_total", rows_only=True)
def q_gbt_bottom_up_total(spark, sf_dir):
    b = q_gbt_backtest_table(spark, sf_dir)
    return b.groupBy("month").agg(F.sum("revenue").alias("actual"),
                                  F.sum("blended_forecast").alias("blended_forecast"))


@query("gbt_forward", rows_only=True)
def q_gbt_forward(spark, sf_dir):
    """Forward forecast with the boosted model refitted on all history."""
    return _r4(forward_of(Tables(spark, sf_dir), boosted=True), _FC)


def _curve_tables(models: dict, test: DataFrame, label: str, table) -> DataFrame:
    """One table per fitted model, stacked under the model's name."""
    parts = [table(freeze(ch.positive_probability(m, test, "p").select(label, "p")))
             .withColumn("model", F.lit(name)) for name, m in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("churn_model_curves", rows_only=True)
def q_churn_model_curves(spark, sf_dir):
    """ROC and precision-recall points of both churn models."""
    t = Tables(spark, sf_dir)
    return _curve_tables({w: churn_model(t, w) for w in MODELS}, churn_frame(t).where("split = 'test'"),
                         "churned", lambda s: rk.threshold_points(s, "p", "churned"))


@query("pricing_model_curves", rows_only=True)
def q_pricing_model_curves(spark, sf_dir):
    """ROC and precision-recall points of both acceptance models."""
    t = Tables(spark, sf_dir)
    return _curve_tables({w: pricing_model(t, w) for w in MODELS}, pricing_split(t).where("split = 'test'"),
                         "accepted", lambda s: rk.threshold_points(s, "p", "accepted"))


@query("pricing_model_calibration", rows_only=True)
def q_pricing_model_calibration(spark, sf_dir):
    """Reliability table of both acceptance models."""
    t = Tables(spark, sf_dir)
    return _curve_tables({w: pricing_model(t, w) for w in MODELS}, pricing_split(t).where("split = 'test'"),
                         "accepted", lambda s: rk.calibration_bins(s, "p", "accepted"))
