"""Price-test design and analysis.

Unit of randomisation is the account. The analysis reads the observed
quotes of the test window once: one groupBy(segment, arm) with exact,
mergeable sums (n, accepted, sum revenue, sum revenue^2). Everything
else -- arm totals, z-test, Welch test, segment effects, guardrail,
summary -- is column arithmetic on that (segments x 2)-row table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratecard.functions.stats import t_two_sided_p, two_sided_normal_p, z_quantile
from ratecard.operators.churn import hash_key
from ratecard.operators.ranking import group_sequence, sequence_id, with_group_size
from ratecard.session import freeze

Z95 = 1.96  # fixed value: half-width multiplier of the reported 95% intervals


def sample_accounts(accounts: DataFrame, fraction: float, salt: str) -> DataFrame:
    """Reproducible sample: the first ceil(fraction * N) accounts in
    md5(salt||id) order (a global order computed without one task)."""
    keyed = accounts.withColumn("_h", hash_key("customer_id", salt + ":sample"))
    ranked = sequence_id(keyed, ["_h"], "_rk")
    n = ranked.agg(F.max("_rk")).scalar()
    return ranked.where(F.col("_rk") <= F.ceil(n * F.lit(fraction))).drop("_h", "_rk")


def assign_arms(accounts: DataFrame, salt: str, segment_col: str = "true_segment") -> DataFrame:
    """50/50 within each segment: the first floor(n/2) accounts in
    md5(salt||id) order are control (control gets the smaller half)."""
    keyed = accounts.withColumn("_h", hash_key("customer_id", salt))
    ranked = group_sequence(keyed, [segment_col], ["_h"], "_rn")
    return (with_group_size(ranked, [segment_col], "_rn", "_ns")
            .withColumn("arm", F.when(F.col("_rn") <= F.floor(F.col("_ns") / 2), "control")
                        .otherwise("treatment"))
            .drop("_h", "_rn", "_ns"))


def balance(assigned: DataFrame, as_of: dt.date) -> DataFrame:
    return assigned.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.datediff(F.lit(as_of), F.col("signup_date")).cast("double")).alias("avg_tenure_days"))


def experiment_rows(quotes: DataFrame, assigned: DataFrame, start: dt.date,
                    end: dt.date) -> DataFrame:
    """Observed quotes of assigned accounts inside [start, end)."""
    q = quotes.where((F.col("quote_date") >= F.lit(start)) & (F.col("quote_date") < F.lit(end)))
    return (q.join(assigned.select("customer_id", "arm"), "customer_id")
            .select("customer_id", "segment", "arm",
                    F.datediff(F.col("quote_date"), F.lit(start)).alias("day"),
                    "price_ratio", "quoted_price", "accepted",
                    F.when(F.col("accepted") == 1, F.col("quoted_price")).otherwise(F.lit(0.0))
                    .alias("revenue")))


def segment_arm_stats(exp: DataFrame) -> DataFrame:
    """The single pass over experiment rows: exact mergeable sums."""
    r = F.col("revenue").cast("decimal(18,2)")
    return exp.groupBy("segment", "arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("accepted").cast("long").alias("x"),
        F.sum(r).alias("s1"),
        F.sum(r * r).alias("s2"))


def arm_stats(seg_stats: DataFrame) -> DataFrame:
    return seg_stats.groupBy("arm").agg(F.sum("n").alias("n"), F.sum("x").alias("x"),
                                        F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def _wide(stats: DataFrame, keys) -> DataFrame:
    """One row per key with control (_c) and treatment (_t) sums."""
    def pick(c, arm):
        return F.max(F.when(F.col("arm") == arm, F.col(c)))
    grouped = stats.groupBy(*keys) if keys else stats.groupBy()
    return grouped.agg(*[pick(c, a).alias(f"{c}_{s}") for c in ("n", "x", "s1", "s2")
                         for a, s in (("control", "c"), ("treatment", "t"))])


def _mean(s1, n):
    return F.col(s1).cast("double") / F.col(n)


def _var(s1, s2, n):
    d1, d2, nn = F.col(s1).cast("double"), F.col(s2).cast("double"), F.col(n)
    return (d2 - d1 * d1 / nn) / (nn - 1)


def ztest_columns() -> list:
    """Two-proportion z-test: pooled SE for z, unpooled SE for the CI."""
    p1 = F.col("x_c") / F.col("n_c")
    p2 = F.col("x_t") / F.col("n_t")
    pbar = (F.col("x_c") + F.col("x_t")) / (F.col("n_c") + F.col("n_t"))
    se = F.sqrt(pbar * (1 - pbar) * (F.lit(1.0) / F.col("n_c") + F.lit(1.0) / F.col("n_t")))
    z = (p2 - p1) / se
    se_diff = F.sqrt(p1 * (1 - p1) / F.col("n_c") + p2 * (1 - p2) / F.col("n_t"))
    return [p1.alias("accept_control"), p2.alias("accept_treatment"),
            (p2 - p1).alias("accept_diff"), z.alias("z"),
            two_sided_normal_p(z).alias("accept_pval"),
            ((p2 - p1) - F.lit(Z95) * se_diff).alias("ci_low"),
            ((p2 - p1) + F.lit(Z95) * se_diff).alias("ci_high")]


def welch_columns() -> list:
    """Welch t statistic and Welch-Satterthwaite degrees of freedom for
    revenue per quote (treatment minus control)."""
    mc, mt = _mean("s1_c", "n_c"), _mean("s1_t", "n_t")
    vc = _var("s1_c", "s2_c", "n_c") / F.col("n_c")
    vt = _var("s1_t", "s2_t", "n_t") / F.col("n_t")
    t = (mt - mc) / F.sqrt(vt + vc)
    dfree = (vt + vc) * (vt + vc) / (vt * vt / (F.col("n_t") - 1) + vc * vc / (F.col("n_c") - 1))
    return [mc.alias("rev_control"), mt.alias("rev_treatment"), t.alias("rev_t"),
            dfree.alias("rev_df")]


def ztest(exp: DataFrame) -> DataFrame:
    w = _wide(arm_stats(segment_arm_stats(exp)), [])
    return w.select(F.col("n_c").alias("n_control"), F.col("n_t").alias("n_treatment"),
                    *ztest_columns())


def welch(exp: DataFrame) -> DataFrame:
    w = _wide(arm_stats(segment_arm_stats(exp)), [])
    return w.select(F.col("n_c").alias("n_control"), F.col("n_t").alias("n_treatment"),
                    *welch_columns())


def welch_pvalue(exp: DataFrame) -> DataFrame:
    """Adds the Student-t two-sided p-value (Arrow UDF on the one row)."""
    return welch(exp).withColumn("rev_pval", t_two_sided_p(F.col("rev_t"), F.col("rev_df")))


def error_bars(exp: DataFrame) -> DataFrame:
    a = arm_stats(segment_arm_stats(exp))
    p = F.col("x") / F.col("n")
    return a.select("arm", "n", p.alias("accept_rate"),
                    (F.lit(Z95) * F.sqrt(p * (1 - p) / F.col("n"))).alias("accept_err"),
                    _mean("s1", "n").alias("rev_per_quote"),
                    (F.lit(Z95) * F.sqrt(_var("s1", "s2", "n")) / F.sqrt(F.col("n")))
                    .alias("rev_err"))


def segment_effects(exp: DataFrame, min_rows: int = 5) -> DataFrame:
    """Per-segment effects from the same pass; segments with fewer than
    ``min_rows`` quotes in either arm are dropped."""
    return effects_of_stats(segment_arm_stats(exp), min_rows)


def effects_of_stats(stats: DataFrame, min_rows: int = 5) -> DataFrame:
    w = _wide(stats, ["segment"])
    w = w.where((F.col("n_c") >= min_rows) & (F.col("n_t") >= min_rows))
    zc = ztest_columns()
    mc, mt = _mean("s1_c", "n_c"), _mean("s1_t", "n_t")
    return w.select("segment", F.col("n_c").alias("n_control"), F.col("n_t").alias("n_treatment"),
                    zc[0], zc[1], zc[2], zc[4],
                    mc.alias("rev_control"), mt.alias("rev_treatment"),
                    (mt / F.nullif(mc, F.lit(0.0)) - 1).alias("rev_diff_pct"))


def guardrail(effects: DataFrame, drop: float = 0.03) -> DataFrame:
    """Breach = acceptance fell by more than ``drop`` (strict)."""
    return effects.select("segment", "accept_diff",
                          (F.col("accept_diff") < F.lit(-drop)).alias("breached"))


def annual_volume(quotes: DataFrame) -> F.Column:
    """Quotes in [max date - 1 year, max date] (scalar subquery)."""
    mx = quotes.agg(F.max("quote_date")).scalar()
    return quotes.where(F.col("quote_date") >= F.add_months(mx, -12)).agg(
        F.count(F.lit(1))).scalar()


def annual_impact(exp: DataFrame, quotes: DataFrame) -> DataFrame:
    w = _wide(arm_stats(segment_arm_stats(exp)), [])
    lift = _mean("s1_t", "n_t") - _mean("s1_c", "n_c")
    vol = annual_volume(quotes)
    return w.select(lift.alias("rev_lift_per_quote"), vol.alias("annual_quote_volume"),
                    (lift * vol).alias("projected_annual_impact"))


def sample_size(quotes: DataFrame, window_quotes: DataFrame, mde: float, alpha: float,
                power: float) -> DataFrame:
    """Quotes per arm needed to detect an absolute change ``mde`` from each
    segment's baseline acceptance, next to the quotes the window holds."""
    za, zb = z_quantile(1 - alpha / 2), z_quantile(power)
    base = quotes.groupBy("segment").agg((F.sum("accepted") / F.count(F.lit(1))).alias("baseline_rate"))
    avail = window_quotes.groupBy("segment").agg(F.count(F.lit(1)).alias("available_quotes"))
    p1 = F.col("baseline_rate")
    p2 = p1 + F.lit(mde)
    pbar = (p1 + p2) / 2
    root = (F.lit(za) * F.sqrt(F.lit(2.0) * pbar * (1 - pbar))
            + F.lit(zb) * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2)))
    n = root * root / F.lit(mde * mde)
    return (base.join(avail, "segment", "left")
            .select("segment", "baseline_rate", F.ceil(n).alias("n_needed_per_arm"),
                    F.coalesce(F.col("available_quotes"), F.lit(0)).alias("available_quotes")))


def summary(exp: DataFrame, quotes: DataFrame, drop: float, min_rows: int) -> DataFrame:
    """One-row experiment summary. The experiment rows are read once: their sums (two rows a tier)
    are written while the plan is built, and both parts of the summary start from them."""
    stats = freeze(segment_arm_stats(exp))
    w = _wide(arm_stats(stats), [])
    zc = {c: col for c, col in zip(("ac", "at", "ad", "z", "pv"), ztest_columns())}
    wc = welch_columns()
    breached = (effects_of_stats(stats, min_rows)
                .agg(F.max((F.col("accept_diff") < F.lit(-drop)).cast("int"))).scalar())
    vol = annual_volume(quotes)
    mc, mt = _mean("s1_c", "n_c"), _mean("s1_t", "n_t")
    out = w.select(zc["ac"], zc["at"], zc["pv"], *wc,
                   (mt / F.nullif(mc, F.lit(0.0)) - 1).alias("rel_revenue_lift"),
                   ((mt - mc) * vol).alias("projected_annual_impact"),
                   (F.coalesce(breached, F.lit(0)) == 1).alias("guardrail_breached"))
    return out.withColumn("rev_pval", t_two_sided_p(F.col("rev_t"), F.col("rev_df")))


def decisions(effects: DataFrame, recs: DataFrame, drop: float) -> DataFrame:
    """Ship where the guardrail holds; otherwise re-test at half the move."""
    # one row per tier on each side; AQE picks the strategy from runtime sizes
    j = effects.join(recs.select("segment", "current_avg_price_ratio",
                                 "recommended_price_ratio"), "segment")
    half = (F.col("current_avg_price_ratio")
            + (F.col("recommended_price_ratio") - F.col("current_avg_price_ratio")) / 2)
    ship = F.col("accept_diff") >= F.lit(-drop)
    return j.select("segment", "accept_diff",
                    F.when(ship, "ship").otherwise("retest_half_move").alias("decision"),
                    F.when(ship, F.col("recommended_price_ratio")).otherwise(half)
                    .alias("next_price_ratio"))


def segment_mix(assigned: DataFrame, tier_order, segment_col: str = "true_segment") -> DataFrame:
    """Share of each tier within each arm (row-normalised crosstab)."""
    from ratecard.operators.segments import crosstab, crosstab_row_pct
    return crosstab_row_pct(crosstab(assigned, "arm", segment_col, tier_order), "arm", tier_order)

