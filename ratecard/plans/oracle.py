"""Independent DuckDB SQL for every SQL-expressible registered query.

The driver registers the raw testdata tables as views; each statement
rebuilds the logical tables as CTEs and recomputes the result from scratch
with plain SQL. Nothing but the parameters is imported from the engine: the
table mapping and window dates are written out here, and p-values come from
numerical integration. Aliases equal the Spark columns.
"""

from __future__ import annotations

import datetime as _dt
import math as _math
from statistics import NormalDist

from ratecard.params import TESTDATA_PARAMS as P

ORACLE_SQL: dict[str, str] = {}

# ---- the logical tables -------------------------------------------------------

ACCOUNTS_SQL = """
accounts AS (
  SELECT c.c_custkey AS customer_id, c.c_mktsegment AS true_segment, f.signup_date,
         n.n_name AS industry, r.r_name AS region,
         CASE WHEN c.c_acctbal >= 5000 THEN 'Contract' ELSE 'Spot' END AS contract_type
  FROM customer c
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS signup_date
        FROM orders GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey
)"""

_SQL_RATIO = ("(1 - CAST(l.l_discount AS DECIMAL(4,2))) * (1 + CAST(l.l_tax AS DECIMAL(4,2)))")

QUOTES_SQL = f"""
quotes AS (
  SELECT o.o_custkey AS customer_id, c.c_mktsegment AS segment,
         CAST(o.o_orderdate AS DATE) AS quote_date, p.p_type AS mode,
         CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Express' ELSE 'Standard' END
           AS service_level,
         l.l_quantity AS weight_kg, CAST(p.p_size AS DOUBLE) AS distance_km,
         l.l_extendedprice AS competitor_price,
         CAST({_SQL_RATIO} AS DOUBLE) AS price_ratio,
         CAST(ROUND(CAST(l.l_extendedprice AS DECIMAL(15,2)) * {_SQL_RATIO}, 2) AS DOUBLE)
           AS quoted_price,
         CASE WHEN l.l_returnflag <> 'R' THEN 1 ELSE 0 END AS accepted
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN part p ON p.p_partkey = l.l_partkey
)"""


def D(d) -> str:
    return f"DATE '{d.isoformat()}'"


def rnd(x: str, n: int) -> str:
    """Half-up rounding on the shortest decimal form of a double -- the
    rounding rule of Spark's ``round`` (DuckDB's own rounds the binary value)."""
    return f"CAST(ROUND(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38,18)), {n}) AS DOUBLE)"


def dsum(x: str, scale: int = 4) -> str:
    return f"CAST(SUM(CAST(({x}) AS DECIMAL(18,{scale}))) AS DOUBLE)"


def dbl(x: str) -> str:
    return f"CAST(({x}) AS DOUBLE)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


BASE = (ACCOUNTS_SQL, QUOTES_SQL)
# The churn windows of the snapshot date 2001-08-02.
W = {"prior_start": _dt.date(1999, 8, 2), "early_end": _dt.date(1999, 11, 2),
     "late_start": _dt.date(2000, 5, 2), "cutoff": _dt.date(2000, 8, 2),
     "label_end": _dt.date(2001, 2, 2)}
OPEN_MONTH = P.as_of.replace(day=1)

MONTHLY_CTE = f"""
monthly AS (
  SELECT CAST(date_trunc('month', quote_date) AS DATE) AS month, segment,
         {dsum('quoted_price', 2)} AS revenue, COUNT(*) AS shipments
  FROM quotes WHERE accepted = 1
  {"AND quote_date >= " + D(P.panel_start) if P.panel_start else ""}
  GROUP BY 1, 2
)"""

PANEL_CTE = f"""
panel AS (
  SELECT * FROM monthly
  WHERE NOT ((SELECT MAX(month) FROM monthly) = {D(OPEN_MONTH)}
             AND month = (SELECT MAX(month) FROM monthly))
)"""

CHURN_CTE = f"""
churn_agg AS (
  SELECT customer_id,
    COUNT(*) FILTER (WHERE quote_date >= {D(W['prior_start'])} AND quote_date < {D(W['cutoff'])})
      AS n_quotes_12m,
    CAST(SUM(accepted) FILTER (WHERE quote_date >= {D(W['prior_start'])}
                               AND quote_date < {D(W['cutoff'])}) AS BIGINT) AS n_accepted_12m,
    CAST(SUM(CAST(price_ratio AS DECIMAL(18,4))) FILTER (WHERE quote_date >= {D(W['prior_start'])}
         AND quote_date < {D(W['cutoff'])}) AS DOUBLE) AS ratio_sum,
    CAST(SUM(CAST(quoted_price AS DECIMAL(18,2))) FILTER (WHERE quote_date >= {D(W['prior_start'])}
         AND quote_date < {D(W['cutoff'])} AND accepted = 1) AS DOUBLE) AS rev,
    COUNT(*) FILTER (WHERE quote_date >= {D(W['prior_start'])} AND quote_date < {D(W['cutoff'])}
                     AND service_level = 'Express') AS n_express,
    CAST(SUM(CAST(price_ratio AS DECIMAL(18,4))) FILTER (WHERE quote_date >= {D(W['prior_start'])}
         AND quote_date < {D(W['early_end'])}) AS DOUBLE) AS early_sum,
    COUNT(*) FILTER (WHERE quote_date >= {D(W['prior_start'])} AND quote_date < {D(W['early_end'])})
      AS early_n,
    CAST(SUM(CAST(price_ratio AS DECIMAL(18,4))) FILTER (WHERE quote_date >= {D(W['late_start'])}
         AND quote_date < {D(W['cutoff'])}) AS DOUBLE) AS late_sum,
    COUNT(*) FILTER (WHERE quote_date >= {D(W['late_start'])} AND quote_date < {D(W['cutoff'])})
      AS late_n,
    SUM(accepted) FILTER (WHERE quote_date >= {D(W['cutoff'])} AND quote_date < {D(W['label_end'])})
      AS label_acc
  FROM quotes
  WHERE quote_date >= {D(W['prior_start'])} AND quote_date < {D(W['label_end'])}
  GROUP BY customer_id
),
churn AS (
  SELECT a.customer_id, a.true_segment, a.signup_date, a.industry, a.region, a.contract_type,
    CAST(date_diff('day', a.signup_date, {D(W['cutoff'])}) AS INTEGER) AS tenure_days_at_cutoff,
    g.n_quotes_12m, g.n_accepted_12m,
    g.ratio_sum / CAST(g.n_quotes_12m AS DOUBLE) AS avg_price_ratio_12m,
    COALESCE(g.rev, 0.0) AS revenue_12m,
    CAST(g.n_express AS DOUBLE) / CAST(g.n_quotes_12m AS DOUBLE) AS express_share_12m,
    CAST(g.n_accepted_12m AS DOUBLE) / CAST(g.n_quotes_12m AS DOUBLE) AS acceptance_rate_12m,
    g.late_sum / CAST(NULLIF(g.late_n, 0) AS DOUBLE)
      - g.early_sum / CAST(NULLIF(g.early_n, 0) AS DOUBLE) AS price_ratio_trend,
    CASE WHEN COALESCE(g.label_acc, 0) = 0 THEN 1 ELSE 0 END AS churned
  FROM accounts a JOIN churn_agg g ON a.customer_id = g.customer_id
  WHERE date_diff('day', a.signup_date, {D(W['cutoff'])}) >= {P.min_tenure_days}
    AND COALESCE(g.n_accepted_12m, 0) >= {P.min_prior_accepted}
)"""

RFM_CTE = f"""
rfm_agg AS (
  SELECT customer_id, COUNT(*) AS frequency, SUM(accepted) AS n_acc,
    {dsum('price_ratio')} AS ratio_sum,
    COUNT(*) FILTER (WHERE service_level = 'Express') AS n_express,
    {dsum('weight_kg', 1)} AS w_sum, {dsum('distance_km', 1)} AS d_sum,
    MAX(quote_date) AS last_quote,
    CAST(SUM(CAST(quoted_price AS DECIMAL(18,2))) FILTER (WHERE accepted = 1) AS DOUBLE) AS monetary
  FROM quotes GROUP BY customer_id
),
rfm_base AS (
  SELECT a.customer_id, a.true_segment, a.signup_date, a.industry, a.region, a.contract_type,
    CAST(date_diff('day', g.last_quote, {D(P.as_of)}) AS INTEGER) AS recency_days,
    g.frequency, COALESCE(g.monetary, 0.0) AS monetary,
    CAST(g.n_acc AS DOUBLE) / g.frequency AS acceptance_rate,
    g.ratio_sum / g.frequency AS avg_price_ratio,
    CAST(g.n_express AS DOUBLE) / g.frequency AS express_share,
    g.w_sum / g.frequency AS avg_weight_kg, g.d_sum / g.frequency AS avg_distance_km,
    GREATEST(CAST(date_diff('day', a.signup_date, {D(P.as_of)}) AS DOUBLE) / CAST(365.25 AS DOUBLE),
             CAST(0.08 AS DOUBLE)) AS tenure_years
  FROM accounts a JOIN rfm_agg g ON a.customer_id = g.customer_id
),
rfm AS (
  SELECT *, frequency / tenure_years AS frequency_per_year,
         monetary / tenure_years AS monetary_per_year,
         ln(1 + frequency / tenure_years) AS log_frequency,
         ln(1 + monetary / tenure_years) AS log_monetary,
         ln(1 + CAST(recency_days AS DOUBLE)) AS log_recency
  FROM rfm_base
)"""


# ---- panel ------------------------------------------------------------------

ORACLE_SQL["monthly_revenue"] = with_(*BASE, MONTHLY_CTE) + "\nSELECT * FROM monthly"
ORACLE_SQL["open_month_dropped"] = with_(*BASE, MONTHLY_CTE, PANEL_CTE) + "\nSELECT * FROM panel"

ORACLE_SQL["holdout_month_labels"] = with_(*BASE, MONTHLY_CTE, PANEL_CTE) + f"""
SELECT DISTINCT strftime(month, '%Y-%m') AS label, month FROM panel
WHERE month > (SELECT MAX(month) FROM panel) - INTERVAL {P.holdout_months} MONTH"""

ORACLE_SQL["accounts_from_csv"] = with_(*BASE) + "\nSELECT * FROM accounts"

# ---- churn labels / RFM / KPIs ---------------------------------------------

ORACLE_SQL["churn_labels"] = with_(*BASE, CHURN_CTE) + "\nSELECT * FROM churn"

_tiers = ", ".join(f"'{t}'" for t in P.tier_order)
ORACLE_SQL["churn_rate_by_segment"] = with_(*BASE, CHURN_CTE) + f"""
SELECT true_segment AS segment, COUNT(*) AS n_accounts, CAST(SUM(churned) AS BIGINT) AS churners,
       CAST(SUM(churned) AS DOUBLE) / COUNT(*) AS churn_rate,
       CAST(list_position([{_tiers}], true_segment) AS INTEGER) AS tier_rank
FROM churn GROUP BY true_segment"""

_rfm_r9 = ("frequency_per_year", "monetary_per_year", "log_frequency", "log_monetary",
           "log_recency", "tenure_years")
_rfm_cols = ["customer_id", "true_segment", "signup_date", "industry", "region", "contract_type",
             "recency_days", "frequency", "monetary", "acceptance_rate", "avg_price_ratio",
             "express_share", "avg_weight_kg", "avg_distance_km", "tenure_years",
             "frequency_per_year", "monetary_per_year", "log_frequency", "log_monetary",
             "log_recency"]
ORACLE_SQL["rfm_features"] = with_(*BASE, RFM_CTE) + "\nSELECT " + ", ".join(
    f"{rnd(c, 9)} AS {c}" if c in _rfm_r9 else c for c in _rfm_cols) + " FROM rfm"

_summ = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {rnd(f'AVG(CAST({c} AS DOUBLE))', 6)} AS mean, "
    f"{rnd(f'STDDEV_SAMP(CAST({c} AS DOUBLE))', 6)} AS std, "
    f"{rnd(f'MIN(CAST({c} AS DOUBLE))', 9)} AS min, {rnd(f'MAX(CAST({c} AS DOUBLE))', 9)} AS max "
    f"FROM rfm"
    for c in ("recency_days", "frequency_per_year", "monetary_per_year", "acceptance_rate",
              "avg_price_ratio", "express_share"))
ORACLE_SQL["rfm_summary"] = with_(*BASE, RFM_CTE) + "\n" + _summ

ORACLE_SQL["overview_kpis"] = with_(*BASE, CHURN_CTE) + f"""
SELECT (SELECT COUNT(*) FROM accounts) AS n_accounts,
       COUNT(*) AS n_quotes, CAST(SUM(accepted) AS BIGINT) AS n_accepted,
       CAST(SUM(CAST(quoted_price AS DECIMAL(18,2))) FILTER (WHERE accepted = 1) AS DOUBLE)
         AS accepted_revenue,
       CAST(SUM(accepted) AS DOUBLE) / COUNT(*) AS acceptance_rate,
       (SELECT COUNT(*) FROM churn) AS churn_eligible_accounts,
       (SELECT CAST(SUM(churned) AS BIGINT) FROM churn) AS churned_accounts,
       (SELECT CAST(SUM(churned) AS DOUBLE) / COUNT(*) FROM churn) AS churn_rate_6m
FROM quotes"""


# ---- segmentation (rule clusters) ------------------------------------------

RULE_CTE = f"""
rc AS (
  SELECT *, CAST((CASE WHEN acceptance_rate >= CAST({2 / 3!r} AS DOUBLE) THEN 1 ELSE 0 END) * 2
               + (CASE WHEN express_share >= CAST(0.4 AS DOUBLE) THEN 1 ELSE 0 END) AS INTEGER)
           AS cluster
  FROM rfm
)"""

_ct = ", ".join(f"COUNT(*) FILTER (WHERE true_segment = '{t}') AS {t}" for t in P.tier_order)
ORACLE_SQL["tier_crosstab"] = with_(*BASE, RFM_CTE, RULE_CTE) + f"""
SELECT cluster, {_ct} FROM rc GROUP BY cluster"""

_pct = ", ".join(f"CAST(COUNT(*) FILTER (WHERE true_segment = '{t}') AS DOUBLE) / COUNT(*) AS {t}"
                 for t in P.tier_order)
ORACLE_SQL["tier_crosstab_pct"] = with_(*BASE, RFM_CTE, RULE_CTE) + f"""
SELECT cluster, {_pct} FROM rc GROUP BY cluster"""

ORACLE_SQL["adjusted_rand_index"] = with_(*BASE, RFM_CTE, RULE_CTE) + """,
cont AS (SELECT cluster, true_segment, COUNT(*) AS n FROM rc GROUP BY cluster, true_segment),
s AS (
  SELECT CAST(SUM(n * (n - 1) // 2) AS DOUBLE) AS ij, CAST(SUM(n) AS DOUBLE) AS nn,
    (SELECT CAST(SUM(m * (m - 1) // 2) AS DOUBLE)
       FROM (SELECT SUM(n) AS m FROM cont GROUP BY cluster)) AS a,
    (SELECT CAST(SUM(m * (m - 1) // 2) AS DOUBLE)
       FROM (SELECT SUM(n) AS m FROM cont GROUP BY true_segment)) AS b
  FROM cont
),
e AS (SELECT ij, nn, a * b / (nn * (nn - 1) / 2) AS expected, (a + b) / 2 AS mx FROM s)
SELECT CASE WHEN mx = expected THEN 1.0 ELSE (ij - expected) / (mx - expected) END AS ari,
       CAST(nn AS BIGINT) AS n
FROM e"""

_prof_cols = ("recency_days", "frequency_per_year", "monetary_per_year", "acceptance_rate",
              "avg_price_ratio", "express_share", "avg_weight_kg", "avg_distance_km",
              "tenure_years")
PROFILE_CTE = f"""
prof AS (
  SELECT cluster, {", ".join(f"AVG(CAST({c} AS DOUBLE)) AS {c}" for c in _prof_cols)},
         COUNT(*) AS n_customers
  FROM rc GROUP BY cluster
),
dom AS (
  SELECT cluster, true_segment AS dominant_tier FROM (
    SELECT cluster, true_segment, ROW_NUMBER() OVER (
      PARTITION BY cluster ORDER BY COUNT(*) DESC, list_position([{_tiers}], true_segment)) AS r
    FROM rc GROUP BY cluster, true_segment) WHERE r = 1
),
ranked AS (
  SELECT p.*, d.dominant_tier,
         ROW_NUMBER() OVER (ORDER BY {rnd('p.monetary_per_year', 2)} DESC, p.cluster) AS rk,
         COUNT(*) OVER () AS k
  FROM prof p JOIN dom d ON p.cluster = d.cluster
),
w0 AS (SELECT *, {rnd('acceptance_rate', 2)} AS acc2 FROM ranked),
w1 AS (SELECT *, MIN(CASE WHEN rk > 1 AND rk < k THEN acc2 END) OVER () AS wacc
       FROM w0),
w2 AS (SELECT *, MIN(CASE WHEN rk > 1 AND rk < k AND acc2 = wacc THEN rk END)
                   OVER () AS fw FROM w1),
named AS (
  SELECT *, CASE WHEN rk = k THEN 'Low-Engagement / Occasional'
                 WHEN rk = 1 THEN 'High-Value Core'
                 WHEN rk = fw THEN 'Price-Sensitive / At-Risk'
                 ELSE 'Steady Mid-Value' END AS cluster_name
  FROM w2
)"""

ORACLE_SQL["cluster_profile_names"] = with_(*BASE, RFM_CTE, RULE_CTE, PROFILE_CTE) + f"""
SELECT cluster, {", ".join(f"{rnd(c, 6)} AS {c}" for c in _prof_cols)},
       n_customers, dominant_tier, cluster_name
FROM named"""

ORACLE_SQL["misfiled_accounts"] = with_(*BASE, RFM_CTE, RULE_CTE, PROFILE_CTE) + """
SELECT r.true_segment, n.cluster_name, COUNT(*) AS n_accounts
FROM rc r JOIN named n ON r.cluster = n.cluster
WHERE r.true_segment <> n.dominant_tier
GROUP BY r.true_segment, n.cluster_name"""

ORACLE_SQL["misfiled_share"] = with_(*BASE, RFM_CTE, RULE_CTE, PROFILE_CTE) + """
SELECT COUNT(*) AS n_accounts,
       CAST(COUNT(*) FILTER (WHERE r.true_segment <> n.dominant_tier) AS BIGINT) AS n_misfiled,
       CAST(COUNT(*) FILTER (WHERE r.true_segment <> n.dominant_tier) AS DOUBLE) / COUNT(*) AS share
FROM rc r JOIN named n ON r.cluster = n.cluster"""
ORACLE_SQL["misfiled_top10"] = ORACLE_SQL["misfiled_accounts"] + """
ORDER BY n_accounts DESC, r.true_segment, n.cluster_name LIMIT 10"""

_seg_features = ("log_recency", "log_frequency", "log_monetary", "acceptance_rate", "avg_price_ratio",
                 "express_share")
ORACLE_SQL["silhouette_rule_clusters"] = with_(*BASE, RFM_CTE, RULE_CTE) + f""",
z AS (SELECT customer_id, cluster, {", ".join(
    f"(CAST({c} AS DOUBLE) - AVG(CAST({c} AS DOUBLE)) OVER ()) / STDDEV_POP(CAST({c} AS DOUBLE)) OVER () AS {c}"
    for c in _seg_features)} FROM rc),
size AS (SELECT cluster, COUNT(*) AS n FROM z GROUP BY cluster),
d AS (SELECT a.customer_id, a.cluster, b.cluster AS other,
             SUM(SQRT({" + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in _seg_features)})) AS total
      FROM z a, z b GROUP BY 1, 2, 3),
m AS (SELECT d.customer_id, d.cluster,
             MAX(CASE WHEN other = d.cluster THEN total / greatest(n - 1, 1) END) AS own,
             MAX(CASE WHEN other = d.cluster THEN n END) AS n,
             MIN(CASE WHEN other <> d.cluster THEN total / n END) AS nearest
      FROM d JOIN size s ON s.cluster = d.other GROUP BY 1, 2),
s AS (SELECT cluster, CASE WHEN n = 1 THEN 0 ELSE (nearest - own) / greatest(nearest, own) END AS s FROM m)
SELECT CAST(cluster AS BIGINT) AS cluster, COUNT(*) AS n, {rnd('AVG(s)', 9)} AS silhouette
FROM s GROUP BY GROUPING SETS ((cluster), ())"""

# ---- ranking metrics on the fixed arithmetic churn score -------------------

SCORED_CTE = f"""
scored AS (
  SELECT customer_id, churned,
         {rnd("CAST(0.9 AS DOUBLE) - CAST(0.6 AS DOUBLE) * acceptance_rate_12m"
              " + CAST(0.2 AS DOUBLE) * express_share_12m", 3)} AS score
  FROM churn
),
sc AS (SELECT score, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM scored GROUP BY score)"""

ORACLE_SQL["roc_auc"] = with_(*BASE, CHURN_CTE, SCORED_CTE) + """,
cum AS (SELECT *, SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                  - neg AS neg_below FROM sc)
SELECT CAST(SUM(pos * (2 * neg_below + neg)) AS DOUBLE)
         / (CAST(2.0 AS DOUBLE) * CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS roc_auc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
FROM cum"""

DESC_CTE = """
dc AS (
  SELECT score, pos, neg,
    SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
  FROM sc
)"""

ORACLE_SQL["average_precision"] = with_(*BASE, CHURN_CTE, SCORED_CTE, DESC_CTE) + f"""
SELECT {rnd("SUM(CAST(pos * tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(SUM(pos) AS DOUBLE)", 12)}
       AS average_precision
FROM dc"""

_tot = ("(SELECT CAST(SUM(pos) AS DOUBLE) FROM sc)", "(SELECT CAST(SUM(neg) AS DOUBLE) FROM sc)")
ORACLE_SQL["roc_points"] = with_(*BASE, CHURN_CTE, SCORED_CTE, DESC_CTE) + f"""
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(tp AS DOUBLE) / {_tot[0]} AS tpr, CAST(fp AS DOUBLE) / {_tot[1]} AS fpr
FROM dc"""

ORACLE_SQL["pr_points"] = with_(*BASE, CHURN_CTE, SCORED_CTE, DESC_CTE) + f"""
SELECT score AS threshold, CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision,
       CAST(tp AS DOUBLE) / {_tot[0]} AS recall
FROM dc"""

ORACLE_SQL["roc_curve"] = with_(*BASE, CHURN_CTE, SCORED_CTE, DESC_CTE) + f"""
SELECT CAST(tp AS DOUBLE) / {_tot[0]} AS tpr, CAST(fp AS DOUBLE) / {_tot[1]} AS fpr FROM dc
UNION ALL SELECT 0.0, 0.0"""
ORACLE_SQL["pr_curve"] = with_(*BASE, CHURN_CTE, SCORED_CTE, DESC_CTE) + f"""
SELECT CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision, CAST(tp AS DOUBLE) / {_tot[0]} AS recall
FROM dc UNION ALL SELECT 1.0, 0.0"""

# two arithmetic scores of the churn rows as two models, in one table
MODELS_CTE = f"""
two AS (
  SELECT 'risk' AS model, churned, score AS p FROM scored
  UNION ALL
  SELECT 'tenure', churned, {rnd("CAST(1 AS DOUBLE) / (1 + tenure_days_at_cutoff / CAST(365 AS DOUBLE))", 3)}
  FROM churn
),
mf AS (SELECT model, p, SUM(churned) AS pos, SUM(1 - churned) AS neg FROM two GROUP BY model, p),
mc AS (
  SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
         SUM(pos) OVER (PARTITION BY model) AS np, SUM(neg) OVER (PARTITION BY model) AS nn
  FROM mf WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""
_clip = ("least(greatest(p, CAST(2.220446049250313e-16 AS DOUBLE)), "
         "CAST(1 AS DOUBLE) - CAST(2.220446049250313e-16 AS DOUBLE))")
ORACLE_SQL["model_comparison_stub"] = with_(*BASE, CHURN_CTE, SCORED_CTE, MODELS_CTE) + f"""
SELECT model, {rnd("CAST(SUM(pos * (2 * (nn - fp) + neg)) AS DOUBLE) / (2 * CAST(MAX(np) AS DOUBLE) * MAX(nn))", 9)}
         AS roc_auc,
       {rnd("SUM(CAST(pos * tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(MAX(np) AS DOUBLE)", 9)}
         AS average_precision,
       {rnd(f"SUM(-(pos * ln({_clip}) + neg * ln(1 - {_clip}))) / CAST(SUM(pos + neg) AS DOUBLE)", 9)} AS log_loss,
       {rnd("SUM(pos * (1 - p) * (1 - p) + neg * p * p) / CAST(SUM(pos + neg) AS DOUBLE)", 9)} AS brier,
       CAST(SUM(pos + neg) AS BIGINT) AS n
FROM mc GROUP BY model"""
ORACLE_SQL["curves_thinned_stub"] = with_(*BASE, CHURN_CTE, SCORED_CTE, MODELS_CTE) + """
SELECT model, p AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(tp AS DOUBLE) / CAST(np AS DOUBLE) AS tpr, CAST(fp AS DOUBLE) / CAST(nn AS DOUBLE) AS fpr,
       CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) AS precision, CAST(tp AS DOUBLE) / CAST(np AS DOUBLE) AS recall
FROM mc
WHERE tp + fp = pos + neg
   OR floor(CAST((tp + fp) * 20 AS DOUBLE) / (np + nn)) > floor(CAST((tp + fp - pos - neg) * 20 AS DOUBLE) / (np + nn))"""

ORACLE_SQL["decile_lift"] = with_(*BASE, CHURN_CTE, SCORED_CTE) + """,
r AS (SELECT churned, ROW_NUMBER() OVER (ORDER BY score, customer_id) AS rn, COUNT(*) OVER () AS n
      FROM scored),
d AS (SELECT CAST(11 - GREATEST(1, CEIL((rn - 1) * 10 / GREATEST(n - 1, 1))) AS INTEGER) AS decile,
             churned FROM r),
per AS (SELECT decile, COUNT(*) AS n, CAST(SUM(churned) AS BIGINT) AS churners FROM d GROUP BY decile)
SELECT decile, n, churners, CAST(churners AS DOUBLE) / n AS churn_rate,
       CAST(SUM(churners) OVER (ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS BIGINT) AS cum_churners,
       CAST(SUM(churners) OVER (ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS DOUBLE) / CAST(SUM(churners) OVER () AS DOUBLE) AS cum_capture_rate
FROM per"""

SPLIT_CTE = f"""
split AS (
  SELECT customer_id, churned,
    CASE WHEN ROW_NUMBER() OVER (PARTITION BY churned
                                 ORDER BY md5('{P.salt}' || CAST(customer_id AS VARCHAR)))
              <= CEIL(COUNT(*) OVER (PARTITION BY churned) * {P.test_fraction!r})
         THEN 'test' ELSE 'train' END AS split
  FROM churn
)"""
ORACLE_SQL["stratified_split"] = with_(*BASE, CHURN_CTE, SPLIT_CTE) + "\nSELECT * FROM split"
ORACLE_SQL["stratified_split_counts"] = with_(*BASE, CHURN_CTE, SPLIT_CTE) + """
SELECT split, churned, COUNT(*) AS n FROM split GROUP BY split, churned"""

ORACLE_SQL["median_imputed"] = with_(*BASE, CHURN_CTE) + f"""
SELECT customer_id,
  {rnd("COALESCE(price_ratio_trend, (SELECT quantile_cont(price_ratio_trend, 0.5) FROM churn))", 12)}
    AS price_ratio_trend_imputed,
  CASE WHEN price_ratio_trend IS NULL THEN 1 ELSE 0 END AS trend_missing
FROM churn"""

ORACLE_SQL["class_weights"] = with_(*BASE, CHURN_CTE) + """
SELECT churned, COUNT(*) AS n,
  CAST((SELECT COUNT(*) FROM churn) AS DOUBLE)
    / CAST((SELECT COUNT(DISTINCT churned) FROM churn) * COUNT(*) AS DOUBLE) AS weight
FROM churn GROUP BY churned"""

_zc = ("tenure_days_at_cutoff", "n_quotes_12m", "n_accepted_12m", "acceptance_rate_12m",
       "avg_price_ratio_12m", "revenue_12m", "express_share_12m")
ORACLE_SQL["zscore_features"] = with_(*BASE, CHURN_CTE) + "\nSELECT customer_id, " + ", ".join(
    f"{rnd(f'(CAST({c} AS DOUBLE) - AVG(CAST({c} AS DOUBLE)) OVER ()) / STDDEV_POP(CAST({c} AS DOUBLE)) OVER ()', 9)} AS z_{c}"
    for c in _zc) + " FROM churn"

ORACLE_SQL["quote_sequence"] = """
SELECT ROW_NUMBER() OVER (ORDER BY o.o_custkey, CAST(o.o_orderdate AS DATE), l.l_orderkey,
         l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
         l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus, l.l_shipdate) AS quote_id,
       o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS quote_date,
       l.l_orderkey, l.l_linenumber
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey"""

ORACLE_SQL["sorted_quotes_rank"] = ORACLE_SQL["quote_sequence"]
ORACLE_SQL["sorted_quotes_overlaps"] = with_(*BASE) + """
SELECT COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS n_overlaps FROM quotes"""


# ---- pricing ------------------------------------------------------------------

QC_CTE = f"""
qc AS (SELECT q.*, a.contract_type FROM quotes q LEFT JOIN accounts a ON q.customer_id = a.customer_id),
cut AS (SELECT CAST(MAX(quote_date) - INTERVAL {P.holdout_months} MONTH AS DATE) AS cutoff FROM quotes)"""

ORACLE_SQL["time_split_counts"] = with_(*BASE, QC_CTE) + """
SELECT CASE WHEN quote_date < (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split,
       (SELECT cutoff FROM cut) AS cutoff, COUNT(*) AS n_quotes,
       CAST(SUM(accepted) AS BIGINT) AS n_accepted,
       CAST(SUM(accepted) AS DOUBLE) / COUNT(*) AS acceptance_rate
FROM quotes GROUP BY 1, 2"""

SUPPORT_CTE = f"""
support AS (SELECT segment, quantile_cont(price_ratio, {P.support_quantile!r}) AS support_upper
            FROM quotes GROUP BY segment)"""

ORACLE_SQL["price_support_p97"] = with_(*BASE, SUPPORT_CTE) + f"""
SELECT segment, {rnd('support_upper', 10)} AS support_upper FROM support"""

ORACLE_SQL["price_support_approx"] = with_(*BASE) + f"""
SELECT segment, COUNT(*) AS n, q, TRUE AS rank_in_bound
FROM quotes, (VALUES (CAST(0.5 AS DOUBLE)), (CAST({P.support_quantile!r} AS DOUBLE))) v(q)
WHERE price_ratio IS NOT NULL GROUP BY segment, q"""

_mode_sql = lambda c: f"""
m_{c} AS (SELECT segment, v AS "{c}" FROM (
  SELECT segment, "{c}" AS v, ROW_NUMBER() OVER (PARTITION BY segment ORDER BY COUNT(*) DESC, "{c}") AS r
  FROM trows GROUP BY segment, "{c}") WHERE r = 1)"""  # noqa: E731

TYPICAL_CTE = f"""
trows AS (
  SELECT * FROM qc WHERE quote_date >= (SELECT cutoff FROM cut)
  UNION ALL
  SELECT * FROM qc WHERE quote_date < (SELECT cutoff FROM cut)
    AND segment NOT IN (SELECT DISTINCT segment FROM qc WHERE quote_date >= (SELECT cutoff FROM cut))
),
med AS (SELECT segment,
  {rnd('quantile_cont(weight_kg, 0.5)', 6)} AS weight_kg,
  {rnd('quantile_cont(distance_km, 0.5)', 6)} AS distance_km,
  {rnd('quantile_cont(competitor_price, 0.5)', 6)} AS competitor_price
  FROM trows GROUP BY segment),
{_mode_sql('mode').strip()},
{_mode_sql('service_level').strip()},
{_mode_sql('contract_type').strip()},
typical AS (
  SELECT med.*, m_mode."mode", m_service_level.service_level, m_contract_type.contract_type
  FROM med JOIN m_mode ON med.segment = m_mode.segment
  JOIN m_service_level ON med.segment = m_service_level.segment
  JOIN m_contract_type ON med.segment = m_contract_type.segment
)"""

ORACLE_SQL["typical_shipment"] = with_(*BASE, QC_CTE, TYPICAL_CTE) + "\nSELECT * FROM typical"

_z = ("CAST(2.0 AS DOUBLE) - CAST(8.0 AS DOUBLE) * (price_ratio - CAST(1.0 AS DOUBLE))"
      " + CAST(0.4 AS DOUBLE) * CAST(service_level = 'Express' AS DOUBLE)")
CURVE_CTE = f"""
grid0 AS (SELECT t.*, unnest(range(0, {P.grid_points})) AS i FROM typical t),
grid AS (
  SELECT * EXCLUDE (i),
         {rnd('CAST(0.7 AS DOUBLE) + CAST(i AS INTEGER) * CAST(0.01 AS DOUBLE)', 2)} AS price_ratio
  FROM grid0
),
curve AS (
  SELECT grid.segment, price_ratio,
    {rnd(f'CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({_z})))', 6)} AS pred_accept_prob,
    price_ratio * competitor_price AS quoted_price, s.support_upper
  FROM grid JOIN support s ON grid.segment = s.segment
),
curves AS (
  SELECT segment, price_ratio, pred_accept_prob, quoted_price,
         quoted_price * pred_accept_prob AS expected_revenue,
         price_ratio <= support_upper AS well_supported
  FROM curve
)"""

ORACLE_SQL["demand_curve_stub"] = with_(*BASE, QC_CTE, TYPICAL_CTE, SUPPORT_CTE, CURVE_CTE) + """
SELECT * FROM curves"""

ORACLE_SQL["demand_curve_tail"] = with_(*BASE, QC_CTE, TYPICAL_CTE, SUPPORT_CTE, CURVE_CTE) + """,
lim AS (SELECT segment, MAX(price_ratio) FILTER (WHERE well_supported) AS edge,
               COUNT(*) FILTER (WHERE NOT well_supported) AS beyond FROM curves GROUP BY segment)
SELECT c.segment, c.price_ratio, c.expected_revenue, c.well_supported AS is_edge
FROM curves c JOIN lim l ON c.segment = l.segment
WHERE NOT c.well_supported OR (l.beyond > 0 AND c.price_ratio = l.edge)"""

RECO_CTE = f"""
best AS (
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY segment
                             ORDER BY expected_revenue DESC, price_ratio) AS r
                 FROM curves WHERE well_supported) WHERE r = 1
),
edge AS (SELECT segment, MAX(price_ratio) AS edge FROM curves WHERE well_supported GROUP BY segment),
cur AS (SELECT segment, {dsum('price_ratio')} / COUNT(price_ratio) AS cur FROM quotes GROUP BY segment),
reco AS (
  SELECT b.segment, {rnd('c.cur', 3)} AS current_avg_price_ratio,
    {rnd('b.price_ratio', 3)} AS recommended_price_ratio,
    {rnd('b.pred_accept_prob', 3)} AS recommended_accept_prob,
    {rnd('b.expected_revenue', 2)} AS expected_revenue_at_recommendation,
    abs(b.price_ratio - e.edge) <= CAST(1e-08 AS DOUBLE) + CAST(1e-05 AS DOUBLE) * abs(e.edge)
      AS optimum_still_rising_at_data_edge
  FROM best b JOIN edge e ON b.segment = e.segment JOIN cur c ON b.segment = c.segment
)"""

ORACLE_SQL["price_recommendation_stub"] = with_(
    *BASE, QC_CTE, TYPICAL_CTE, SUPPORT_CTE, CURVE_CTE, RECO_CTE) + """
SELECT *, recommended_price_ratio / current_avg_price_ratio - 1 AS implied_price_move FROM reco"""

STUB_TEST_CTE = f"""
stest AS (
  SELECT accepted, {rnd(f'CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({_z})))', 6)} AS p
  FROM quotes WHERE quote_date >= (SELECT cutoff FROM cut)
)"""

_eps = 2.220446049250313e-16
ORACLE_SQL["price_recommendation_stored"] = ORACLE_SQL["price_recommendation_stub"]

ORACLE_SQL["log_loss_brier"] = with_(*BASE, QC_CTE, STUB_TEST_CTE) + f"""
SELECT {rnd(f'AVG(-(CAST(accepted AS DOUBLE) * ln(LEAST(GREATEST(p, {_eps!r}), {1 - _eps!r}))'
            f' + (1.0 - CAST(accepted AS DOUBLE)) * ln(1.0 - LEAST(GREATEST(p, {_eps!r}), {1 - _eps!r}))))', 9)}
         AS log_loss,
       {rnd('AVG((p - CAST(accepted AS DOUBLE)) * (p - CAST(accepted AS DOUBLE)))', 9)} AS brier,
       COUNT(*) AS n
FROM stest"""

ORACLE_SQL["calibration_bins"] = with_(*BASE, QC_CTE, STUB_TEST_CTE) + f"""
, edges AS (SELECT quantile_cont(p, [{", ".join(repr(i / 10) for i in range(1, 10))}]) AS e FROM stest)
SELECT CAST(len(list_filter((SELECT e FROM edges), lambda x: x < p)) AS INTEGER) AS bin, COUNT(*) AS n,
       {rnd('AVG(p)', 9)} AS mean_predicted,
       {rnd('AVG(CAST(accepted AS DOUBLE))', 9)} AS fraction_positive
FROM stest GROUP BY 1"""

# ---- experiment ------------------------------------------------------------------

_START = P.as_of - _dt.timedelta(days=P.experiment_days)

EXP_CTE = f"""
samp AS (
  SELECT * FROM (
    SELECT a.*, ROW_NUMBER() OVER (ORDER BY md5('{P.salt}:sample' || CAST(customer_id AS VARCHAR))) AS rk,
           COUNT(*) OVER () AS n_all
    FROM accounts a)
  WHERE rk <= CEIL(n_all * CAST(0.6 AS DOUBLE))
),
asg AS (
  SELECT customer_id, true_segment, signup_date,
    CASE WHEN ROW_NUMBER() OVER (PARTITION BY true_segment
                                 ORDER BY md5('{P.salt}' || CAST(customer_id AS VARCHAR)))
              <= FLOOR(COUNT(*) OVER (PARTITION BY true_segment) / 2)
         THEN 'control' ELSE 'treatment' END AS arm
  FROM samp
),
exp AS (
  SELECT q.customer_id, q.segment, a.arm,
         CAST(date_diff('day', {D(_START)}, q.quote_date) AS INTEGER) AS day,
         q.price_ratio, q.quoted_price, q.accepted,
         CASE WHEN q.accepted = 1 THEN q.quoted_price ELSE 0.0 END AS revenue
  FROM quotes q JOIN asg a ON q.customer_id = a.customer_id
  WHERE q.quote_date >= {D(_START)} AND q.quote_date < {D(P.as_of)}
),
sas AS (
  SELECT segment, arm, COUNT(*) AS n, CAST(SUM(accepted) AS BIGINT) AS x,
         SUM(CAST(revenue AS DECIMAL(18,2))) AS s1,
         SUM(CAST(revenue AS DECIMAL(18,2)) * CAST(revenue AS DECIMAL(18,2))) AS s2
  FROM exp GROUP BY segment, arm
),
arms AS (SELECT arm, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(x) AS BIGINT) AS x,
                SUM(s1) AS s1, SUM(s2) AS s2 FROM sas GROUP BY arm),
wide AS (
  SELECT MAX(CASE WHEN arm = 'control' THEN n END) AS n_c, MAX(CASE WHEN arm = 'treatment' THEN n END) AS n_t,
         MAX(CASE WHEN arm = 'control' THEN x END) AS x_c, MAX(CASE WHEN arm = 'treatment' THEN x END) AS x_t,
         MAX(CASE WHEN arm = 'control' THEN s1 END) AS s1_c, MAX(CASE WHEN arm = 'treatment' THEN s1 END) AS s1_t,
         MAX(CASE WHEN arm = 'control' THEN s2 END) AS s2_c, MAX(CASE WHEN arm = 'treatment' THEN s2 END) AS s2_t
  FROM arms
),
swide AS (
  SELECT segment,
         MAX(CASE WHEN arm = 'control' THEN n END) AS n_c, MAX(CASE WHEN arm = 'treatment' THEN n END) AS n_t,
         MAX(CASE WHEN arm = 'control' THEN x END) AS x_c, MAX(CASE WHEN arm = 'treatment' THEN x END) AS x_t,
         MAX(CASE WHEN arm = 'control' THEN s1 END) AS s1_c, MAX(CASE WHEN arm = 'treatment' THEN s1 END) AS s1_t,
         MAX(CASE WHEN arm = 'control' THEN s2 END) AS s2_c, MAX(CASE WHEN arm = 'treatment' THEN s2 END) AS s2_t
  FROM sas GROUP BY segment
)"""


def _two_sided_p(x: str, density: str) -> str:
    """1 - 2 * the integral of a symmetric density (of u) from 0 to |x|, by
    Simpson's rule with 2000 steps."""
    u = f"(abs({x}) * i / CAST(2000.0 AS DOUBLE))"
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return (f"(1 - 2 * (SELECT SUM({weight} * {density.replace('{u}', u)}) FROM range(0, 2001) AS g(i))"
            f" * abs({x}) / CAST(6000.0 AS DOUBLE))")


def _normal_p(z: str) -> str:
    return _two_sided_p(z, "(exp(-0.5 * {u} * {u}) / sqrt(2 * pi()))")


def _student_p(t: str, v: str) -> str:
    return _two_sided_p(t, f"(exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2)) / sqrt({v} * pi())"
                           f" * pow(1 + {{u}} * {{u}} / {v}, -({v} + 1) / 2))")


def _z_cols():
    p1 = "(CAST(x_c AS DOUBLE) / n_c)"
    p2 = "(CAST(x_t AS DOUBLE) / n_t)"
    pbar = "(CAST(x_c + x_t AS DOUBLE) / (n_c + n_t))"
    se = (f"sqrt({pbar} * (1 - {pbar}) * (CAST(1.0 AS DOUBLE) / n_c + CAST(1.0 AS DOUBLE) / n_t))")
    z = f"(({p2} - {p1}) / {se})"
    se_diff = f"sqrt({p1} * (1 - {p1}) / n_c + {p2} * (1 - {p2}) / n_t)"
    pval = _normal_p(z)
    return dict(accept_control=p1, accept_treatment=p2, accept_diff=f"({p2} - {p1})", z=z,
                accept_pval=rnd(pval, 9),
                ci_low=f"(({p2} - {p1}) - CAST(1.96 AS DOUBLE) * {se_diff})",
                ci_high=f"(({p2} - {p1}) + CAST(1.96 AS DOUBLE) * {se_diff})")


def _mean_sql(s1, n):
    return f"(CAST({s1} AS DOUBLE) / {n})"


def _var_sql(s1, s2, n):
    return (f"((CAST({s2} AS DOUBLE) - CAST({s1} AS DOUBLE) * CAST({s1} AS DOUBLE) / {n})"
            f" / ({n} - 1))")


def _welch_cols():
    mc, mt = _mean_sql("s1_c", "n_c"), _mean_sql("s1_t", "n_t")
    vc = f"({_var_sql('s1_c', 's2_c', 'n_c')} / n_c)"
    vt = f"({_var_sql('s1_t', 's2_t', 'n_t')} / n_t)"
    t = f"(({mt} - {mc}) / sqrt({vt} + {vc}))"
    dfree = f"(({vt} + {vc}) * ({vt} + {vc}) / ({vt} * {vt} / (n_t - 1) + {vc} * {vc} / (n_c - 1)))"
    return dict(rev_control=mc, rev_treatment=mt, rev_t=t, rev_df=dfree)


_ZC, _WC = _z_cols(), _welch_cols()

ORACLE_SQL["ab_sample"] = with_(*BASE, EXP_CTE) + "\nSELECT customer_id, true_segment FROM samp"
ORACLE_SQL["ab_assignment"] = with_(*BASE, EXP_CTE) + "\nSELECT customer_id, true_segment, arm FROM asg"
ORACLE_SQL["ab_balance"] = with_(*BASE, EXP_CTE) + f"""
SELECT arm, COUNT(*) AS n,
       AVG(CAST(date_diff('day', signup_date, {D(P.as_of)}) AS DOUBLE)) AS avg_tenure_days
FROM asg GROUP BY arm"""
ORACLE_SQL["ab_segment_mix"] = with_(*BASE, EXP_CTE) + f"""
SELECT arm, {", ".join(f"CAST(COUNT(*) FILTER (WHERE true_segment = '{t}') AS DOUBLE) / COUNT(*) AS {t}"
                       for t in P.tier_order)}
FROM asg GROUP BY arm"""
ORACLE_SQL["ab_experiment_rows"] = with_(*BASE, EXP_CTE) + "\nSELECT * FROM exp"
ORACLE_SQL["ab_arm_rollup"] = with_(*BASE, EXP_CTE) + """
SELECT arm, n AS quotes, CAST(x AS DOUBLE) / n AS accept_rate, CAST(s1 AS DOUBLE) / n AS rev_per_quote
FROM arms"""
ORACLE_SQL["ab_ztest"] = with_(*BASE, EXP_CTE) + "\nSELECT n_c AS n_control, n_t AS n_treatment, " + \
    ", ".join(f"{v} AS {k}" for k, v in _ZC.items()) + " FROM wide"
ORACLE_SQL["ab_welch"] = with_(*BASE, EXP_CTE) + f"""
SELECT n_c AS n_control, n_t AS n_treatment, {_WC['rev_control']} AS rev_control,
       {_WC['rev_treatment']} AS rev_treatment, {rnd(_WC['rev_t'], 9)} AS rev_t,
       {rnd(_WC['rev_df'], 6)} AS rev_df
FROM wide"""
ORACLE_SQL["ab_welch_pvalue"] = with_(*BASE, EXP_CTE) + f"""
SELECT n_c AS n_control, n_t AS n_treatment, {_WC['rev_control']} AS rev_control,
       {_WC['rev_treatment']} AS rev_treatment, {rnd(_WC['rev_t'], 9)} AS rev_t,
       {rnd(_WC['rev_df'], 6)} AS rev_df, {rnd(_student_p(_WC['rev_t'], _WC['rev_df']), 9)} AS rev_pval
FROM wide"""
ORACLE_SQL["ab_error_bars"] = with_(*BASE, EXP_CTE) + f"""
SELECT arm, n, CAST(x AS DOUBLE) / n AS accept_rate,
       {rnd('CAST(1.96 AS DOUBLE) * sqrt((CAST(x AS DOUBLE) / n) * (1 - CAST(x AS DOUBLE) / n) / n)', 12)}
         AS accept_err,
       CAST(s1 AS DOUBLE) / n AS rev_per_quote,
       {rnd(f"CAST(1.96 AS DOUBLE) * sqrt({_var_sql('s1', 's2', 'n')}) / sqrt(n)", 9)} AS rev_err
FROM arms"""

EFFECTS_CTE = f"""
effects AS (
  SELECT segment, n_c AS n_control, n_t AS n_treatment,
    {_ZC['accept_control']} AS accept_control, {_ZC['accept_treatment']} AS accept_treatment,
    {_ZC['accept_diff']} AS accept_diff, {_ZC['accept_pval']} AS accept_pval,
    {_mean_sql('s1_c', 'n_c')} AS rev_control, {_mean_sql('s1_t', 'n_t')} AS rev_treatment,
    {_mean_sql('s1_t', 'n_t')} / NULLIF({_mean_sql('s1_c', 'n_c')}, 0) - 1 AS rev_diff_pct
  FROM swide WHERE n_c >= {P.min_arm_rows} AND n_t >= {P.min_arm_rows}
)"""
ORACLE_SQL["ab_segment_effects"] = with_(*BASE, EXP_CTE, EFFECTS_CTE) + "\nSELECT * FROM effects"
ORACLE_SQL["ab_guardrail"] = with_(*BASE, EXP_CTE, EFFECTS_CTE) + f"""
SELECT segment, accept_diff, accept_diff < CAST({-P.guardrail_drop!r} AS DOUBLE) AS breached FROM effects"""

VOLUME_SQL = ("(SELECT COUNT(*) FROM quotes WHERE quote_date >= "
              "CAST((SELECT MAX(quote_date) FROM quotes) - INTERVAL 12 MONTH AS DATE))")
_lift = f"({_mean_sql('s1_t', 'n_t')} - {_mean_sql('s1_c', 'n_c')})"
ORACLE_SQL["ab_annual_impact"] = with_(*BASE, EXP_CTE) + f"""
SELECT {_lift} AS rev_lift_per_quote, {VOLUME_SQL} AS annual_quote_volume,
       {_lift} * {VOLUME_SQL} AS projected_annual_impact
FROM wide"""

_za, _zb = repr(NormalDist().inv_cdf(1 - P.alpha / 2)), repr(NormalDist().inv_cdf(P.power))
_p1 = "baseline_rate"
_p2 = f"(baseline_rate + CAST({P.baseline_mde!r} AS DOUBLE))"
_pbar = f"(({_p1} + {_p2}) / 2)"
_root = (f"(CAST({_za} AS DOUBLE) * sqrt(CAST(2.0 AS DOUBLE) * {_pbar} * (1 - {_pbar}))"
         f" + CAST({_zb} AS DOUBLE) * sqrt({_p1} * (1 - {_p1}) + {_p2} * (1 - {_p2})))")
ORACLE_SQL["ab_sample_size"] = with_(*BASE) + f""",
base AS (SELECT segment, CAST(SUM(accepted) AS DOUBLE) / COUNT(*) AS baseline_rate
         FROM quotes GROUP BY segment),
avail AS (SELECT segment, COUNT(*) AS available_quotes FROM quotes
          WHERE quote_date >= {D(_START)} AND quote_date < {D(P.as_of)} GROUP BY segment)
SELECT b.segment, baseline_rate,
       CAST(CEIL({_root} * {_root} / CAST({P.baseline_mde * P.baseline_mde!r} AS DOUBLE)) AS BIGINT)
         AS n_needed_per_arm,
       COALESCE(available_quotes, 0) AS available_quotes
FROM base b LEFT JOIN avail a ON b.segment = a.segment"""

ORACLE_SQL["ab_summary"] = with_(*BASE, EXP_CTE, EFFECTS_CTE) + f"""
SELECT {_ZC['accept_control']} AS accept_control, {_ZC['accept_treatment']} AS accept_treatment,
       {_ZC['accept_pval']} AS accept_pval,
       {_WC['rev_control']} AS rev_control, {_WC['rev_treatment']} AS rev_treatment,
       {rnd(_WC['rev_t'], 9)} AS rev_t, {rnd(_WC['rev_df'], 6)} AS rev_df,
       {rnd(_student_p(_WC['rev_t'], _WC['rev_df']), 9)} AS rev_pval,
       {_mean_sql('s1_t', 'n_t')} / NULLIF({_mean_sql('s1_c', 'n_c')}, 0) - 1 AS rel_revenue_lift,
       {_lift} * {VOLUME_SQL} AS projected_annual_impact,
       COALESCE((SELECT MAX(CASE WHEN accept_diff < CAST({-P.guardrail_drop!r} AS DOUBLE) THEN 1 ELSE 0 END)
                 FROM effects), 0) = 1 AS guardrail_breached
FROM wide"""

ORACLE_SQL["ab_decision"] = with_(*BASE, QC_CTE, TYPICAL_CTE, SUPPORT_CTE, CURVE_CTE, RECO_CTE,
                                  EXP_CTE, EFFECTS_CTE) + f"""
SELECT e.segment, e.accept_diff,
  CASE WHEN e.accept_diff >= CAST({-P.guardrail_drop!r} AS DOUBLE) THEN 'ship' ELSE 'retest_half_move' END
    AS decision,
  {rnd(f"CASE WHEN e.accept_diff >= CAST({-P.guardrail_drop!r} AS DOUBLE) THEN r.recommended_price_ratio "
       "ELSE r.current_avg_price_ratio + (r.recommended_price_ratio - r.current_avg_price_ratio) / 2 END", 9)}
    AS next_price_ratio
FROM effects e JOIN reco r ON e.segment = r.segment"""


# ---- forecasting -----------------------------------------------------------------

_H = P.holdout_months
_ANGLE = f"CAST({2 * _math.pi!r} AS DOUBLE) * CAST(month(month) AS DOUBLE) / CAST(12.0 AS DOUBLE)"

DENSE_CTE = """
dense AS (
  SELECT m.segment, m.month, COALESCE(p.revenue, 0.0) AS revenue,
         CAST(COALESCE(p.shipments, 0) AS BIGINT) AS shipments
  FROM (SELECT segment, CAST(unnest(generate_series((SELECT MIN(month) FROM panel),
                                                    (SELECT MAX(month) FROM panel),
                                                    INTERVAL 1 MONTH)) AS DATE) AS month
        FROM (SELECT DISTINCT segment FROM panel)) m
  LEFT JOIN panel p ON p.segment = m.segment AND p.month = m.month
),
tidx AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY segment ORDER BY month) - 1 AS INTEGER)
                   AS time_idx FROM dense),
cutm AS (SELECT CAST((SELECT MAX(month) FROM dense) - INTERVAL """ + str(_H - 1) + """ MONTH AS DATE)
                AS cutoff)"""

FORECAST_BASE = (*BASE, MONTHLY_CTE, PANEL_CTE, DENSE_CTE)


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes)


_lagsel = ", ".join(f"LAG(revenue, {k}) OVER (PARTITION BY segment ORDER BY month) AS lag{k}"
                    for k in range(1, 13))
ORACLE_SQL["lag_features"] = with_(*FORECAST_BASE) + f""",
l AS (SELECT *, {_lagsel} FROM tidx)
SELECT segment, month, time_idx, {rnd(f'sin({_ANGLE})', 12)} AS month_sin,
       {rnd(f'cos({_ANGLE})', 12)} AS month_cos, lag1, lag2, lag3, lag6, lag12,
       (lag1 + lag2 + lag3) / CAST(3.0 AS DOUBLE) AS roll3,
       (lag1 + lag2 + lag3 + lag4 + lag5 + lag6) / CAST(6.0 AS DOUBLE) AS roll6,
       revenue AS target
FROM l WHERE time_idx >= 12"""

ORACLE_SQL["seasonal_naive"] = with_(*FORECAST_BASE) + """
SELECT d.segment, d.month, d.revenue, n.revenue AS naive_forecast
FROM dense d LEFT JOIN dense n
  ON n.segment = d.segment AND CAST(n.month + INTERVAL 12 MONTH AS DATE) = d.month
WHERE d.month >= (SELECT cutoff FROM cutm)"""


def _solve3_sql(a11, a12, a13, a22, a23, a33, b1, b2, b3):
    det = (f"({a11} * ({a22} * {a33} - {a23} * {a23}) - {a12} * ({a12} * {a33} - {a23} * {a13})"
           f" + {a13} * ({a12} * {a23} - {a22} * {a13}))")
    d1 = (f"({b1} * ({a22} * {a33} - {a23} * {a23}) - {a12} * ({b2} * {a33} - {a23} * {b3})"
          f" + {a13} * ({b2} * {a23} - {a22} * {b3}))")
    d2 = (f"({a11} * ({b2} * {a33} - {a23} * {b3}) - {b1} * ({a12} * {a33} - {a23} * {a13})"
          f" + {a13} * ({a12} * {b3} - {b2} * {a13}))")
    d3 = (f"({a11} * ({a22} * {b3} - {b2} * {a23}) - {a12} * ({a12} * {b3} - {b2} * {a13})"
          f" + {b1} * ({a12} * {a23} - {a22} * {a13}))")
    return f"{d1} / {det}", f"{d2} / {det}", f"{d3} / {det}"


def trend_ctes(train_filter: str, name: str) -> str:
    bt, bs, bc = _solve3_sql("tt", "ts", "tc", "ss", "sc", "cc", "ty", "sy", "cy")
    return f"""
{name}_x AS (SELECT segment, CAST(time_idx AS DOUBLE) AS t, sin({_ANGLE}) AS s, cos({_ANGLE}) AS c,
                    revenue AS y FROM tidx WHERE {train_filter}),
{name}_m AS (SELECT segment, AVG(t) AS m_t, AVG(s) AS m_s, AVG(c) AS m_c, AVG(y) AS m_y
             FROM {name}_x GROUP BY segment),
{name}_c AS (SELECT x.segment, t - m_t AS t, s - m_s AS s, c - m_c AS c, y - m_y AS y
             FROM {name}_x x JOIN {name}_m m ON x.segment = m.segment),
{name}_s AS (SELECT SUM(t * t) AS tt, SUM(t * s) AS ts, SUM(t * c) AS tc, SUM(s * s) AS ss,
                    SUM(s * c) AS sc, SUM(c * c) AS cc, SUM(t * y) AS ty, SUM(s * y) AS sy,
                    SUM(c * y) AS cy FROM {name}_c),
{name}_b AS (SELECT {bt} AS b_t, {bs} AS b_s, {bc} AS b_c FROM {name}_s),
{name} AS (
  SELECT segment, m_y - (SELECT b_t FROM {name}_b) * m_t - (SELECT b_s FROM {name}_b) * m_s
                      - (SELECT b_c FROM {name}_b) * m_c AS alpha,
         (SELECT b_t FROM {name}_b) AS b_t, (SELECT b_s FROM {name}_b) AS b_s,
         (SELECT b_c FROM {name}_b) AS b_c
  FROM {name}_m)"""


TREND_BT = trend_ctes("month < (SELECT cutoff FROM cutm)", "coef")
_ANGLE_R = _ANGLE.replace("month(month)", "month(r.month)")
_pred = (f"(k.alpha + k.b_t * CAST(r.time_idx AS DOUBLE) + k.b_s * sin({_ANGLE_R})"
         f" + k.b_c * cos({_ANGLE_R}))")

ORACLE_SQL["trend_forecast"] = with_(*FORECAST_BASE, TREND_BT) + f"""
SELECT r.segment, r.month, r.time_idx, r.revenue, {rnd(_pred, 4)} AS trend_forecast
FROM tidx r JOIN coef k ON r.segment = k.segment
WHERE r.month >= (SELECT cutoff FROM cutm)"""


def rec_cte(first_month_sql: str, steps: int, name: str = "rec") -> str:
    return f"""
{name}(segment, h, month, pred) AS (
  SELECT d1.segment, 0, CAST(d1.month + INTERVAL 1 MONTH AS DATE),
         CAST(0.6 AS DOUBLE) * d1.revenue + CAST(0.4 AS DOUBLE) * d12.revenue
  FROM dense d1 JOIN dense d12
    ON d12.segment = d1.segment AND d12.month = CAST(d1.month - INTERVAL 11 MONTH AS DATE)
  WHERE d1.month = CAST(({first_month_sql}) - INTERVAL 1 MONTH AS DATE)
  UNION ALL
  SELECT r.segment, r.h + 1, CAST(r.month + INTERVAL 1 MONTH AS DATE),
         CAST(0.6 AS DOUBLE) * r.pred + CAST(0.4 AS DOUBLE) * d.revenue
  FROM {name} r JOIN dense d
    ON d.segment = r.segment AND d.month = CAST(r.month - INTERVAL 11 MONTH AS DATE)
  WHERE r.h < {steps - 1}
)"""


REC_BT = rec_cte("SELECT cutoff FROM cutm", _H)
ORACLE_SQL["recursive_forecast_stub"] = with_rec(*FORECAST_BASE, REC_BT) + f"""
SELECT segment, month, {rnd('pred', 4)} AS forecast FROM rec"""

BACKTEST_CTE = f"""
bt AS (
  SELECT r.segment, r.month, r.revenue, n.revenue AS naive_forecast, {_pred} AS trend_forecast,
         c.pred AS forecast
  FROM tidx r JOIN coef k ON r.segment = k.segment
  LEFT JOIN dense n ON n.segment = r.segment AND CAST(n.month + INTERVAL 12 MONTH AS DATE) = r.month
  LEFT JOIN rec c ON c.segment = r.segment AND c.month = r.month
  WHERE r.month >= (SELECT cutoff FROM cutm)
),
mets AS (
  SELECT segment,
    AVG(abs(revenue - naive_forecast) / GREATEST(abs(revenue), CAST(2.220446049250313e-16 AS DOUBLE))) AS naive_mape,
    AVG(abs(revenue - trend_forecast) / GREATEST(abs(revenue), CAST(2.220446049250313e-16 AS DOUBLE))) AS trend_seasonal_mape,
    AVG(abs(revenue - forecast) / GREATEST(abs(revenue), CAST(2.220446049250313e-16 AS DOUBLE))) AS recursive_mape
  FROM bt WHERE naive_forecast IS NOT NULL AND trend_forecast IS NOT NULL GROUP BY segment
),
win AS (SELECT *, CASE WHEN trend_seasonal_mape <= recursive_mape THEN 'trend_seasonal'
                       ELSE 'recursive' END AS best_method FROM mets),
blended AS (
  SELECT bt.*, CASE WHEN w.best_method = 'trend_seasonal' THEN bt.trend_forecast ELSE bt.forecast END
           AS blended_forecast
  FROM bt LEFT JOIN win w ON bt.segment = w.segment
)"""

_BT = with_rec(*FORECAST_BASE, TREND_BT, REC_BT, BACKTEST_CTE)

ORACLE_SQL["backtest_metrics"] = _BT + f"""
SELECT segment, {rnd('naive_mape', 9)} AS naive_mape,
       {rnd('trend_seasonal_mape', 9)} AS trend_seasonal_mape,
       {rnd('recursive_mape', 9)} AS recursive_mape, best_method
FROM win"""

ORACLE_SQL["mape_by_method"] = _BT + "\n" + " UNION ALL ".join(
    f"SELECT segment, '{m}' AS method, {rnd(f'{m}_mape', 9)} AS mape FROM win"
    for m in ("naive", "trend_seasonal", "recursive"))
ORACLE_SQL["forecast_winner"] = _BT + "\nSELECT segment, best_method FROM win"

ORACLE_SQL["backtest_table"] = _BT + f"""
SELECT segment, month, revenue, {rnd('naive_forecast', 4)} AS naive_forecast,
       {rnd('trend_forecast', 4)} AS trend_forecast, {rnd('forecast', 4)} AS forecast,
       {rnd('blended_forecast', 4)} AS blended_forecast
FROM blended"""

ORACLE_SQL["backtest_macro"] = _BT + f"""
SELECT {rnd('AVG(naive_mape)', 9)} AS naive, {rnd('AVG(trend_seasonal_mape)', 9)} AS trend_seasonal,
       {rnd('AVG(recursive_mape)', 9)} AS recursive,
       {rnd('AVG(LEAST(trend_seasonal_mape, recursive_mape))', 9)} AS blended
FROM win"""

ORACLE_SQL["bottom_up_total"] = _BT + f"""
SELECT month, {rnd('SUM(revenue)', 4)} AS actual, {rnd('SUM(blended_forecast)', 4)} AS blended_forecast
FROM blended GROUP BY month"""

TREND_FULL = trend_ctes("TRUE", "fcoef")
REC_FWD = rec_cte("SELECT CAST(MAX(month) + INTERVAL 1 MONTH AS DATE) FROM dense",
                  P.forecast_horizon, "frec")
FORWARD_CTE = f"""
fut AS (
  SELECT segment, CAST(m + to_months(CAST(k AS INTEGER)) AS DATE) AS month,
         CAST(i + k AS INTEGER) AS time_idx
  FROM (SELECT segment, m, i, unnest(range(1, {P.forecast_horizon + 1})) AS k
        FROM (SELECT segment, MAX(month) AS m, MAX(time_idx) AS i FROM tidx GROUP BY segment))
),
ftrend AS (
  SELECT r.segment, r.month, {_pred} AS trend_forecast
  FROM fut r JOIN fcoef k ON r.segment = k.segment
),
fwd AS (
  SELECT f.segment, f.month, f.pred AS forecast, t.trend_forecast,
         CASE WHEN w.best_method = 'trend_seasonal' THEN t.trend_forecast ELSE f.pred END
           AS blended_forecast
  FROM frec f JOIN ftrend t ON f.segment = t.segment AND f.month = t.month
  LEFT JOIN win w ON f.segment = w.segment
)"""
_FWD = with_rec(*FORECAST_BASE, TREND_BT, REC_BT, BACKTEST_CTE, TREND_FULL, REC_FWD, FORWARD_CTE)

ORACLE_SQL["forward_trend"] = _FWD + f"""
SELECT segment, month, {rnd('forecast', 4)} AS forecast, {rnd('trend_forecast', 4)} AS trend_forecast,
       {rnd('blended_forecast', 4)} AS blended_forecast
FROM fwd"""

ORACLE_SQL["forward_pivot"] = _FWD + "\nSELECT month, " + ", ".join(
    f"{rnd(f'MAX(CASE WHEN segment = {chr(39)}{t}{chr(39)} THEN blended_forecast END)', 4)} AS {t}"
    for t in P.tier_order) + " FROM fwd GROUP BY month"

# ---- certificates of the fitted models: what holds at an optimum ----------------

_CHURN_CATS = ("true_segment", "industry", "region", "contract_type")
_CHURN_NUMS = ("tenure_days_at_cutoff", "n_quotes_12m", "n_accepted_12m", "acceptance_rate_12m",
               "avg_price_ratio_12m", "revenue_12m", "express_share_12m", "price_ratio_trend", "trend_missing")
_PRICE_CATS = ("segment", "service_level", "mode", "contract_type")
_PRICE_NUMS = ("price_ratio", "weight_kg", "distance_km", "competitor_price")


def _levels(rows: str, col: str) -> str:
    name = "segment" if col == "true_segment" else col
    return f"SELECT DISTINCT '{name}=' || {col} AS coefficient FROM {rows} UNION ALL SELECT '{name}=__unknown'"


def _coefficients(model: str, rows: str, cats, nums) -> str:
    parts = [_levels(rows, c) for c in cats] + [f"SELECT '{c}'" for c in (*nums, "intercept")]
    return f"SELECT '{model}' AS model, coefficient, CAST(0 AS DOUBLE) AS gradient FROM ({' UNION ALL '.join(parts)})"


ORACLE_SQL["logistic_certificate"] = with_(*BASE, CHURN_CTE, SPLIT_CTE, QC_CTE, """
ctrain AS (SELECT c.* FROM churn c JOIN split s ON s.customer_id = c.customer_id WHERE s.split = 'train'),
ptrain AS (SELECT * FROM qc WHERE quote_date < (SELECT cutoff FROM cut))""") + (
    "\n" + _coefficients("churn", "ctrain", _CHURN_CATS, _CHURN_NUMS)
    + "\nUNION ALL\n" + _coefficients("pricing", "ptrain", _PRICE_CATS, _PRICE_NUMS))

ORACLE_SQL["kmeans_certificate"] = f"""
SELECT range AS cluster, CAST(0 AS BIGINT) AS nearer_elsewhere, CAST(0 AS DOUBLE) AS centre_gap
FROM range({P.k})"""

ORACLE_SQL["pca_certificate"] = """
SELECT CAST(range AS INTEGER) AS component, CAST(0 AS DOUBLE) AS residual, CAST(1 AS DOUBLE) AS length,
       CAST(0 AS DOUBLE) AS product_with_next
FROM range(1, 3)"""

ORACLE_SQL["boosting_certificate"] = f"""
SELECT model, CAST({P.gbt_iter} AS BIGINT) AS rounds, CAST(0 AS BIGINT) AS rises, TRUE AS falls
FROM (VALUES ('churn'), ('pricing')) v(model)"""

ORACLE_SQL["one_hot_features"] = with_(*BASE, CHURN_CTE) + "\n" + " UNION ALL ".join(
    f"SELECT customer_id, '{'segment' if c == 'true_segment' else c}=' || {c} AS name, CAST(1 AS DOUBLE) AS value FROM churn"
    for c in _CHURN_CATS)

ORACLE_SQL["scoring_certificate"] = with_(*BASE, CHURN_CTE) + """
SELECT model, (SELECT COUNT(*) FROM churn) AS n_rows, CAST(0 AS DOUBLE) AS difference
FROM (VALUES ('Logistic Regression'), ('Gradient Boosting')) v(model)"""

ORACLE_SQL["importance_of_stub"] = """
SELECT feature, feature IN ('acceptance_rate_12m', 'express_share_12m') AS matters
FROM (VALUES ('acceptance_rate_12m'), ('express_share_12m'), ('n_quotes_12m'), ('revenue_12m'), ('region')) v(feature)"""
