"""Parameters of the analyses (everything the reference hard-codes)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class AnalysisParams:
    # snapshot date of the data ("today")
    as_of: dt.date = dt.date(2001, 8, 2)
    # display / tie-break order of the assigned tiers
    tier_order: tuple = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    # churn windows, months
    label_offset_months: int = 12   # cutoff = as_of - 12m
    label_window_months: int = 6    # label end = as_of - 6m
    prior_window_months: int = 12   # features from [cutoff - 12m, cutoff)
    trend_edge_months: int = 3      # early/late slices of the prior window
    min_tenure_days: int = 90
    min_prior_accepted: int = 1
    # monthly panel start (None = keep everything)
    panel_start: dt.date | None = None
    # pricing
    holdout_months: int = 6
    support_quantile: float = 0.97
    grid_start: float = 0.70
    grid_step: float = 0.01
    grid_points: int = 66
    # experiment
    experiment_days: int = 90
    guardrail_drop: float = 0.03
    min_arm_rows: int = 5
    salt: str = "ratecard-42"
    baseline_mde: float = 0.02
    alpha: float = 0.05
    power: float = 0.80
    # segmentation
    k: int = 4
    k_range: tuple = (2, 3, 4, 5, 6, 7, 8)
    # churn split
    test_fraction: float = 0.25
    # forecasting
    forecast_horizon: int = 3
    # price test: share of the accounts that take part
    sample_fraction: float = 0.6
    # model settings
    seed: int = 42
    gbt_iter: int = 300            # pricing and churn models
    forecast_gbt_iter: int = 250   # recursive forecaster
    dependence_points: int = 100

    def with_(self, **kw) -> "AnalysisParams":
        return replace(self, **kw)


# Fixed values of the testdata mapping: the newest order date is 2001-08-01
# at every scale factor, tiers are the five c_mktsegment values.
TESTDATA_PARAMS = AnalysisParams()
