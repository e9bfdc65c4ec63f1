"""ratecard: pricing, retention and revenue analytics as Spark DataFrame jobs.

Every operator takes DataFrames plus keyword parameters and returns a lazy
DataFrame; nothing fact-sized is collected to the driver.

Sub-packages
------------
sources    logical tables (accounts, quotes) from parquet/CSV, sinks
functions  column-expression helpers (statistics, calendar, rounding)
operators  the analytic operators (features, ranking, segments, pricing,
           churn, experiment, forecast)
plans      the registered queries and their DuckDB oracle SQL
"""

from ratecard.params import AnalysisParams, TESTDATA_PARAMS  # noqa: F401
from ratecard.session import get_session  # noqa: F401

__all__ = ["AnalysisParams", "TESTDATA_PARAMS", "get_session"]
