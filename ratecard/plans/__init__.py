"""Registered queries (Spark) and their independent DuckDB oracle SQL."""

from ratecard.plans.queries import QUERIES, ROWS_ONLY  # noqa: F401
from ratecard.plans.oracle import ORACLE_SQL  # noqa: F401
