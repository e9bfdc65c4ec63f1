"""Per-query access to the logical tables of one testdata directory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratecard.operators.pricing import with_contract
from ratecard.params import TESTDATA_PARAMS, AnalysisParams
from ratecard.session import ensure_checkpoint_dir
from ratecard.sources.conformed import conformed_accounts, conformed_quotes, quotes_stored
from ratecard.sources.testdata import load_quotes


class Tables:
    """Lazily built logical tables; every call returns a new lazy plan, so
    Catalyst prunes columns and pushes filters per query."""

    def __init__(self, spark: SparkSession, sf_dir: str, params: AnalysisParams = TESTDATA_PARAMS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.p = params
        if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_checkpoint_dir(spark)

    def accounts(self) -> DataFrame:
        return conformed_accounts(self.spark, self.sf_dir)

    def quotes(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """The conformed quote table, optionally restricted to [start, end)
        (it also carries the raw line-item key columns)."""
        q = conformed_quotes(self.spark, self.sf_dir)
        if start is not None:
            q = q.where(F.col("quote_date") >= F.lit(start))
        if end is not None:
            q = q.where(F.col("quote_date") < F.lit(end))
        return q

    def priced_once(self) -> DataFrame:
        """All quotes with their account's contract (null: no such account), likewise without a stored copy.
        The contracts are joined to the orders, not to their lines."""
        if quotes_stored(self.spark, self.sf_dir):
            return with_contract(self.quotes(), self.accounts())
        return load_quotes(self.spark, self.sf_dir, contracts=self.accounts())

    def quotes_once(self, start: dt.date | None = None, end: dt.date | None = None,
                    by_order: bool = False) -> DataFrame:
        """The same rows (without the line-item keys) for one aggregation whose result is kept: the
        stored table if the session has one, else the joins themselves, which carry only the columns that
        are asked for. ``by_order``: rows of an order stay together (see ``load_quotes``)."""
        if quotes_stored(self.spark, self.sf_dir):
            return self.quotes(start, end)
        return load_quotes(self.spark, self.sf_dir, start, end, parts_first=by_order)
