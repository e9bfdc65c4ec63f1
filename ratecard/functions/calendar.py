"""Calendar helpers (DATE columns, month arithmetic with month-end clipping)."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_months(d: dt.date, n: int) -> dt.date:
    """Scalar month arithmetic with end-of-month clipping (31 Aug - 6m = 28 Feb)."""
    y, m = divmod(d.month - 1 + n, 12)
    year, month = d.year + y, m + 1
    return dt.date(year, month, min(d.day, calendar.monthrange(year, month)[1]))


def month_start(c) -> Column:
    return F.trunc(F.col(c) if isinstance(c, str) else c, "month")
