"""Order-independent sums.

Floating-point sums depend on the order rows arrive in, which differs
between partitions, retries and engines. Money (2 dp) and ratios (4 dp)
are exact decimals, so summing them as DECIMAL gives the same bits on
every run; averages divide the exact sum by the count as DOUBLE. A value
with more decimals than declared is an error, never rounded in silence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def dec_sum(c, scale: int = 4, precision: int = 18) -> Column:
    """Exact SUM of a column holding at most ``scale`` decimals, as DOUBLE."""
    x = _c(c)
    dec = x.cast(f"decimal({precision},{scale})")
    off = F.abs(dec.cast("double") - x.cast("double"))
    # one double step at most, the distance of a double from its decimal
    fits = off <= F.abs(x.cast("double")) * 1e-14
    return F.sum(F.when(x.isNull() | fits, dec).otherwise(F.raise_error(F.concat(
        F.lit(f"more than {scale} decimals: "), x.cast("string"))))).cast("double")


def money_sum(c) -> Column:
    return dec_sum(c, scale=2)


def dec_avg(c, scale: int = 4, precision: int = 18) -> Column:
    """Exact-sum AVG (nulls skipped, like ``avg``)."""
    x = _c(c)
    return dec_sum(x, scale, precision) / F.count(x)
