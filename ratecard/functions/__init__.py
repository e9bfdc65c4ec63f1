from ratecard.functions.exact import dec_sum, dec_avg, money_sum  # noqa: F401
from ratecard.functions.stats import (  # noqa: F401
    erfc, normal_cdf, two_sided_normal_p, logistic, isclose, z_quantile,
)
from ratecard.functions.calendar import month_start  # noqa: F401
