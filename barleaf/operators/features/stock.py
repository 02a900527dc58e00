"""Stock features as columns over one window partitioning (ticker, t_idx).

Each gives NULL until its window is full of present values. Needs the adjusted
table's columns and, for beta, ``mkt_logret``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barleaf.functions.exprs import TRADING_DAYS, full, ln_ratio, safe_ln, trailing

YEAR = math.sqrt(TRADING_DAYS)
AMIHUD_SCALE, BETA_LEAST_RELATIVE_VARIANCE = 1e6, 1e-9


def by() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("t_idx")


def ret(k: int) -> Column:
    return ln_ratio("adj_close", F.lag("adj_close", k).over(by()))


def vol(n: int) -> Column:
    return full(F.stddev_samp, "logret_cc", n, trailing(n)) * YEAR


def downvol(n: int) -> Column:
    r = F.col("logret_cc")
    loss = F.when(r < 0, r * r).when(r.isNotNull(), F.lit(0.0))
    return F.sqrt(full(F.avg, loss, n, trailing(n))) * YEAR


def parkinson(n: int) -> Column:
    span = ln_ratio("adj_high", "adj_low")
    return F.sqrt(full(F.avg, span * span, n, trailing(n)) / (4 * math.log(2))) * YEAR


def beta(n: int) -> Column:
    """Covariance over variance of the pairs in the window; NULL if the market hardly moves."""
    r, m, w = F.col("logret_cc"), F.col("mkt_logret"), trailing(n)
    both = r.isNotNull() & m.isNotNull()
    var = F.var_samp(F.when(both, m)).over(w)
    square = F.avg(F.when(both, m * m)).over(w)
    moves = (F.count(F.when(both, 1)).over(w) == n) & (var > BETA_LEAST_RELATIVE_VARIANCE * square)
    return F.when(moves, F.covar_samp(F.when(both, r), F.when(both, m)).over(w) / var)


def over_mean(n: int) -> Column:
    return ln_ratio("adj_close", full(F.avg, "adj_close", n, trailing(n)))


def amihud(n: int) -> Column:
    """Mean of |r| per dollar on days with volume, scaled, as log1p; needs n present returns."""
    r, dv, w = F.col("logret_cc"), F.col("dollar_volume"), trailing(n)
    traded = r.isNotNull() & (dv > 0)
    total = F.sum(F.when(traded, F.abs(r) / dv)).over(w)
    days = F.count(F.when(traded, 1)).over(w)
    return F.when((F.count(r).over(w) == n) & (days > 0), F.log1p(AMIHUD_SCALE * total / days))


def mean_dv(n: int) -> Column:
    return full(F.avg, "dollar_volume", n, trailing(n))


BUILDERS: dict[str, Callable[[], Column]] = {
    "ret_5": lambda: ret(5), "ret_21": lambda: ret(21), "ret_63": lambda: ret(63), "ret_126": lambda: ret(126), "ret_252": lambda: ret(252),
    "mom_12_1": lambda: ln_ratio(F.lag("adj_close", 21).over(by()), F.lag("adj_close", 252).over(by())),
    "vol_21": lambda: vol(21), "vol_63": lambda: vol(63), "downvol_63": lambda: downvol(63), "parkinson_21": lambda: parkinson(21), "beta_126": lambda: beta(126),
    "vol_ratio_21_63": lambda: ln_ratio("vol_21", "vol_63"),
    "px_sma_50": lambda: over_mean(50), "px_sma_200": lambda: over_mean(200),
    "dist_52w_high": lambda: ln_ratio("adj_close", full(F.max, "adj_close", 252, trailing(252))),
    "log_dvol_63": lambda: safe_ln(mean_dv(63)), "rel_dvol_21_63": lambda: ln_ratio(mean_dv(21), mean_dv(63)), "amihud_63": lambda: amihud(63),
}


def with_features(panel: DataFrame, names: list[str]) -> DataFrame:
    """Adds the features: all windows share one exchange and sort; vol_ratio is a projection over two of them."""
    first = [n for n in names if n != "vol_ratio_21_63"]
    out = panel.withColumns({n: BUILDERS[n]() for n in first})
    return out.withColumn("vol_ratio_21_63", BUILDERS["vol_ratio_21_63"]()) if "vol_ratio_21_63" in names else out
