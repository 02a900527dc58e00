"""The market as seen by members: returns, index, and features of the date."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.exprs import TRADING_DAYS, full, ln_ratio

MARKET_SERIES = ("date", "mkt_logret", "mkt_index", "n_eligible")
YEAR = math.sqrt(TRADING_DAYS)


def market_returns(panel: DataFrame) -> DataFrame:
    """date, mkt_logret, n_eligible: the mean return of names eligible on their row before.

    panel: ticker, date, t_idx, logret_cc, eligible. Dates without members stay, with NULL.
    """
    before = F.lag("eligible", 1, False).over(Window.partitionBy("ticker").orderBy("t_idx"))
    rows = panel.select("date", "logret_cc", "eligible", before.alias("member"))
    return rows.groupBy("date").agg(F.avg(F.when(F.col("member"), F.col("logret_cc"))).alias("mkt_logret"), F.count_if("eligible").cast("int").alias("n_eligible"))


def market_series(panel: DataFrame) -> DataFrame:
    """MARKET_SERIES: the index is exp of the running sum, NULL where the return is. One row for each date, so one window over all is small."""
    rows = market_returns(panel)
    running = F.sum("mkt_logret").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("date", "mkt_logret", F.when(F.col("mkt_logret").isNotNull(), F.exp(running)).alias("mkt_index"), "n_eligible")


def market_features(market: DataFrame) -> DataFrame:
    """date with mkt_ret_21, mkt_ret_63, mkt_vol_21, mkt_trend_200."""
    w = lambda n: Window.orderBy("date").rowsBetween(-(n - 1), 0)
    return market.select(
        "date",
        full(F.sum, "mkt_logret", 21, w(21)).alias("mkt_ret_21"),
        full(F.sum, "mkt_logret", 63, w(63)).alias("mkt_ret_63"),
        (full(F.stddev_samp, "mkt_logret", 21, w(21)) * YEAR).alias("mkt_vol_21"),
        ln_ratio("mkt_index", full(F.avg, "mkt_index", 200, w(200))).alias("mkt_trend_200"),
    )


def cross_section(panel: DataFrame) -> DataFrame:
    """date with mkt_breadth_50 (share of eligible names above their 50-row mean) and xs_disp_21 (spread of 21-row returns).

    panel: date, eligible, px_sma_50, ret_21.
    """
    sma = F.when(F.col("eligible"), F.col("px_sma_50"))
    return panel.groupBy("date").agg(
        F.try_divide(F.count_if(sma > 0).cast("double"), F.count(sma).cast("double")).alias("mkt_breadth_50"),
        F.when(F.count(F.when(F.col("eligible"), F.col("ret_21"))) > 1, F.stddev_samp(F.when(F.col("eligible"), F.col("ret_21")))).alias("xs_disp_21"),
    )
