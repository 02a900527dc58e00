"""Adjusted prices: every price times adj_close / close."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.errors import AdjustError
from barleaf.functions.exprs import ln_ratio
from barleaf.operators.calendar import with_t_idx
from barleaf.operators.keys import assert_contiguous, assert_none, assert_unique, bad_positive

ADJUSTED = ("ticker", "date", "t_idx", "adj_factor", "adj_open", "adj_high", "adj_low", "adj_close", "volume", "dollar_volume", "logret_cc")
LAST_FACTOR_TOLERANCE = 1e-9


def build_adjusted(silver: DataFrame, calendar: DataFrame, checked: bool = True) -> DataFrame:
    """ADJUSTED for every row. High and low are widened where rounding put them inside the bar."""
    rows = with_t_idx(silver.select("ticker", "date", "open", "high", "low", "close", "adj_close", "volume"), calendar)
    if checked:
        assert_none(rows, AdjustError, off_calendar=F.col("t_idx").isNull(), **{f"bad_{c}": bad_positive(c) for c in ("open", "high", "low", "close", "adj_close")})
        assert_unique(rows, AdjustError)
        assert_contiguous(rows, AdjustError)
    f = F.col("adj_close") / F.col("close")
    o, h, low, a = F.col("open") * f, F.col("high") * f, F.col("low") * f, F.col("adj_close")
    w = Window.partitionBy("ticker").orderBy("t_idx")
    return rows.select(
        "ticker", "date", F.col("t_idx").cast("int").alias("t_idx"), f.alias("adj_factor"), o.alias("adj_open"),
        F.greatest(h, o, a).alias("adj_high"), F.least(low, o, a).alias("adj_low"), "adj_close", "volume",
        (F.col("close") * F.col("volume").cast("double")).alias("dollar_volume"), ln_ratio(a, F.lag("adj_close").over(w)).alias("logret_cc"),
    )


def last_factors(adjusted: DataFrame) -> DataFrame:
    """Each ticker's last factor, and whether it is 1."""
    last = adjusted.groupBy("ticker").agg(F.max_by("adj_factor", "t_idx").alias("last_factor"))
    return last.withColumn("is_one", F.abs(F.col("last_factor") - 1) <= LAST_FACTOR_TOLERANCE)
