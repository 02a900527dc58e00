"""Point-in-time eligibility: five reasons to fail, and none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barleaf.config import Universe
from barleaf.errors import UniverseError
from barleaf.functions.exprs import framed_median, full, trailing
from barleaf.operators.keys import assert_none, assert_unique

LIQUIDITY_WINDOW = 63
FAILS = ("fail_master", "fail_seasoning", "fail_min_close", "fail_zero_volume", "fail_liquidity")
UNIVERSE = ("ticker", "date", "eligible", *FAILS, "median_dollar_volume_63")
#: Cohort names of the settings and of the master.
COHORTS = {"original55": "orig2000", "orig2000": "orig2000", "later": "later"}


def median_dollar_volume() -> Column:
    """Median of close x volume over the ticker's last 63 observations; NULL before."""
    dv = F.col("close") * F.col("volume").cast("double")
    return full(framed_median, dv, LIQUIDITY_WINDOW, trailing(LIQUIDITY_WINDOW, order="date"))


def master_fails(s: Universe) -> Column:
    if s.cohort_filter is not None and s.cohort_filter not in COHORTS:
        raise UniverseError(f"unknown cohort {s.cohort_filter!r}")
    fails = ~F.col("include_in_universe")
    if s.cohort_filter is not None:
        fails = fails | (F.col("cohort") != COHORTS[s.cohort_filter])
    return fails | F.col("stitching_suspect") if s.drop_stitched else fails


def build_universe(silver: DataFrame, master: DataFrame, settings: Universe | None = None, checked: bool = True) -> DataFrame:
    """UNIVERSE for every silver row. The master is one row per ticker; Spark picks the join by its size.

    checked: refuse bad keys and tickers without a master row first (three small actions).
    """
    s = settings or Universe()
    if checked:
        assert_none(silver, UniverseError, missing=F.col("ticker").isNull() | F.col("date").isNull() | F.col("close").isNull() | F.col("volume").isNull())
        assert_unique(silver, UniverseError)
        if bad := silver.select("ticker").distinct().join(master.select("ticker"), "ticker", "left_anti").limit(5).collect():
            raise UniverseError(f"tickers without a master row: {[r.ticker for r in bad]}")
    rows = silver.select("ticker", "date", "close", "volume", "n_obs", median_dollar_volume().alias("median_dollar_volume_63"))
    rows = rows.join(master.select("ticker", master_fails(s).alias("fail_master")), "ticker", "left")
    rows = rows.withColumns({
        "fail_master": F.coalesce("fail_master", F.lit(True)),
        "fail_seasoning": F.col("n_obs") <= s.seasoning_days,
        "fail_min_close": F.col("close") < s.min_close,
        "fail_zero_volume": F.col("volume") == 0 if s.require_positive_volume else F.lit(False),
        "fail_liquidity": ~F.coalesce(F.col("median_dollar_volume_63") >= s.min_median_dollar_volume_63, F.lit(False)),
    })
    any_fail = F.col(FAILS[0])
    for f in FAILS[1:]:
        any_fail = any_fail | F.col(f)
    return rows.withColumn("eligible", ~any_fail).select(*UNIVERSE)


def eligible_per_date(universe: DataFrame) -> DataFrame:
    return universe.groupBy("date").agg(F.count_if("eligible").alias("n_eligible"), F.count("*").alias("n_names"))


def summary(universe: DataFrame) -> DataFrame:
    """Fewest, median and most eligible names on a date."""
    return eligible_per_date(universe).agg(F.min("n_eligible").alias("min_eligible"), F.median("n_eligible").alias("median_eligible"), F.max("n_eligible").alias("max_eligible"))
