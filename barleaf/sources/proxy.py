"""A bar panel from order lines: brands as tickers, weeks as dates.

A line's price is its extended price per unit. Open and close are the first and
last price of a week in a total order of lines, volume the units sold, and the
adjusted close is the close less the week's mean discount, which is summed in
whole hundredths so that it doesn't depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barleaf.config import Config, build

ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
BARS = ("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")


def traded_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the weeks in which a brand sold: one aggregate over lineitem with its part's brand."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*ORDER, "l_quantity", "l_discount")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), px.alias("px"), F.struct(*ORDER).alias("place"), "l_quantity", F.round(F.col("l_discount") * 100).cast("long").alias("cents")
    )
    return rows.groupBy("ticker", "date").agg(
        F.min_by("px", "place").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "place").alias("close"),
        F.sum(F.col("l_quantity").cast("long")).alias("volume"), (F.sum("cents") / (F.count("*") * F.lit(100.0))).alias("d"),
    ).select("ticker", "date", "open", "high", "low", "close", (F.col("close") * (F.lit(1.0) - F.col("d"))).alias("adj_close"), "volume")


def bars(traded: DataFrame, calendar: DataFrame) -> DataFrame:
    """traded_bars without gaps: from a brand's first week on, a week without sales repeats the close with volume 0.

    The grid is each brand's own run of calendar positions, so no brand meets dates that it doesn't need.
    """
    at = traded.join(calendar.select("date", "t_idx"), "date")
    last = calendar.agg(F.max("t_idx")).first()[0]
    first = at.groupBy("ticker").agg(F.min("t_idx").alias("first"))
    grid = first.select("ticker", F.explode(F.sequence("first", F.lit(last).cast("int"))).alias("t_idx"))
    rows = grid.join(at.drop("date"), ["ticker", "t_idx"], "left").join(calendar.select("date", "t_idx"), "t_idx")
    w = Window.partitionBy("ticker").orderBy("t_idx").rowsBetween(Window.unboundedPreceding, 0)
    close, adjusted = F.last("close", True).over(w), F.last("adj_close", True).over(w)
    return rows.select("ticker", "date", *(F.coalesce(c, close).alias(c) for c in ("open", "high", "low")), close.alias("close"), adjusted.alias("adj_close"), F.coalesce("volume", F.lit(0)).cast("long").alias("volume"))


def settings() -> Config:
    """Thresholds at which both branches of every rule occur on the proxy panel, and splits inside its years."""
    return build({
        "flags": {"tick_noise_min_close": 500.0, "extreme_move_abs_ret": 2.0},
        "universe": {"seasoning_days": 60, "min_close": 300.0, "min_median_dollar_volume_63": 320_000.0},
        "labels": {"horizons": [5, 10], "primary_horizon": 5, "min_names": 5},
        "validation": {
            "first_train_decision_date": "1996-03-01", "dev_test_years": [1999, 2000], "locked_test_start": "2001-01-01", "embargo_days": 2,
            "calibration_days": 26, "train_stride": 2, "tuning_end_date": "1998-12-31", "tuning_valid_years": [1997, 1998],
        },
        "backtest": {"rebalance_every_days": 20, "rebalance_anchor_idx": 252},
    })


#: Curated facts for the proxy panel.
CURATED_ROWS = [
    ("Brand#1", "issuer-1", "A", "duplicate line", "false", "kept out by hand"),
    ("Brand#2", "", "B", "", "true", "two histories"),
    ("Brand#3", "issuer-3", "", "", "no", ""),
]
