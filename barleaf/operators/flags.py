"""Silver: bars with an observation counter and five quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barleaf.config import Flags
from barleaf.functions.exprs import false_if_null, ln_ratio

BRONZE = ("ticker", "date", "open", "high", "low", "close", "adj_close", "volume")
FLAGS = ("flag_tick_noise", "flag_zero_volume", "flag_flat_bar", "flag_corp_action_suspect", "flag_extreme_move")
SILVER = (*BRONZE, "n_obs", *FLAGS)


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def previous_row_returns() -> dict[str, Column]:
    """Close of the row before, and log returns of close and adjusted close."""
    prev = F.lag("close").over(by_ticker())
    return {
        "prev_close": prev,
        "ret_close": ln_ratio(F.col("close"), prev),
        "ret_adj": ln_ratio(F.col("adj_close"), F.lag("adj_close").over(by_ticker())),
    }


def flag_columns(s: Flags) -> dict[str, Column]:
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    gap = F.abs(F.col("ret_close") - F.col("ret_adj"))
    return {
        "flag_tick_noise": F.col("close") < s.tick_noise_min_close,
        "flag_zero_volume": F.col("volume") == 0,
        "flag_flat_bar": flat,
        "flag_corp_action_suspect": (gap > s.corp_action_ret_gap) & (F.col("prev_close") >= s.corp_action_min_prev_close),
        "flag_extreme_move": F.abs("ret_adj") > s.extreme_move_abs_ret,
    }


def add_flags(bronze: DataFrame, settings: Flags | None = None) -> DataFrame:
    """All flags and n_obs in one pass: one exchange on ticker. A ticker's first row has no return, so those flags are false."""
    rows = bronze.select(*BRONZE).withColumns(previous_row_returns() | {"n_obs": F.row_number().over(by_ticker()).cast("int")})
    flags = {n: false_if_null(c) for n, c in flag_columns(settings or Flags()).items()}
    return rows.select(*BRONZE, "n_obs", *(c.alias(n) for n, c in flags.items()))


def corp_action_events(silver: DataFrame) -> DataFrame:
    """Flagged rows with the returns that set the flag. Returns come from all rows, before the filter."""
    rows = silver.withColumns(previous_row_returns())
    return rows.where("flag_corp_action_suspect").select("date", "ticker", "prev_close", "close", "ret_close", "ret_adj", F.abs(F.col("ret_close") - F.col("ret_adj")).alias("ret_gap"))
