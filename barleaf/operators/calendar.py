"""The trading calendar: sorted distinct dates, and ``t_idx`` as the only unit of "k days"."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.config import Backtest


def build_calendar(bars: DataFrame) -> DataFrame:
    """date, t_idx int, year int, is_month_first_day. One row for each date, so one window over all is small."""
    dates = bars.select("date").distinct()
    month = Window.partitionBy(F.year("date"), F.month("date")).orderBy("date")
    return dates.select(
        "date",
        (F.row_number().over(Window.orderBy("date")) - 1).cast("int").alias("t_idx"),
        F.year("date").cast("int").alias("year"),
        (F.row_number().over(month) == 1).alias("is_month_first_day"),
    )


def with_t_idx(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds t_idx by date; NULL for dates off the calendar."""
    return df.join(calendar.select("date", "t_idx"), "date", "left")


def rebalance_dates(calendar: DataFrame, settings: Backtest | None = None) -> DataFrame:
    s = settings or Backtest()
    return calendar.where((F.col("t_idx") >= s.rebalance_anchor_idx) & ((F.col("t_idx") - s.rebalance_anchor_idx) % s.rebalance_every_days == 0)).select("date", "t_idx")


def year_bounds(calendar: DataFrame) -> DataFrame:
    """First and last t_idx, and the number of dates, of each year."""
    return calendar.groupBy("year").agg(F.min("t_idx").alias("first_idx"), F.max("t_idx").alias("last_idx"), F.count("*").alias("n_dates"))


class TradingCalendar:
    """The calendar on the driver, for scalar lookups."""

    def __init__(self, dates: list[dt.date]):
        if list(dates) != sorted(set(dates)) or not dates:
            raise ValueError("calendar dates must be distinct, sorted and not empty")
        self.dates = list(dates)
        self._index = {d: i for i, d in enumerate(self.dates)}

    @classmethod
    def of(cls, calendar: DataFrame) -> TradingCalendar:
        rows = sorted(calendar.select("t_idx", "date").collect())
        if [r.t_idx for r in rows] != list(range(len(rows))):
            raise ValueError("t_idx must be 0..N-1")
        return cls([r.date for r in rows])

    @property
    def n_days(self) -> int:
        return len(self.dates)

    @property
    def first_date(self) -> dt.date:
        return self.dates[0]

    @property
    def last_date(self) -> dt.date:
        return self.dates[-1]

    @property
    def last_idx(self) -> int:
        return len(self.dates) - 1

    def idx_of(self, date: dt.date) -> int:
        return self._index[date]

    def date_at(self, t_idx: int) -> dt.date:
        if not 0 <= t_idx < len(self.dates):
            raise IndexError(f"t_idx {t_idx} is off the calendar")
        return self.dates[t_idx]

    def offset(self, date: dt.date, k: int) -> dt.date:
        return self.date_at(self.idx_of(date) + k)

    def first_at_or_after(self, date: dt.date) -> int:
        """The as-of position: len(dates) if there is none."""
        return bisect_left(self.dates, date)

    def first_after(self, date: dt.date) -> int:
        return bisect_right(self.dates, date)

    def bounds(self, year: int) -> tuple[int, int] | None:
        a, b = self.first_at_or_after(dt.date(year, 1, 1)), self.first_after(dt.date(year, 12, 31)) - 1
        return (a, b) if a <= b else None
