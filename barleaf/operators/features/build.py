"""The three feature tables: market series, raw features, model features."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.config import Features
from barleaf.errors import FeatureError
from barleaf.operators.features import market as mkt
from barleaf.operators.features.normalize import check_winsor, rank_gauss
from barleaf.operators.features.registry import SPECS, closure, selected
from barleaf.operators.features.stock import with_features
from barleaf.operators.keys import assert_contiguous, assert_none, assert_same_keys, bad_positive

INPUT = ("ticker", "date", "t_idx", "adj_high", "adj_low", "adj_close", "dollar_volume", "logret_cc")


class FeatureTables(NamedTuple):
    market_series: DataFrame
    raw: DataFrame
    model: DataFrame


def check_inputs(adjusted: DataFrame, universe: DataFrame) -> None:
    assert_none(adjusted, FeatureError, **{f"bad_{c}": bad_positive(c) for c in ("adj_high", "adj_low", "adj_close")}, bad_dv=F.col("dollar_volume").isNull() | (F.col("dollar_volume") < 0))
    assert_same_keys(adjusted, universe, FeatureError, "adjusted prices and universe")
    assert_contiguous(adjusted, FeatureError)


def panel_of(adjusted: DataFrame, universe: DataFrame) -> DataFrame:
    return adjusted.select(*INPUT).join(universe.select("ticker", "date", "eligible"), ["ticker", "date"])


def build_features(adjusted: DataFrame, universe: DataFrame, settings: Features | None = None, checked: bool = True) -> FeatureTables:
    """Families left out drop their columns and change no others: what the rest needs is still computed."""
    s = settings or Features()
    names = selected(s.families)
    check_winsor(s.winsor_pct)
    if checked:
        check_inputs(adjusted, universe)
    panel = panel_of(adjusted, universe)
    series = mkt.market_series(panel)
    need = closure(names)
    stock = [n for n in need if SPECS[n].level == "stock"]
    rows = panel.join(series.select("date", "mkt_logret"), "date", "left") if "beta_126" in need else panel
    rows = with_features(rows, stock)
    if any(SPECS[n].level == "market" for n in names):
        date = mkt.market_features(series).join(mkt.cross_section(rows), "date", "left")
        rows = rows.join(date, "date", "left")
    raw = rows.select("ticker", "date", "eligible", *names)
    model = rank_gauss(raw, [n for n in names if SPECS[n].level == "stock"], s.winsor_pct)
    return FeatureTables(series, raw, model.select("ticker", "date", "eligible", *names))
