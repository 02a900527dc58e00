"""What each feature is: family, level, how far it looks back and how many leading rows are missing."""

from __future__ import annotations

from dataclasses import dataclass

from barleaf.errors import FeatureError


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    family: str
    level: str
    lookback: int
    warmup: int
    depends_on: tuple[str, ...] = ()


FAMILIES = ("momentum", "volatility", "trend", "liquidity", "market")

#: Name, lookback, warm-up, what it needs, by family.
_TABLE = {
    "momentum": [("ret_5", 5, 5), ("ret_21", 21, 21), ("ret_63", 63, 63), ("ret_126", 126, 126), ("ret_252", 252, 252), ("mom_12_1", 252, 252)],
    "volatility": [("vol_21", 21, 21), ("vol_63", 63, 63), ("downvol_63", 63, 63), ("vol_ratio_21_63", 63, 63, "vol_21", "vol_63"), ("parkinson_21", 21, 20), ("beta_126", 126, 126, "mkt_logret")],
    "trend": [("px_sma_50", 50, 49), ("px_sma_200", 200, 199), ("dist_52w_high", 252, 251)],
    "liquidity": [("log_dvol_63", 63, 62), ("rel_dvol_21_63", 63, 62), ("amihud_63", 63, 63)],
    "market": [("mkt_ret_21", 21, 20), ("mkt_ret_63", 63, 62), ("mkt_vol_21", 21, 20), ("mkt_trend_200", 200, 199), ("mkt_breadth_50", 50, 0, "px_sma_50"), ("xs_disp_21", 21, 0, "ret_21")],
}

SPECS: dict[str, FeatureSpec] = {
    row[0]: FeatureSpec(row[0], family, "market" if family == "market" else "stock", row[1], row[2], tuple(row[3:])) for family, rows in _TABLE.items() for row in rows
}


def get_spec(name: str) -> FeatureSpec:
    if name not in SPECS:
        raise FeatureError(f"unknown feature {name!r}")
    return SPECS[name]


def selected(families: tuple[str, ...]) -> list[str]:
    """Features of the families, in registry order."""
    if unknown := [f for f in families if f not in FAMILIES]:
        raise FeatureError(f"unknown families {unknown}")
    if len(set(families)) != len(families) or not families:
        raise FeatureError("families must be distinct and at least one")
    return [s.name for s in SPECS.values() if s.family in families]


def closure(names: list[str]) -> list[str]:
    """The features and all that they need, in registry order."""
    todo, have = list(names), set()
    while todo:
        name = todo.pop()
        if name in SPECS and name not in have:
            have.add(name)
            todo += SPECS[name].depends_on
    return [n for n in SPECS if n in have]
