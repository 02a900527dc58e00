"""Settings as frozen dataclasses: defaults, an override file, then key=value overrides.

Unknown keys are errors; ``fingerprint`` is the digest of the canonical form.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from barleaf.errors import StageError


@dataclass(frozen=True)
class Project:
    name: str = "panel"
    variant: str = "base"
    seed: int = 42


@dataclass(frozen=True)
class Flags:
    tick_noise_min_close: float = 5.0
    corp_action_ret_gap: float = 0.03
    corp_action_min_prev_close: float = 5.0
    extreme_move_abs_ret: float = 0.40
    max_zero_volume_share_ticker: float = 0.05


@dataclass(frozen=True)
class Universe:
    seasoning_days: int = 252
    min_close: float = 5.0
    require_positive_volume: bool = True
    min_median_dollar_volume_63: float = 1_000_000.0
    cohort_filter: str | None = None
    drop_stitched: bool = False


@dataclass(frozen=True)
class Labels:
    horizons: tuple[int, ...] = (20,)
    primary_horizon: int = 20
    winsor_pct: tuple[float, float] = (0.01, 0.99)
    min_names: int = 20


@dataclass(frozen=True)
class Features:
    families: tuple[str, ...] = ("momentum", "volatility", "trend", "liquidity", "market")
    winsor_pct: tuple[float, float] = (0.01, 0.99)


@dataclass(frozen=True)
class Validation:
    first_train_decision_date: dt.date = dt.date(2001, 1, 2)
    dev_test_years: tuple[int, ...] = tuple(range(2008, 2020))
    locked_test_start: dt.date = dt.date(2020, 1, 2)
    embargo_days: int = 5
    calibration_days: int = 504
    train_window_days: int | None = None
    train_stride: int = 5
    tuning_end_date: dt.date = dt.date(2007, 12, 31)
    tuning_valid_years: tuple[int, ...] = (2005, 2006, 2007)


@dataclass(frozen=True)
class Backtest:
    rebalance_every_days: int = 20
    rebalance_anchor_idx: int = 252


@dataclass(frozen=True)
class Config:
    project: Project = field(default_factory=Project)
    flags: Flags = field(default_factory=Flags)
    universe: Universe = field(default_factory=Universe)
    labels: Labels = field(default_factory=Labels)
    features: Features = field(default_factory=Features)
    validation: Validation = field(default_factory=Validation)
    backtest: Backtest = field(default_factory=Backtest)


def _cast(value: Any, like: Any) -> Any:
    if isinstance(like, tuple) and isinstance(value, list | tuple):
        return tuple(value)
    if isinstance(like, dt.date) and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if isinstance(like, bool) != isinstance(value, bool) and like is not None and value is not None:
        raise StageError(f"expected {type(like).__name__}, got {value!r}")
    return float(value) if isinstance(like, float) and isinstance(value, int) else value


def build(over: dict[str, dict[str, Any]], base: Config | None = None) -> Config:
    """``base`` with sections' keys replaced."""
    out = base or Config()
    for section, values in over.items():
        if section not in {f.name for f in dataclasses.fields(out)}:
            raise StageError(f"unknown section {section!r}")
        now = getattr(out, section)
        unknown = set(values) - {f.name for f in dataclasses.fields(now)}
        if unknown:
            raise StageError(f"unknown keys in {section}: {sorted(unknown)}")
        out = dataclasses.replace(out, **{section: dataclasses.replace(now, **{k: _cast(v, getattr(now, k)) for k, v in values.items()})})
    return out


def literal(text: str) -> Any:
    """The value of an override: true, false, null, numbers and JSON lists; else text."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def with_overrides(config: Config, pairs: list[str]) -> Config:
    over: dict[str, dict[str, Any]] = {}
    for pair in pairs:
        name, sep, value = pair.partition("=")
        section, dot, key = name.strip().partition(".")
        if not sep or not dot:
            raise StageError(f"override {pair!r} is not section.key=value")
        over.setdefault(section, {})[key] = literal(value.strip())
    return build(over, config)


def load(path: str | None = None, pairs: list[str] | None = None) -> Config:
    """Defaults, then a JSON (or, with PyYAML, YAML) file, then overrides."""
    config = Config()
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            over = json.loads(text)
        except ValueError:
            import yaml

            over = yaml.safe_load(text) or {}
        config = build(over, config)
    return with_overrides(config, pairs or [])


def canonical(x: Any) -> str:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), default=str)


def fingerprint(config: Config) -> str:
    return hashlib.sha256(canonical(dataclasses.asdict(config)).encode()).hexdigest()
