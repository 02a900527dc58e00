"""The one table that models read: features and labels of a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.config import Config
from barleaf.errors import LoaderError
from barleaf.operators import guards
from barleaf.operators.calendar import TradingCalendar, with_t_idx
from barleaf.operators.keys import assert_same_keys
from barleaf.operators.labels import STEMS

SPLITS = ("dev", "tuning", "locked")
MASKED = ("ret_fwd_h", "excess_h", "y_reg_h", "y_cls_h", "rank_pct_h")


def choose(model: DataFrame, wanted: list[str] | None) -> list[str]:
    """Feature columns without repeats, in the order asked for; all if None."""
    have = [c for c in model.columns if c not in ("ticker", "date", "eligible")]
    chosen = have if wanted is None else list(dict.fromkeys(wanted))
    if unknown := [c for c in chosen if c not in have]:
        raise LoaderError(f"unknown features {unknown}")
    return chosen


def mask_labels(panel: DataFrame, horizon: int, cap: int) -> DataFrame:
    """Labels after ``cap`` become missing; exit indices stay."""
    known = F.col("t_idx") <= cap
    return panel.withColumns({f"{s}{horizon}": F.when(known, F.col(f"{s}{horizon}")) for s in MASKED} | {f"has_label_h{horizon}": F.col(f"has_label_h{horizon}") & known})


def build_panel(
    model: DataFrame, labels: DataFrame | None, universe: DataFrame, calendar_df: DataFrame, calendar: TradingCalendar, config: Config, features: list[str] | None, split: str, token: guards.Token | None = None, checked: bool = True
) -> DataFrame:
    """ticker, date, t_idx, eligible, the features and the primary horizon's labels.

    Split and token are checked before anything is read. The split is a filter
    on t_idx that Catalyst pushes below the join.
    """
    if split not in SPLITS:
        raise LoaderError(f"unknown split {split!r}")
    if split == "locked":
        guards.require_token(token, "the locked panel")
    h, chosen = config.labels.primary_horizon, choose(model, features)
    wanted = [f"{s}{h}" for s in STEMS] if labels is not None else []
    if labels is not None and (missing := [c for c in wanted if c not in labels.columns]):
        raise LoaderError(f"labels lack {missing}")
    if checked:
        for name, other in (("universe", universe), *((("labels", labels),) if labels is not None else ())):
            assert_same_keys(model, other, LoaderError, f"features and {name}")
        both = model.select("ticker", "date", "eligible").join(universe.select("ticker", "date", F.col("eligible").alias("now")), ["ticker", "date"])
        if both.where("eligible <> now").limit(1).count():
            raise LoaderError("eligible differs between features and universe")
    panel = with_t_idx(model.select("ticker", "date", "eligible", *chosen), calendar_df)
    if labels is not None:
        panel = panel.join(labels.select("ticker", "date", *wanted), ["ticker", "date"])
    cap = None
    if split == "dev":
        panel, cap = panel.where(F.col("t_idx") < guards.locked_start_idx(config, calendar)), guards.last_dev_label_idx(config, calendar)
    elif split == "tuning":
        cap = guards.tuning_max_idx(config, calendar)
        panel = panel.where(F.col("t_idx") <= cap)
    panel = panel.select("ticker", "date", "t_idx", "eligible", *chosen, *wanted)
    return mask_labels(panel, h, cap) if wanted and cap is not None else panel
