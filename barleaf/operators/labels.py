"""Forward-return labels: decide at the close of t, enter at the open of t+1, leave at the open of t+1+h."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.config import Labels
from barleaf.errors import LabelError
from barleaf.functions.exprs import clip, pct_rank, safe_ln
from barleaf.operators.keys import assert_contiguous, assert_same_keys

STEMS = ("ret_fwd_h", "excess_h", "y_reg_h", "y_cls_h", "rank_pct_h", "label_exit_idx_h", "has_label_h")


def label_columns(horizons: tuple[int, ...]) -> list[str]:
    return ["ticker", "date", *(f"{s}{h}" for h in horizons for s in STEMS)]


def check_settings(s: Labels) -> None:
    h = s.horizons
    if not h or any(x < 1 for x in h) or len(set(h)) != len(h) or s.primary_horizon not in h:
        raise LabelError(f"bad horizons {h} with primary {s.primary_horizon}")
    if not 0 <= s.winsor_pct[0] < s.winsor_pct[1] <= 1:
        raise LabelError(f"bad winsor_pct {s.winsor_pct}")


def build_labels(adjusted: DataFrame, universe: DataFrame, calendar: DataFrame, settings: Labels | None = None, checked: bool = True) -> DataFrame:
    """For each horizon the STEMS columns, for every row: one exchange on ticker, one on date.

    Values against the cross-section need at least ``min_names`` eligible names
    with a label on the date; exit index and has_label are always there.
    """
    s = settings or Labels()
    check_settings(s)
    if checked:
        assert_same_keys(adjusted, universe, LabelError, "adjusted prices and universe")
        assert_contiguous(adjusted, LabelError)
    last = calendar.agg(F.max("t_idx").alias("last_idx"))  # one row
    w = Window.partitionBy("ticker").orderBy("t_idx")
    rows = adjusted.select("ticker", "date", "t_idx", safe_ln("adj_open").alias("log_open")).join(universe.select("ticker", "date", "eligible"), ["ticker", "date"])
    entry = F.lead("log_open", 1).over(w)
    rows = rows.select("ticker", "date", "t_idx", "eligible", *((F.lead("log_open", 1 + h).over(w) - entry).alias(f"raw{h}") for h in s.horizons)).crossJoin(F.broadcast(last))
    date = Window.partitionBy("date")
    for h in s.horizons:
        has = F.coalesce((F.col("t_idx") + 1 + h <= F.col("last_idx")) & F.col(f"raw{h}").isNotNull(), F.lit(False))
        rows = rows.withColumns({f"label_exit_idx_h{h}": (F.col("t_idx") + 1 + h).cast("int"), f"has_label_h{h}": has})
        rows = rows.withColumns({f"ret_fwd_h{h}": F.when(F.col(f"has_label_h{h}"), F.col(f"raw{h}")), "valid": F.col("eligible") & F.col(f"has_label_h{h}")})
        rows = rows.withColumn("r", F.when(F.col("valid") & (F.count_if("valid").over(date) >= s.min_names), F.col(f"ret_fwd_h{h}")))
        rows = rows.withColumn(f"excess_h{h}", F.col("r") - F.avg("r").over(date))
        low, high = (F.percentile(F.col(f"excess_h{h}"), F.lit(q)).over(date) for q in s.winsor_pct)
        rows = rows.withColumns({
            f"y_reg_h{h}": clip(F.col(f"excess_h{h}"), low, high),
            f"y_cls_h{h}": F.when(F.col(f"excess_h{h}").isNotNull(), (F.col(f"excess_h{h}") > 0).cast("double")),
            f"rank_pct_h{h}": pct_rank("r", "date"),
        })
    return rows.select(*label_columns(s.horizons))


def thin_dates(labels: DataFrame, universe: DataFrame, horizon: int, min_names: int) -> DataFrame:
    """Dates with fewer labelled eligible names than a cross-section needs (0 included)."""
    rows = labels.join(universe.select("ticker", "date", "eligible"), ["ticker", "date"])
    n = F.count_if(F.col("eligible") & F.col(f"has_label_h{horizon}")).alias("n_valid")
    return rows.groupBy("date").agg(n).where(F.col("n_valid") < min_names)
