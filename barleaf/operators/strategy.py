"""Signals, portfolio construction and the simulation (specified stages, like ``evaluate``).

Signals and selection are columns over one date's cross-section. The simulation
carries cash and shares from day to day, which no window can express: it is a
grouped map, one task for each model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.errors import StageError
from barleaf.functions.exprs import pct_rank


@dataclass(frozen=True)
class SignalRules:
    r_enter: float = 0.8
    r_exit: float = 0.5
    r_avoid: float = 0.2
    kappa: float = 1.0
    cost_bps_per_side: float = 5.0
    cost_hurdle: bool = True
    prob_gate: bool = False
    prob_margin: float = 0.0
    vol_veto: bool = False
    max_vol_pct: float = 0.9


@dataclass(frozen=True)
class PortfolioRules:
    top_fraction: float = 0.2
    min_n: int = 10
    max_n: int = 25


def or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def gates(r: SignalRules) -> tuple[Column, ...]:
    """Whether costs, probability and volatility allow an entry (probability also asks for an exit: third), and whether the rank enters or leaves."""
    units, on = F.col("units_are_returns"), F.lit
    cost_ok = or_false(~(on(r.cost_hurdle) & units) | (F.col("pred_excess") >= r.kappa * 2 * r.cost_bps_per_side / 1e4))
    prob_ok = or_false(~(on(r.prob_gate) & units) | (F.col("prob_cal") >= F.col("base_rate") + r.prob_margin))
    prob_out = or_false(on(r.prob_gate) & units & (F.col("prob_cal") < F.col("base_rate") - r.prob_margin))
    vol_ok = or_false(~on(r.vol_veto) | (F.col("vol_pct") <= r.max_vol_pct))
    return cost_ok, prob_ok, prob_out, vol_ok, or_false(F.col("rank_pct") >= r.r_enter), or_false(F.col("rank_pct") < r.r_exit)


def with_held(rows: DataFrame, rules: SignalRules | None = None) -> DataFrame:
    """``rows`` (those of ``signals`` but for held) with held: whether the name was bought on a date before and not sold since.

    What enters and what leaves exclude each other, so the state is the last of
    these events of a ticker, whatever held was: one window and no loop. That
    holds while every signal is carried out; where a portfolio's size leaves some
    out, the state comes from ``simulate``'s positions instead.
    """
    r = rules or SignalRules()
    cost_ok, prob_ok, prob_out, vol_ok, enters, leaves = gates(r)
    live, known = F.col("eligible"), F.col("rank_pct").isNotNull()
    event = F.when(live & enters & cost_ok & prob_ok & vol_ok, True).when(~live | (known & (leaves | prob_out)), False)
    past = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__event", event).withColumn("held", or_false(F.last("__event", True).over(past))).drop("__event")


def signals(rows: DataFrame, rules: SignalRules | None = None) -> DataFrame:
    """Adds signal and reason_codes. rows: eligible, held, rank_pct, pred_excess, prob_cal, base_rate, vol_pct, units_are_returns.

    Without return units the cost hurdle and the probability gate are bypassed.
    """
    r = rules or SignalRules()
    cost_ok, prob_ok, prob_out, vol_ok, enters, leaves = gates(r)
    units, yes = F.col("units_are_returns"), or_false
    rank, held, live = F.col("rank_pct"), F.col("held"), F.col("eligible")
    signal = (
        F.when(held & ~live, "SELL").when(held & rank.isNull(), "HOLD").when(held & (leaves | prob_out), "SELL").when(held, "HOLD")
        .when(~live, None).when(enters & cost_ok & prob_ok & vol_ok, "BUY").when(yes(rank <= r.r_avoid), "AVOID").otherwise("NEUTRAL")
    )
    new, kept = live & ~held & enters, held & live & rank.isNotNull()
    codes = F.array_compact(F.array(
        F.when(held & ~live, F.lit("EXIT_INELIGIBLE")), F.when(live & rank.isNull(), F.lit("NO_PREDICTION")), F.when(kept & leaves, F.lit("EXIT_RANK")), F.when(kept & prob_out, F.lit("EXIT_PROB")),
        F.when(kept & ~leaves & ~prob_out, F.lit("HOLD_RANK")), F.when(new, F.lit("ENTRY_RANK")),
        F.when(new & cost_ok & units & r.cost_hurdle, F.lit("ENTRY_COST_OK")), F.when(new & ~cost_ok, F.lit("BLOCKED_COST")),
        F.when(new & prob_ok & units & r.prob_gate, F.lit("ENTRY_PROB_OK")), F.when(new & ~prob_ok, F.lit("BLOCKED_PROB")),
        F.when(new & vol_ok & r.vol_veto, F.lit("VOL_OK")), F.when(new & ~vol_ok, F.lit("BLOCKED_VOL")),
        F.when(live & ~held & yes(rank <= r.r_avoid), F.lit("AVOID_RANK")), F.when(new & ~units & (r.cost_hurdle or r.prob_gate), F.lit("GATE_BYPASSED_BASELINE")),
        F.when(live & ~held & yes((rank < r.r_enter) & (rank > r.r_avoid)), F.lit("MIDDLE_RANK")),
    ))
    return rows.withColumns({"signal": signal, "reason_codes": codes}).where("signal is not null")


def vol_percentile(raw: DataFrame) -> DataFrame:
    """ticker, date, vol_pct: percent rank of vol_63 among eligible names."""
    return raw.where("eligible").select("ticker", "date", pct_rank("vol_63", "date").alias("vol_pct"))


def target_size(n, rules: PortfolioRules):
    """Names to hold of n: half-even rounding, between the bounds."""
    return F.least(F.greatest(F.bround(n * rules.top_fraction, 0).cast("int"), F.lit(rules.min_n)), F.lit(rules.max_n))


def select_names(signalled: DataFrame, rules: PortfolioRules | None = None) -> DataFrame:
    """Adds n_target, weight and final_action. signalled: date, ticker, eligible, held, rank_pct, signal. What is not filled stays cash."""
    r = rules or PortfolioRules()
    date = Window.partitionBy("date")
    candidate = F.col("signal").isin("BUY", "HOLD")
    rows = signalled.withColumn("n_target", target_size(F.count_if(F.col("eligible") & F.col("rank_pct").isNotNull()).over(date), r))
    place = F.row_number().over(Window.partitionBy("date", candidate).orderBy(F.desc_nulls_last("rank_pct"), "ticker"))
    kept = candidate & (F.col("place") <= F.col("n_target"))
    action = F.when(kept & F.col("held"), "HOLD").when(kept, "BUY").when(candidate & F.col("held"), "SELL").when(candidate, "SKIP_CAPACITY").when(F.col("signal") == "SELL", "SELL")
    return rows.withColumn("place", place).withColumns({"weight": F.when(kept, 1.0 / F.col("n_target")).otherwise(0.0), "final_action": action}).drop("place")


EQUITY = "model_id string, date date, t_idx int, nav double, ret double, cash double, n_holdings int, turnover double, cost double"


def simulate(prices: DataFrame, weights: DataFrame, *, capital: float = 1e6, cost_bps: float = 5.0, fill: str = "next_open", start: int = 0, end: int | None = None, liquidate: bool = True) -> DataFrame:
    """EQUITY by model. prices: ticker, date, t_idx, adj_open, adj_close; weights: model_id, t_idx (decision), ticker, weight.

    Fills on the day after the decision at the open (``delay1_open``: one day
    later; ``next_close``: at its close). Sells come first; buys are scaled so
    that cash stays at or above 0. A model's task gets the prices of the names
    that it ever holds, from ``start`` on: names held x days.
    """
    delay, at = {"next_open": (1, "adj_open"), "delay1_open": (2, "adj_open"), "next_close": (1, "adj_close")}[fill]
    rate, columns = cost_bps / 1e4, [c.split()[0] for c in EQUITY.split(", ")]
    # one row for each trading day comes to the driver
    days = sorted((r.t_idx, r.date) for r in prices.select("t_idx", "date").distinct().collect())
    last = min(end, days[-1][0]) if end is not None and days else days[-1][0] if days else -1
    days = [d for d in days if start <= d[0] <= last]

    def run(key: tuple, own: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        if not days:
            return pd.DataFrame(columns=columns)
        names = sorted(set(own["ticker"]))
        on = lambda c: px.pivot(index="t_idx", columns="ticker", values=c).reindex(index=[t for t, _ in days], columns=names).to_numpy("f8")
        close, fills = on("adj_close"), on(at)
        decided = own[(own["t_idx"] >= start) & (own["t_idx"] < last)]
        pending = {int(t) + delay: g.set_index("ticker")["weight"].reindex(names).fillna(0.0).to_numpy() for t, g in decided.groupby("t_idx")}
        cash, shares, before, out = capital, np.zeros(len(names)), None, []
        for i, (d, date) in enumerate(days):
            turnover = cost = 0.0
            if d in pending:
                price, weight = fills[i], pending[d]
                if np.isnan(price[(shares != 0) | (weight != 0)]).any():
                    raise StageError(f"{key[0]}: no price on fill day {d}")
                price = np.nan_to_num(price, nan=1.0)
                value = cash + shares @ price
                trade = weight * value - shares * price
                sold = -trade[trade < 0].sum()
                cash += sold * (1 - rate)
                wanted = trade[trade > 0].sum()
                scale = min(1.0, max(0.0, cash) / (wanted * (1 + rate))) if wanted else 1.0
                trade = np.where(trade > 0, trade * scale, trade)
                bought = wanted * scale
                cash -= bought * (1 + rate)
                shares = np.where(weight == 0, 0.0, shares + trade / price)
                turnover, cost = (sold + bought) / value, rate * (sold + bought)
            mark = np.nan_to_num(close[i])
            if d == last and liquidate:
                sold = shares @ mark
                cash, shares, cost = cash + sold * (1 - rate), np.zeros(len(names)), cost + rate * sold
            nav = cash + shares @ mark
            out.append((key[0], date, d, nav, nav / before - 1 if before else 0.0, cash, int((shares > 0).sum()), turnover, cost))
            before = nav
        return pd.DataFrame(out, columns=columns)

    # renamed and back: weights may come from the same tables as prices
    held = weights.select(F.col("model_id").alias("model"), F.col("ticker").alias("name")).distinct()
    rows = prices.where(F.col("t_idx").between(start, last)).select(*(F.col(c).alias(c) for c in ("ticker", "t_idx", "adj_open", "adj_close"))).join(held, F.col("ticker") == F.col("name")).drop("name")
    return weights.groupBy("model_id").cogroup(rows.groupBy("model")).applyInPandas(run, EQUITY)


def equal_weights(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """The benchmark: every eligible name of a rebalance date, equally."""
    rows = panel.where("eligible").join(dates.select("t_idx"), "t_idx")
    return rows.select(F.lit("equal_weight").alias("model_id"), "t_idx", "ticker", (1.0 / F.count("*").over(Window.partitionBy("t_idx"))).alias("weight"))


def top_weights(scored: DataFrame, dates: DataFrame, score: str, model_id: str, rules: PortfolioRules | None = None) -> DataFrame:
    """The first n_target names by score on each rebalance date, without hysteresis or gates."""
    r = rules or PortfolioRules()
    rows = scored.where(F.col("eligible") & F.col(score).isNotNull()).join(dates.select("t_idx"), "t_idx")
    rows = rows.withColumn("n", target_size(F.count("*").over(Window.partitionBy("t_idx")), r)).withColumn("place", F.row_number().over(Window.partitionBy("t_idx").orderBy(F.desc(score), "ticker")))
    return rows.where("place <= n").select(F.lit(model_id).alias("model_id"), "t_idx", "ticker", (1.0 / F.col("n")).alias("weight"))
