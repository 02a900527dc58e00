"""Queries of the evaluation and strategy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.functions.exprs import pct_rank
from barleaf.operators import calendar, evaluate, folds, models, strategy
from barleaf.operators.features import market
from barleaf.operators.features.registry import SPECS
from barleaf.plans.panel import CONFIG, FULL, LN, YEAR, Panel
from barleaf.plans.queries import _D, _RETS, _VOL, made_features, query, r8
from barleaf.sources.tables import written

RULES = strategy.PortfolioRules(0.3, 3, 6)


def scored(p: Panel) -> DataFrame:
    """ticker, date, t_idx, eligible, the 21-row return reversed as score, and the label."""
    rows = p.stock("ret_21").select("ticker", "date", "t_idx", "eligible", (-F.col("ret_21")).alias("score"))
    return rows.join(p.labels.select("ticker", "date", "excess_h5", "y_cls_h5"), ["ticker", "date"])


_USED = f"used as (select j.ticker, j.date, j.t_idx, -x as score, l.excess_h5 as y, l.y_cls_h5 as cls from (select *, {_RETS['ret_21']} as x from joined) j join labels_t l on j.ticker = l.ticker and j.date = l.date where j.eligible and x is not null and l.excess_h5 is not null)"
_RANKS = "ranked as (select *, rank() over (partition by date order by score) + (count(*) over (partition by date, score) - 1) / 2e0 as a, rank() over (partition by date order by y) + (count(*) over (partition by date, y) - 1) / 2e0 as b, count(*) over (partition by date) as n from used)"
_IC = "ics as (select date, t_idx, count(*) as n_names, covar_samp(a, b) / sqrt(var_samp(a) * var_samp(b)) as ic from ranked group by 1, 2 having count(*) >= 5)"


def with_ics(final: str) -> str:
    return f", {_USED}, {_RANKS}, {_IC} {final}"


def ics(p: Panel) -> DataFrame:
    return evaluate.rank_ic(scored(p), "score", "excess_h5", 5)


@query(with_ics("select date, t_idx, n_names, round(ic, 8) as ic from ics"), "joined", "labels_t")
def rank_ic(p: Panel) -> DataFrame:
    return ics(p).select("date", "t_idx", "n_names", r8("ic"))


@query(
    with_ics("select round(avg(ic), 8) as mean, round(stddev_samp(ic), 8) as std, round(avg(cast(ic > 0 as double)), 8) as hit_rate, count(*) as effective_n, round(avg(ic) / (stddev_samp(ic) / sqrt(count(*))), 6) as t_stat from ics where t_idx >= 252 and (t_idx - 252) % 5 = 0"),
    "joined", "labels_t",
)
def ic_summary(p: Panel) -> DataFrame:
    out = evaluate.series_summary(evaluate.non_overlapping(ics(p), 252, 5))
    return out.select(r8("mean"), r8("std"), r8("hit_rate"), "effective_n", r8("t_stat", 6))


_LAGS = 5
_GAMMA = ", ".join(f"coalesce(sum(d * lag{k}), 0) as g{k}" for k in range(_LAGS + 1))
_NW = " + ".join(f"{2 * (1 - k / (_LAGS + 1))!r}e0 * g{k}" for k in range(1, _LAGS + 1))


@query(
    with_ics(f"""select round(mean, 8) as mean, round(se, 8) as se, round(mean / nullif(se, 0), 6) as t_stat, effective_n from (
  select mean, sqrt(greatest(g0 + {_NW}, 0)) / nullif(effective_n, 0) as se, effective_n from (
    select first(m) as mean, count(*) as effective_n, {_GAMMA} from (
      select m, d, d as lag0, {", ".join(f"lag(d, {k}) over (order by date) as lag{k}" for k in range(1, _LAGS + 1))} from (select date, avg(ic) over () as m, ic - avg(ic) over () as d from ics))))"""),
    "joined", "labels_t",
)
def newey_west(p: Panel) -> DataFrame:
    out = evaluate.newey_west(ics(p), "ic", _LAGS)
    return out.select(r8("mean"), r8("se"), r8("t_stat", 6), "effective_n")


@query(
    f""", {_USED}, {_RANKS} select date, t_idx, count(*) as n_names, round(avg(case when a / n >= 0.8 then y end), 8) as top, round(avg(case when a / n <= 0.2 then y end), 8) as bottom,
round(avg(case when a / n >= 0.9 then y end), 8) as top_decile, round(avg(case when a / n >= 0.8 then y end) - avg(case when a / n <= 0.2 then y end), 8) as spread from ranked group by 1, 2 having count(*) >= 5""",
    "joined", "labels_t",
)
def quantile_spread(p: Panel) -> DataFrame:
    out = evaluate.quantile_spread(scored(p), "score", "excess_h5", min_names=5)
    return out.select("date", "t_idx", "n_names", *map(r8, ("top", "bottom", "top_decile", "spread")))


@query(
    f""", {_USED}, pooled as (select score, cls, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2e0 as r from used)
select round((sum(case when cls > 0 then r end) - max(pos) * (max(pos) + 1) / 2e0) / (cast(max(pos) as double) * max(neg)), 8) as auc, cast(max(pos) as bigint) as n_pos, cast(max(neg) as bigint) as n_neg from pooled, (select count(*) filter (where cls > 0) as pos, count(*) filter (where cls <= 0) as neg from used)""",
    "joined", "labels_t",
)
def pooled_auc(p: Panel) -> DataFrame:
    return evaluate.auc(scored(p), "score", "y_cls_h5", 8).select(r8("auc"), "n_pos", "n_neg")


@query(
    f""", mf as (select date, {LN('mkt_index', f"({FULL('avg', 'mkt_index', 200, _D)})")} as trend, ({FULL('stddev_samp', 'mkt_logret', 21, _D)}) * {YEAR} as vol from mkt),
h as (select a.date, case when count(*) >= 60 then (count(*) filter (where b.vol < a.vol) + (count(*) filter (where b.vol = a.vol) + 1) / 2e0) / count(*) end as pct from mf a join mf b on b.date <= a.date and b.vol is not null where a.vol is not null group by 1)
select mf.date, case when trend > 0 then 'up' when trend is not null then 'down' end as regime_trend, case when pct < 1 / 3e0 then 'low' when pct > 2 / 3e0 then 'high' when pct is not null then 'mid' end as regime_vol,
case when trend > 0 then 'up' when trend is not null then 'down' end || '_' || case when pct < 1 / 3e0 then 'low' when pct > 2 / 3e0 then 'high' when pct is not null then 'mid' end as regime from mf left join h on mf.date = h.date""",
    "mkt",
)
def regimes(p: Panel) -> DataFrame:
    return evaluate.regimes(market.market_features(p.market), 60)


@query(
    f""", v as (select ticker, date, ({_VOL['vol_63']}) as x, eligible from joined) select ticker, date, round((rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2e0) / count(x) over (partition by date), 8) as vol_pct
from v where eligible and x is not null union all select ticker, date, null from v where eligible and x is null""",
    "joined",
)
def vol_percentile(p: Panel) -> DataFrame:
    return strategy.vol_percentile(p.stock("vol_63")).select("ticker", "date", r8("vol_pct"))


#: The largest reversed returns of each rebalance date.
_REVERSAL = f"""s as (select j.ticker, j.t_idx, -x as score from (select *, {_RETS['ret_21']} as x from joined) j where j.eligible and x is not null and j.t_idx >= 252 and (j.t_idx - 252) % 20 = 0),
r as (select *, least(greatest(cast(round_even(count(*) over (partition by t_idx) * 0.3e0, 0) as integer), 3), 6) as n, row_number() over (partition by t_idx order by score desc, ticker) as place from s)"""


def picks(p: Panel) -> DataFrame:
    dates = calendar.rebalance_dates(p.calendar, CONFIG.backtest)
    return strategy.top_weights(scored(p), dates, "score", "reversal", RULES)


@query(
    f""", {_REVERSAL}
select 'reversal' as model_id, t_idx, ticker, 1e0 / n as weight from r where place <= n""",
    "joined",
)
def top_n_weights(p: Panel) -> DataFrame:
    return picks(p)


@query(
    """, s as (select ticker, t_idx, count(*) over (partition by t_idx) as n from joined where eligible and t_idx >= 252 and (t_idx - 252) % 20 = 0)
select 'equal_weight' as model_id, t_idx, ticker, 1e0 / n as weight from s""",
    "joined",
)
def equal_weights(p: Panel) -> DataFrame:
    return strategy.equal_weights(p.joined, calendar.rebalance_dates(p.calendar, CONFIG.backtest))


_RANKED = "case when rk >= 0.8 then '{0}' when rk <= 0.2 then '{1}' else '{2}' end"


@query(
    f""", s as (select j.ticker, j.date, -x as score from (select *, {_RETS['ret_21']} as x from joined) j where j.eligible and x is not null and j.t_idx >= 252 and (j.t_idx - 252) % 20 = 0),
r as (select *, (rank() over (partition by date order by score) + (count(*) over (partition by date, score) - 1) / 2e0) / count(*) over (partition by date) as rk from s)
select date, ticker, {_RANKED.format('BUY', 'AVOID', 'NEUTRAL')} as signal, {_RANKED.format('ENTRY_RANK,GATE_BYPASSED_BASELINE', 'AVOID_RANK', 'MIDDLE_RANK')} as reasons from r""",
    "joined",
)
def stateless_signals(p: Panel) -> DataFrame:
    """Signals of a baseline score with nothing held, on rebalance dates."""
    dates = calendar.rebalance_dates(p.calendar, CONFIG.backtest)
    rows = p.stock("ret_21").where("eligible and ret_21 is not null").join(dates.select("t_idx"), "t_idx").withColumn("score", -F.col("ret_21"))
    rows = rows.select("date", "ticker", "eligible", F.lit(False).alias("held"), pct_rank("score", "date").alias("rank_pct"), F.col("score").alias("pred_excess"), F.lit(None).cast("double").alias("prob_cal"), F.lit(0.5).alias("base_rate"), F.lit(None).cast("double").alias("vol_pct"), F.lit(False).alias("units_are_returns"))
    return strategy.signals(rows).select("date", "ticker", "signal", F.concat_ws(",", "reason_codes").alias("reasons"))


_SIGNALLED = f""", s as (
  select j.ticker, j.date, j.eligible, case when j.eligible then -x end as score from (select *, {_RETS['ret_21']} as x from joined) j where j.t_idx >= 252 and (j.t_idx - 252) % 20 = 0),
r as (select *, case when score is not null then (rank() over (partition by date, score is null order by score) + (count(*) over (partition by date, score) - 1) / 2e0) / count(score) over (partition by date) end as rk from s),
e as (select *, case when eligible and rk >= 0.8 then true when not eligible or rk < 0.5 then false end as event from r),
h as (select *, coalesce(last_value(event ignore nulls) over (partition by ticker order by date rows between unbounded preceding and 1 preceding), false) as held from e)"""


@query(
    _SIGNALLED + """ select * from (select date, ticker, held, case when held and not eligible then 'SELL' when held and rk is null then 'HOLD' when held and rk < 0.5 then 'SELL' when held then 'HOLD' when not eligible then null
when rk >= 0.8 then 'BUY' when rk <= 0.2 then 'AVOID' else 'NEUTRAL' end as signal from h) where signal is not null""",
    "joined",
)
def stateful_signals(p: Panel) -> DataFrame:
    """Signals of a baseline score on rebalance dates, with what was bought before held."""
    dates = calendar.rebalance_dates(p.calendar, CONFIG.backtest)
    rows = p.stock("ret_21").join(dates.select("t_idx"), "t_idx").withColumn("score", F.when(F.col("eligible"), -F.col("ret_21")))
    rows = rows.select("date", "ticker", "eligible", pct_rank("score", "date").alias("rank_pct"), F.col("score").alias("pred_excess"), F.lit(None).cast("double").alias("prob_cal"), F.lit(0.5).alias("base_rate"), F.lit(None).cast("double").alias("vol_pct"), F.lit(False).alias("units_are_returns"))
    return strategy.signals(strategy.with_held(rows)).select("date", "ticker", "held", "signal")


@query(f", {_USED} select round(avg(abs(y - score)), 8) as mae, round(1 - sum((y - score) * (y - score)) / sum(y * y), 6) as r2_zero, count(distinct date) as effective_n from used", "joined", "labels_t")
def fit_metrics(p: Panel) -> DataFrame:
    return evaluate.fit_metrics(scored(p), "score", "excess_h5").select(r8("mae"), r8("r2_zero", 6), "effective_n")


#: The percent rank of the score by date, as if it were a probability.
_PROBS = f"{_USED}, {_RANKS}, probs as (select a / n as prob, cls from ranked)"


def with_probs(p: Panel) -> DataFrame:
    rows = evaluate.usable(scored(p), "score", "excess_h5")
    return rows.withColumn("prob", pct_rank("score", "date"))


@query(
    f""", {_PROBS}, c as (select cls, prob, least(greatest(prob, 1e-15), 1 - 1e-15) as q from probs)
select round(avg(-(cls * ln(q) + (1 - cls) * ln(1 - q))), 8) as log_loss, round(avg((prob - cls) * (prob - cls)), 8) as brier, count(*) as n_rows from c""",
    "joined", "labels_t",
)
def probability_metrics(p: Panel) -> DataFrame:
    return evaluate.probability_metrics(with_probs(p), "prob", "y_cls_h5").select(r8("log_loss"), r8("brier"), "n_rows")


_BINS = f""", {_PROBS}, edges as (select {", ".join(f"quantile_cont(prob, {i / 10}) as e{i}" for i in range(1, 10))} from probs),
bins as (select {" + ".join(f"cast(e{i} < prob as integer)" for i in range(1, 10))} as bin, prob, cls from probs, edges),
binned as (select bin, count(*) as n_rows, avg(prob) as mean_prob, avg(cls) as rate from bins group by 1)"""


@query(f"{_BINS} select bin, n_rows, {', '.join(f'round({c}, 8) as {c}' for c in ('mean_prob', 'rate'))} from binned", "joined", "labels_t")
def reliability_table(p: Panel) -> DataFrame:
    return evaluate.reliability(with_probs(p), "prob", "y_cls_h5").select("bin", "n_rows", r8("mean_prob"), r8("rate"))


@query(f"{_BINS} select round(sum(abs(mean_prob - rate) * n_rows) / sum(n_rows), 8) as ece from binned", "joined", "labels_t")
def calibration_error(p: Panel) -> DataFrame:
    return evaluate.expected_calibration_error(evaluate.reliability(with_probs(p), "prob", "y_cls_h5")).select(r8("ece"))


@query(
    f"select ticker, date, eligible, round({_RETS['mom_12_1']}, 8) as baseline_mom12_1, round(-({_RETS['ret_21']}), 8) as baseline_rev21, round(-({_VOL['vol_63']}), 8) as baseline_lowvol, true as random_in_range from joined",
    "joined",
)
def baseline_scores(p: Panel) -> DataFrame:
    """The scores that need no fitting; of the seeded random one, whether it lies in [0, 1)."""
    out = evaluate.baseline_scores(p.stock("mom_12_1", "ret_21", "vol_63"))
    return out.select("ticker", "date", "eligible", r8("baseline_mom12_1"), r8("baseline_rev21"), r8("baseline_lowvol"), F.col("baseline_random").between(0, 1 - 2**-53).alias("random_in_range"))


@query("select 'market' as model_id, date, round(mkt_index / max(mkt_index) over (order by date rows between unbounded preceding and current row) - 1, 8) as drawdown from mkt where mkt_index is not null", "mkt")
def market_drawdown(p: Panel) -> DataFrame:
    rows = p.market.where("mkt_index is not null").select(F.lit("market").alias("model_id"), "date", F.col("mkt_index").alias("nav"))
    return evaluate.drawdowns(rows).select("model_id", "date", r8("drawdown"))


#: The simulation by SQL: state (cash, shares by ticker) from fill to fill by recursion, then marked on every day.
_PRODUCT = "coalesce(list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1] * z[2])), 0e0)"
_EQUITY = f""", {_REVERSAL},
w as (
  select 'reversal' as model_id, t_idx, ticker, 1e0 / n as weight from r where place <= n
  union all
  select 'equal_weight', t_idx, ticker, 1e0 / count(*) over (partition by t_idx) from joined where eligible and t_idx >= 252 and (t_idx - 252) % 20 = 0),
final_day as (select max(t_idx) as t from adjusted),
names as (select distinct ticker from adjusted),
decided as (
  select model_id, t_idx, row_number() over (partition by model_id order by t_idx) as i
  from (select distinct model_id, t_idx from w) where t_idx < (select t from final_day)),
fills as (
  select d.model_id, d.i, d.t_idx + 1 as day, list(coalesce(a.adj_open, 1e0) order by n.ticker) as price, list(coalesce(w.weight, 0e0) order by n.ticker) as weight
  from decided d cross join names n left join adjusted a on a.ticker = n.ticker and a.t_idx = d.t_idx + 1
  left join w on w.model_id = d.model_id and w.ticker = n.ticker and w.t_idx = d.t_idx group by 1, 2, 3),
marks as (
  select c.t_idx, c.date, list(coalesce(a.adj_close, 0e0) order by n.ticker) as price
  from cal c cross join names n left join adjusted a on a.ticker = n.ticker and a.t_idx = c.t_idx where c.t_idx >= 252 group by 1, 2),
held as (
  with recursive st as (
    select model_id, cast(0 as bigint) as i, 252 as day, 1e6 as cash, list_transform(price, lambda x: 0e0) as shares, 0e0 as turnover, 0e0 as cost from fills where i = 1
    union all
    select model_id, i, day, cash - wanted * scale * 1.0005e0,
           list_transform(list_zip(shares, trade, price, weight), lambda z: case when z[4] = 0 then 0e0 else z[1] + (case when z[2] > 0 then z[2] * scale else z[2] end) / z[3] end),
           (sold + wanted * scale) / value, 0.0005e0 * (sold + wanted * scale)
    from (
      select *, case when wanted > 0 then least(1e0, greatest(0e0, cash) / (wanted * 1.0005e0)) else 1e0 end as scale from (
        select model_id, i, day, shares, price, weight, value, trade, sold, wanted, cash + sold * 0.9995e0 as cash from (
          select *, -coalesce(list_sum(list_filter(trade, lambda x: x < 0)), 0e0) as sold, coalesce(list_sum(list_filter(trade, lambda x: x > 0)), 0e0) as wanted from (
            select *, list_transform(list_zip(weight, shares, price), lambda z: z[1] * value - z[2] * z[3]) as trade from (
              select f.model_id, f.i, f.day, f.price, f.weight, st.cash, st.shares, st.cash + {_PRODUCT.format('st.shares', 'f.price')} as value
              from st join fills f on f.model_id = st.model_id and f.i = st.i + 1))))))
  select *, lead(day) over (partition by model_id order by i) as until from st),
marked as (
  select h.model_id, m.date, m.t_idx, m.t_idx = (select t from final_day) as is_final, h.cash, {_PRODUCT.format('h.shares', 'm.price')} as worth, len(list_filter(h.shares, lambda x: x > 0)) as n_held,
         case when m.t_idx = h.day then turnover else 0e0 end as turnover, case when m.t_idx = h.day then cost else 0e0 end as cost
  from held h join marks m on m.t_idx >= h.day and (h.until is null or m.t_idx < h.until)),
navs as (
  select model_id, date, t_idx, case when is_final then cash + worth * 0.9995e0 else cash end as cash, case when is_final then cash + worth * 0.9995e0 else cash + worth end as nav,
         cast(case when is_final then 0 else n_held end as integer) as n_holdings, turnover, case when is_final then cost + 0.0005e0 * worth else cost end as cost
  from marked),
eq as (select *, coalesce(nav / lag(nav) over (partition by model_id order by t_idx) - 1, 0e0) as ret from navs)"""


def equity(p: Panel) -> DataFrame:
    weights = picks(p).unionByName(strategy.equal_weights(p.joined, calendar.rebalance_dates(p.calendar, CONFIG.backtest)))
    prices = p.adjusted.select("ticker", "date", "t_idx", "adj_open", "adj_close")
    return strategy.simulate(prices, weights, start=252)


@query(
    _EQUITY + " select model_id, date, t_idx, round(nav, 2) as nav, round(ret, 8) as ret, round(cash, 2) as cash, n_holdings, round(turnover, 8) as turnover, round(cost, 4) as cost from eq",
    "joined",
)
def simulated_equity(p: Panel) -> DataFrame:
    return equity(p).select("model_id", "date", "t_idx", r8("nav", 2), r8("ret"), r8("cash", 2), "n_holdings", r8("turnover"), r8("cost", 4))


@query(
    _EQUITY + """, dd as (select model_id, min(d) as max_drawdown from (select model_id, nav / max(nav) over (partition by model_id order by date rows between unbounded preceding and current row) - 1 as d from eq) group by 1),
k as (select model_id, count(*) as n_days, pow(arg_max(nav, date) / arg_min(nav, date), 252e0 / count(*)) - 1 as cagr, avg(ret) as m, stddev_samp(ret) as s, sqrt(avg(case when ret < 0 then ret * ret else 0 end)) as d, avg(cast(ret > 0 as double)) as hit_rate from eq group by 1)
select k.model_id, n_days, round(cagr, 6) as cagr, round(s * sqrt(252e0), 6) as volatility, round(m / nullif(s, 0) * sqrt(252e0), 6) as sharpe, round(m / nullif(d, 0) * sqrt(252e0), 6) as sortino,
round(max_drawdown, 6) as max_drawdown, round(cagr / nullif(abs(max_drawdown), 0), 6) as calmar, round(hit_rate, 6) as hit_rate from k join dd on k.model_id = dd.model_id""",
    "joined",
)
def equity_performance(p: Panel) -> DataFrame:
    out = evaluate.performance(equity(p))
    return out.select("model_id", "n_days", *(r8(c, 6) for c in ("cagr", "volatility", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate")))


@query(
    _EQUITY + """, k as (
  select e.model_id, count(*) as n_days, stddev_samp(e.ret - b.ret) * sqrt(252e0) as te, avg(e.ret - b.ret) * 252 as gain, covar_samp(e.ret, b.ret) / nullif(var_samp(b.ret), 0) as beta, avg(e.ret) as m, avg(b.ret) as mb, sum(e.turnover) as turnover, sum(e.cost) / avg(e.nav) as cost
  from eq e join eq b on e.date = b.date and b.model_id = 'equal_weight' group by 1)
select model_id, n_days, round(te, 6) as tracking_error, round(gain / nullif(te, 0), 6) as information_ratio, round(beta, 6) as beta, round((m - beta * mb) * 252, 6) as alpha, round(turnover * 252e0 / n_days, 6) as turnover_year, round(cost * 252e0 / n_days, 6) as cost_year from k""",
    "joined",
)
def relative_performance(p: Panel) -> DataFrame:
    out = evaluate.relative_performance(equity(p), "equal_weight")
    return out.select("model_id", "n_days", *(r8(c, 6) for c in ("tracking_error", "information_ratio", "beta", "alpha", "turnover_year", "cost_year")))


# --- models: matrices are solved on the driver, which has no SQL form; tests/test_models.py holds them against NumPy


def model_inputs(p: Panel) -> tuple[DataFrame, DataFrame, list[str]]:
    """The model table with labels, the development folds, and the stock features."""
    rows = written(p.labels.join(made_features(p).model.drop("eligible"), ["ticker", "date"]).join(p.universe.select("ticker", "date", "eligible"), ["ticker", "date"]).join(p.calendar.select("date", "t_idx"), "date"), "model")
    names = [n for n, spec in SPECS.items() if spec.level == "stock"]
    return rows, folds.as_table(p.spark, folds.dev_folds(CONFIG, calendar.TradingCalendar.of(p.calendar))), names


@query()
def walkforward_predictions(p: Panel) -> DataFrame:
    """Ridge and calibrated logistic predictions of every test block."""
    rows, blocks, names = model_inputs(p)
    return models.walk_forward(rows, blocks, names, "y_reg_h5", "y_cls_h5").predictions


@query()
def permutation_importance(p: Panel) -> DataFrame:
    """The drop of the ridge model's rank IC by feature family."""
    rows, blocks, names = model_inputs(p)
    families: dict[str, list[str]] = {}
    for n in names:
        families.setdefault(SPECS[n].family, []).append(n)
    return models.permutation_importance(rows, blocks, models.ridge(rows, blocks, names, "y_reg_h5", [100.0])[100.0], families, "excess_h5", least_names=5, every=5)
