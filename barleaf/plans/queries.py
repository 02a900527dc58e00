"""Every query: a function of (spark, sf_dir) and the SQL that DuckDB runs for the same rows.

Values that both engines compute bit for bit are compared as they are. Sums,
deviations and logarithms differ in the last places and are rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.operators import adjust, calendar, checks, flags, folds, guards, keys, leakage, universe
from barleaf.operators import panel as panels
from barleaf.operators.calendar import TradingCalendar
from barleaf.operators.features import market
from barleaf.operators.features.build import FeatureTables, build_features
from barleaf.plans.panel import BY, CONFIG, FULL, LN, NORMAL, ROLL, YEAR, Panel, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *needs: str):
    def add(f: Callable[[Panel], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Panel(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = oracle(sql, *needs)
        return f

    return add


def r8(c: str, n: int = 8) -> Column:
    return F.round(c, n).alias(c)


def q8(c: str, n: int = 8) -> str:
    return f"round({c}, {n}) as {c}"


# --- bars, calendar, flags


@query("select * from traded_bars", "traded")
def traded_bars(p: Panel) -> DataFrame:
    return p.traded


@query("select * from bars", "bars")
def bronze_bars(p: Panel) -> DataFrame:
    return p.bars


@query("select * from cal", "cal")
def calendar_index(p: Panel) -> DataFrame:
    return p.calendar


@query("select date, t_idx from cal where is_month_first_day", "cal")
def month_first_day(p: Panel) -> DataFrame:
    return p.calendar.where("is_month_first_day").select("date", "t_idx")


@query("select date, t_idx from cal where t_idx >= 252 and (t_idx - 252) % 20 = 0", "cal")
def rebalance_dates(p: Panel) -> DataFrame:
    return calendar.rebalance_dates(p.calendar, CONFIG.backtest)


@query("select cast(year as integer) as year, min(t_idx) as first_idx, max(t_idx) as last_idx, count(*) as n_dates from cal group by 1", "cal")
def year_bounds(p: Panel) -> DataFrame:
    return calendar.year_bounds(p.calendar)


@query("select * from silver", "silver")
def silver_flags(p: Panel) -> DataFrame:
    return p.silver


@query("select ticker, max(n_obs) as n_obs, count(*) as n_rows from silver group by 1", "silver")
def n_obs(p: Panel) -> DataFrame:
    return p.silver.groupBy("ticker").agg(F.max("n_obs").alias("n_obs"), F.count("*").alias("n_rows"))


@query(f"select s.date, s.ticker, prev_close, s.close, {q8('ret_close')}, {q8('ret_adj')}, round(abs(ret_close - ret_adj), 8) as ret_gap from prev join silver s using (ticker, date) where flag_corp_action_suspect", "silver")
def corp_action_events(p: Panel) -> DataFrame:
    return flags.corp_action_events(p.silver).select("date", "ticker", "prev_close", "close", r8("ret_close"), r8("ret_adj"), r8("ret_gap"))


# --- validation

_MISSING = "select '{0}' as \"column\", cast(count(*) filter (where {0} is null) as bigint) as n_missing from bars"


@query(" union all ".join(_MISSING.format(c) for c in flags.BRONZE), "bars")
def check_nulls(p: Panel) -> DataFrame:
    return checks.null_counts(p.bars)


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by 1, 2 having count(*) > 1")
def check_duplicates(p: Panel) -> DataFrame:
    return keys.repeated_keys(p.spark.read.parquet(f"{p.sf_dir}/lineitem.parquet"), ("l_orderkey", "l_linenumber"))


_BAD = "(select ticker, date, open, high * (case when extract(day from date) = 7 then 0.5e0 else 1e0 end) as high, low, close, adj_close, volume from bars)"


@query(
    f"""select ticker, date, unnest(list_filter([case when high < greatest(open, close) then 'high_bounds' end, case when low > least(open, close) then 'low_bounds' end,
    case when high < low then 'high_below_low' end, case when least(open, high, low, close, adj_close) <= 0 then 'not_positive' end, case when volume < 0 then 'negative_volume' end], lambda x: x is not null)) as rule from {_BAD}""",
    "bars",
)
def check_ohlc(p: Panel) -> DataFrame:
    """Bars of every 7th of a month have their high halved first, so that rules break."""
    spoiled = p.bars.withColumn("high", F.col("high") * F.when(F.day("date") == 7, 0.5).otherwise(1.0))
    return checks.ohlc_violations(spoiled)


@query(
    """select s.ticker, count(*) as n_missing, min(c.date) as first_missing from (select ticker, min(date) as a, max(date) as b from traded_bars group by 1) s
join cal c on c.date between s.a and s.b left join traded_bars t on t.ticker = s.ticker and t.date = c.date where t.ticker is null group by 1""",
    "cal",
)
def check_calendar_gaps(p: Panel) -> DataFrame:
    return checks.calendar_gaps(p.traded, p.calendar)


@query("select count(*) as n_rows, count(distinct ticker) as n_tickers, count(distinct date) as n_dates, min(date) as first_date, max(date) as last_date from bars", "bars")
def dataset_counts(p: Panel) -> DataFrame:
    return checks.dataset_counts(p.bars)


@query("select ticker, avg(cast(volume = 0 as double)) as zero_volume_share, count(*) as n_obs from bars group by 1", "bars")
def zero_volume_share(p: Panel) -> DataFrame:
    return checks.zero_volume_share(p.bars)


@query("select cast(year(date) as integer) as year, count(*) filter (where close < 500) as n_tick_noise, count(*) as n_rows from bars group by 1", "bars")
def tick_noise_by_year(p: Panel) -> DataFrame:
    return checks.rows_below_by_year(p.bars, 500.0)


_COUNTS = ", ".join(f"count(*) filter (where {f}) as n_{f[5:]}" for f in flags.FLAGS)


@query(f"select ticker, {_COUNTS}, count(*) as n_rows from silver group by 1", "silver")
def flag_counts_by_ticker(p: Panel) -> DataFrame:
    return checks.flag_totals(p.silver, "ticker")


@query(f"select cast(year(date) as integer) as year, {_COUNTS}, count(*) as n_rows from silver group by 1", "silver")
def flag_counts_by_year(p: Panel) -> DataFrame:
    return checks.flag_totals(p.silver, "year")


@query(f"select cast(year as integer) as year, ticker, {_COUNTS} from (select *, year(date) as year from silver) group by grouping sets ((), (year), (ticker))", "silver")
def flag_counts_all(p: Panel) -> DataFrame:
    return checks.flag_totals_all(p.silver)


@query("select ticker, date, ret from (select ticker, date, close / lag(close) over (partition by ticker order by date) - 1 as ret from bars) where ret is not null order by abs(ret) desc, ticker, date limit 10", "bars")
def top_abs_returns(p: Panel) -> DataFrame:
    return checks.top_moves(p.bars)


@query("select ticker, count(*) filter (where abs(ret) > 0.4) as n_moves from (select ticker, close / lag(close) over (partition by ticker order by date) - 1 as ret from bars) group by 1", "bars")
def large_moves(p: Panel) -> DataFrame:
    return checks.count_moves(p.bars, 0.4)


@query(
    """select count(*) as n_pairs, round(corr(ra, rb), 8) as corr from (select ln(a / lag(a) over (order by date)) as ra, ln(b / lag(b) over (order by date)) as rb from
(select x.date, x.close as a, y.close as b from bars x join bars y on x.date = y.date and x.ticker = 'Brand#4' and y.ticker = 'Brand#5')) where ra is not null and rb is not null""",
    "bars",
)
def pair_return_corr(p: Panel) -> DataFrame:
    return checks.pair_correlation(p.bars, "Brand#4", "Brand#5").select("n_pairs", r8("corr"))


@query(
    """, late as (select * from traded_bars where not (ticker = 'Brand#7' and date > date '2000-06-30'))
select ticker, max(date) as last_date, (select max(date) from late) as panel_last from late group by 1 having max(date) < (select max(date) from late)""",
    "traded",
)
def early_exit_tickers(p: Panel) -> DataFrame:
    """One brand's last months are cut off first, so that a ticker ends early."""
    return checks.early_exits(p.traded.where(~((F.col("ticker") == "Brand#7") & (F.col("date") > "2000-06-30"))))


@query(
    """select coalesce(l.ticker, r.ticker) as ticker, coalesce(l.date, r.date) as date, case when r.ticker is null then 'left' else 'right' end as side
from bars l full join traded_bars r on l.ticker = r.ticker and l.date = r.date where l.ticker is null or r.ticker is null""",
    "bars",
)
def key_mismatch_antijoin(p: Panel) -> DataFrame:
    return keys.key_mismatches(p.bars, p.traded)


@query("select ticker, date, t_idx, step from (select t.ticker, t.date, c.t_idx, c.t_idx - lag(c.t_idx) over (partition by t.ticker order by c.t_idx) as step from traded_bars t join cal c on t.date = c.date) where step <> 1", "cal")
def contiguity_gaps(p: Panel) -> DataFrame:
    return keys.gaps(calendar.with_t_idx(p.traded, p.calendar))


# --- master, universe, prices


@query(f"select * exclude (median_dollar_volume_last_year), {q8('median_dollar_volume_last_year', 2)} from master", "master")
def security_master(p: Panel) -> DataFrame:
    return p.master.withColumn("median_dollar_volume_last_year", F.round("median_dollar_volume_last_year", 2))


@query("select ticker from silver group by 1 except select ticker from curated", "master")
def uncurated_tickers(p: Panel) -> DataFrame:
    return p.silver.select("ticker").distinct().join(p.curated.select("ticker"), "ticker", "left_anti")


@query("select * exclude (median_dollar_volume_63) from universe", "universe")
def universe_eligibility(p: Panel) -> DataFrame:
    return p.universe.drop("median_dollar_volume_63")


@query("select date, count(*) filter (where eligible) as n_eligible, count(*) as n_names from universe group by 1", "universe")
def eligible_per_date(p: Panel) -> DataFrame:
    return universe.eligible_per_date(p.universe)


@query("select min(n) as min_eligible, median(n) as median_eligible, max(n) as max_eligible from (select date, count(*) filter (where eligible) as n from universe group by 1)", "universe")
def universe_summary(p: Panel) -> DataFrame:
    return universe.summary(p.universe)


@query("select ticker, date, median_dollar_volume_63 from uni", "universe")
def median_dollar_volume_63(p: Panel) -> DataFrame:
    return p.silver.select("ticker", "date", universe.median_dollar_volume().alias("median_dollar_volume_63"))


@query("select * exclude (logret_cc) from adjusted", "adjusted")
def adjusted_prices(p: Panel) -> DataFrame:
    return p.adjusted.drop("logret_cc")


@query(f"select ticker, date, {q8('logret_cc')} from adjusted", "adjusted")
def logret_cc(p: Panel) -> DataFrame:
    return p.adjusted.select("ticker", "date", r8("logret_cc"))


@query("select ticker, arg_max(adj_factor, t_idx) as last_factor, abs(arg_max(adj_factor, t_idx) - 1) <= 1e-9 as is_one from adjusted group by 1", "adjusted")
def last_adj_factor(p: Panel) -> DataFrame:
    return adjust.last_factors(p.adjusted)


# --- labels


@query(f"select ticker, date, {', '.join(f'{q8(f"ret_fwd_h{h}")}, label_exit_idx_h{h}, has_label_h{h}' for h in CONFIG.labels.horizons)} from labels_t", "labels_t")
def fwd_returns(p: Panel) -> DataFrame:
    return p.labels.select("ticker", "date", *(c for h in CONFIG.labels.horizons for c in (r8(f"ret_fwd_h{h}"), f"label_exit_idx_h{h}", f"has_label_h{h}")))


@query(f"select ticker, date, {q8('excess_h5')}, y_cls_h5, {q8('excess_h10')}, y_cls_h10 from labels_t", "labels_t")
def excess_labels(p: Panel) -> DataFrame:
    return p.labels.select("ticker", "date", r8("excess_h5"), "y_cls_h5", r8("excess_h10"), "y_cls_h10")


@query(f"select ticker, date, {q8('y_reg_h5')}, {q8('y_reg_h10')} from labels_t", "labels_t")
def winsor_labels(p: Panel) -> DataFrame:
    return p.labels.select("ticker", "date", r8("y_reg_h5"), r8("y_reg_h10"))


@query(f"select ticker, date, {q8('rank_pct_h5')}, {q8('rank_pct_h10')} from labels_t", "labels_t")
def rank_pct_labels(p: Panel) -> DataFrame:
    return p.labels.select("ticker", "date", r8("rank_pct_h5"), r8("rank_pct_h10"))


@query("select l.date, count(*) filter (where eligible and has_label_h5) as n_valid from labels_t l group by 1 having count(*) filter (where eligible and has_label_h5) < 5", "labels_t")
def thin_label_dates(p: Panel) -> DataFrame:
    from barleaf.operators.labels import thin_dates

    return thin_dates(p.labels, p.universe, 5, 5)


# --- features


def ret_sql(k: int) -> str:
    return LN("adj_close", f"lag(adj_close, {k}) over ({BY})")


_RETS = {f"ret_{k}": ret_sql(k) for k in (5, 21, 63, 126, 252)} | {"mom_12_1": LN(f"lag(adj_close, 21) over ({BY})", f"lag(adj_close, 252) over ({BY})")}


def features_sql(columns: dict[str, str], source: str = "joined") -> str:
    return f"select ticker, date, {', '.join(f'round({sql}, 8) as {n}' for n, sql in columns.items())} from {source}"


def feature_columns(p: Panel, *names: str) -> DataFrame:
    return p.stock(*names).select("ticker", "date", *map(r8, names))


@query(features_sql(_RETS), "joined")
def feat_momentum(p: Panel) -> DataFrame:
    return feature_columns(p, *_RETS)


_VOL = {f"vol_{n}": f"({FULL('stddev_samp', 'logret_cc', n)}) * {YEAR}" for n in (21, 63)}
_LOSS = "(case when logret_cc < 0 then logret_cc * logret_cc when logret_cc is not null then 0e0 end)"
_VOLS = _VOL | {"downvol_63": f"sqrt({FULL('avg', _LOSS, 63)}) * {YEAR}", "vol_ratio_21_63": LN(f"({_VOL['vol_21']})", f"({_VOL['vol_63']})")}


@query(features_sql(_VOLS), "joined")
def feat_volatility(p: Panel) -> DataFrame:
    return feature_columns(p, *_VOLS)


_SPAN = "ln(adj_high / adj_low)"


_PARKINSON = f"sqrt(({FULL('avg', f'({_SPAN} * {_SPAN})', 21)}) / (4 * ln(2e0))) * {YEAR}"


@query(features_sql({"parkinson_21": _PARKINSON}), "joined")
def feat_parkinson(p: Panel) -> DataFrame:
    return feature_columns(p, "parkinson_21")


_BOTH = "logret_cc is not null and mkt_logret is not null"
_X, _M = f"case when {_BOTH} then logret_cc end", f"case when {_BOTH} then mkt_logret end"
_W = ROLL(126)


_BETA = f"""case when count(case when {_BOTH} then 1 end) {_W} = 126 and var_samp({_M}) {_W} > 1e-9 * avg(case when {_BOTH} then mkt_logret * mkt_logret end) {_W}
then covar_samp({_X}, {_M}) {_W} / var_samp({_M}) {_W} end"""


@query(features_sql({"beta_126": _BETA}, "(select j.*, m.mkt_logret from joined j join mkt m on j.date = m.date)"), "mkt")
def feat_beta(p: Panel) -> DataFrame:
    return feature_columns(p, "beta_126")


_TREND = {f"px_sma_{n}": LN("adj_close", f"({FULL('avg', 'adj_close', n)})") for n in (50, 200)} | {"dist_52w_high": LN("adj_close", f"({FULL('max', 'adj_close', 252)})")}


@query(features_sql(_TREND), "joined")
def feat_trend(p: Panel) -> DataFrame:
    return feature_columns(p, *_TREND)


_DV = {n: f"({FULL('avg', 'dollar_volume', n)})" for n in (21, 63)}


_LIQUIDITY = {"log_dvol_63": f"case when {_DV[63]} > 0 then ln({_DV[63]}) end", "rel_dvol_21_63": LN(_DV[21], _DV[63])}


@query(features_sql(_LIQUIDITY), "joined")
def feat_liquidity(p: Panel) -> DataFrame:
    return feature_columns(p, "log_dvol_63", "rel_dvol_21_63")


_TRADED = "logret_cc is not null and dollar_volume > 0"
_W63 = ROLL(63)


_AMIHUD = f"""case when count(logret_cc) {_W63} = 63 and count(case when {_TRADED} then 1 end) {_W63} > 0
then ln(1 + 1e6 * sum(case when {_TRADED} then abs(logret_cc) / dollar_volume end) {_W63} / count(case when {_TRADED} then 1 end) {_W63}) end"""


@query(features_sql({"amihud_63": _AMIHUD}), "joined")
def feat_amihud(p: Panel) -> DataFrame:
    return feature_columns(p, "amihud_63")


@query(f"select date, {q8('mkt_logret')}, {q8('mkt_index')}, n_eligible from mkt", "mkt")
def mkt_series(p: Panel) -> DataFrame:
    return p.market.select("date", r8("mkt_logret"), r8("mkt_index"), "n_eligible")


@query(f"select date, round(ln(mkt_index), 8) as log_index from mkt where mkt_index is not null", "mkt")  # noqa: F541
def mkt_index(p: Panel) -> DataFrame:
    return p.market.where("mkt_index is not null").select("date", F.round(F.ln("mkt_index"), 8).alias("log_index"))


_D = "order by date"


@query(
    f"""select date, round({FULL('sum', 'mkt_logret', 21, _D)}, 8) as mkt_ret_21, round({FULL('sum', 'mkt_logret', 63, _D)}, 8) as mkt_ret_63,
round(({FULL('stddev_samp', 'mkt_logret', 21, _D)}) * {YEAR}, 8) as mkt_vol_21, round({LN('mkt_index', f"({FULL('avg', 'mkt_index', 200, _D)})")}, 8) as mkt_trend_200 from mkt""",
    "mkt",
)
def mkt_features(p: Panel) -> DataFrame:
    return market.market_features(p.market).select("date", *map(r8, ("mkt_ret_21", "mkt_ret_63", "mkt_vol_21", "mkt_trend_200")))


@query(
    f"""select date, cast(count(*) filter (where eligible and x > 0) as double) / nullif(cast(count(*) filter (where eligible and x is not null) as double), 0) as mkt_breadth_50
from (select date, eligible, {_TREND['px_sma_50']} as x from joined) group by 1""",
    "joined",
)
def breadth(p: Panel) -> DataFrame:
    return market.cross_section(p.stock("px_sma_50", "ret_21")).select("date", "mkt_breadth_50")


@query(f"select date, round(case when count(x) > 1 then stddev_samp(x) end, 8) as xs_disp_21 from (select date, case when eligible then x end as x from (select date, eligible, ({ret_sql(21)}) as x from joined)) group by 1", "joined")
def dispersion(p: Panel) -> DataFrame:
    return market.cross_section(p.stock("px_sma_50", "ret_21")).select("date", r8("xs_disp_21"))


#: SQL of every stock feature over ``joined`` with ``mkt_logret``, and of the market's over ``mkt``, in registry order.
_STOCK = _RETS | _VOL | {"downvol_63": _VOLS["downvol_63"], "vol_ratio_21_63": _VOLS["vol_ratio_21_63"], "parkinson_21": _PARKINSON, "beta_126": _BETA} | _TREND | _LIQUIDITY | {"amihud_63": _AMIHUD}
_MARKET = {
    "mkt_ret_21": FULL("sum", "mkt_logret", 21, _D), "mkt_ret_63": FULL("sum", "mkt_logret", 63, _D), "mkt_vol_21": f"({FULL('stddev_samp', 'mkt_logret', 21, _D)}) * {YEAR}",
    "mkt_trend_200": LN("mkt_index", f"({FULL('avg', 'mkt_index', 200, _D)})"),
}
_ACROSS = {
    "mkt_breadth_50": "cast(count(*) filter (where eligible and px_sma_50 > 0) as double) / nullif(cast(count(*) filter (where eligible and px_sma_50 is not null) as double), 0)",
    "xs_disp_21": "case when count(case when eligible then ret_21 end) > 1 then stddev_samp(case when eligible then ret_21 end) end",
}


def as_columns(sql: dict[str, str]) -> str:
    return ", ".join(f"{x} as {n}" for n, x in sql.items())


_BY_DATE = ", ".join([*(f"d.{n}" for n in _MARKET), *(f"x.{n}" for n in _ACROSS)])
_RAW = f""", stock as (select ticker, date, t_idx, eligible, {as_columns(_STOCK)} from (select j.*, m.mkt_logret from joined j left join mkt m on j.date = m.date)),
raw as (
  select s.*, {_BY_DATE} from stock s left join (select date, {as_columns(_MARKET)} from mkt) d on s.date = d.date
  left join (select date, {as_columns(_ACROSS)} from stock group by 1) x on s.date = x.date)"""


def _model_sql() -> str:
    """Clipped, ranked and mapped to normal scores by date, over eligible rows."""
    part, e = "partition by date, eligible", "case when eligible then {0} end".format
    clip = ", ".join(f"case when eligible and {n} is not null then least(greatest({n}, quantile_cont({e(n)}, 0.01) over ({part})), quantile_cont({e(n)}, 0.99) over ({part})) end as {n}" for n in _STOCK)
    rank = ", ".join(f"(rank() over ({part}, {n} is null order by {n}) + (count(*) over ({part}, {n}) - 1) / 2e0 - 0.5) / count({n}) over ({part}) as p_{n}" for n in _STOCK)
    keys, rest = "ticker, date, t_idx, eligible", ", ".join([*_MARKET, *_ACROSS])
    scores = ", ".join(f"case when eligible and {n} is not null then {NORMAL(f'p_{n}')} end as {n}" for n in _STOCK)
    return f"{_RAW}, clipped as (select {keys}, {rest}, {clip} from raw), ranks as (select *, {rank} from clipped), model as (select {keys}, {scores}, {rest} from ranks)"


_MODEL = _model_sql()
_FEATURES = [*_STOCK, *_MARKET, *_ACROSS]


def made_features(p: Panel) -> FeatureTables:
    return build_features(p.adjusted, p.universe, checked=False)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r8(c) if t == "double" else c for c, t in df.dtypes))


@query(f"{_RAW} select ticker, date, eligible, {', '.join(map(q8, _FEATURES))} from raw", "mkt")
def features_raw(p: Panel) -> DataFrame:
    return rounded(made_features(p).raw)


@query(f"{_MODEL} select ticker, date, eligible, {', '.join(map(q8, _FEATURES))} from model", "mkt")
def rank_gauss_model(p: Panel) -> DataFrame:
    """The whole model table: all stock features as normal scores, the market's as they are."""
    return rounded(made_features(p).model)


# --- panel, folds, leakage


def lookup(p: Panel) -> TradingCalendar:
    return TradingCalendar.of(p.calendar)


_V, _H = CONFIG.validation, CONFIG.labels.primary_horizon
_LOCK = f"(select min(t_idx) from cal where date >= date '{_V.locked_test_start}')"
_TUNE = f"((select min(t_idx) from cal where date > date '{_V.tuning_end_date}') - {_H + 2})"


def panel_sql(where: str, cap: str) -> str:
    masked = ", ".join(f"round(case when a.t_idx <= {cap} then {s}{_H} end, 8) as {s}{_H}" for s in panels.MASKED)
    return f"""{_MODEL} select a.ticker, a.date, a.t_idx, a.eligible, {', '.join(f'round(a.{n}, 8) as {n}' for n in _FEATURES)}, {masked}, l.label_exit_idx_h{_H}, l.has_label_h{_H} and a.t_idx <= {cap} as has_label_h{_H}
from model a join labels_t l on a.ticker = l.ticker and a.date = l.date where {where}"""


def panel_of_split(p: Panel, split: str) -> DataFrame:
    """All features of the model table, and the labels."""
    return rounded(panels.build_panel(made_features(p).model, p.labels, p.universe, p.calendar, lookup(p), CONFIG, None, split, checked=False))


@query(panel_sql(f"a.t_idx < {_LOCK}", f"({_LOCK} - {_H + 2})"), "mkt", "labels_t")
def panel_dev(p: Panel) -> DataFrame:
    return panel_of_split(p, "dev")


@query(panel_sql(f"a.t_idx <= {_TUNE}", _TUNE), "mkt", "labels_t")
def panel_tuning(p: Panel) -> DataFrame:
    return panel_of_split(p, "tuning")


_GAP = _H + 1 + _V.embargo_days


_BLOCKS = f""", blocks as (
  select 'dev_' || y.year as fold_id, role, c.t_idx
  from (select year, min(t_idx) as a, max(t_idx) as b from cal where year in ({', '.join(map(str, _V.dev_test_years))}) group by 1) y,
       (select min(t_idx) as f from cal where date >= date '{_V.first_train_decision_date}') f, (values ('core'), ('calibration'), ('test')) r(role), cal c
  where case role when 'test' then c.t_idx between y.a and y.b
    when 'calibration' then (c.t_idx - f) % {_V.train_stride} = 0 and c.t_idx between y.a - {_GAP} - {_V.calibration_days} and y.a - {_GAP} - 1
    else (c.t_idx - f) % {_V.train_stride} = 0 and c.t_idx between f and y.a - {_GAP} - {_V.calibration_days} - {_GAP} - 1 end)"""


@query(f"{_BLOCKS} select fold_id, role, count(*) as n_dates, min(t_idx) as first_idx, max(t_idx) as last_idx from blocks group by 1, 2", "cal")
def fold_blocks(p: Panel) -> DataFrame:
    cal = lookup(p)
    made = folds.as_table(p.spark, folds.dev_folds(CONFIG, cal))
    folds.assert_valid(made, folds.spacing_of(CONFIG, cal, _V.calibration_days), locked_start=guards.locked_start_idx(CONFIG, cal))
    return made.groupBy("fold_id", "role").agg(F.count("*").alias("n_dates"), F.min("t_idx").alias("first_idx"), F.max("t_idx").alias("last_idx"))


@query(f"{_BLOCKS} select b.fold_id, b.role, count(*) as n_rows, count(*) filter (where eligible) as n_eligible from joined j join blocks b on j.t_idx = b.t_idx group by 1, 2", "joined")
def fold_rows(p: Panel) -> DataFrame:
    """Panel rows of every block, by joining the fold table on t_idx."""
    blocks = folds.as_table(p.spark, folds.dev_folds(CONFIG, lookup(p))).select("fold_id", "role", "t_idx")
    return p.joined.join(blocks, "t_idx").groupBy("fold_id", "role").agg(F.count("*").alias("n_rows"), F.count_if("eligible").alias("n_eligible"))


@query("select ticker, date, t_idx, eligible and t_idx <= 200 as eligible, case when t_idx <= 200 then adj_close end as adj_close, case when t_idx <= 200 then cast(volume as double) end as volume from (select j.*, a.volume as v from joined j join adjusted a using (ticker, date))", "joined")
def poison_future(p: Panel) -> DataFrame:
    rows = p.adjusted.join(p.universe.select("ticker", "date", "eligible"), ["ticker", "date"])
    return leakage.poison_future(rows.select("ticker", "date", "t_idx", "eligible", "adj_close", "volume"), 200)


@query(f"select min(t_idx) as locked_start_idx, min(t_idx) - {_H + 2} as last_dev_label_idx, {_TUNE} as tuning_max_idx from cal where date >= date '{_V.locked_test_start}'", "cal")
def split_bounds(p: Panel) -> DataFrame:
    """The as-of positions of the splits, by aggregates instead of a driver lookup."""
    after = p.calendar.agg(F.min(F.when(F.col("date") >= F.lit(_V.locked_test_start), F.col("t_idx"))).alias("locked_start_idx"), F.min(F.when(F.col("date") > F.lit(_V.tuning_end_date), F.col("t_idx"))).alias("after"))
    return after.select("locked_start_idx", (F.col("locked_start_idx") - (_H + 2)).alias("last_dev_label_idx"), (F.col("after") - (_H + 2)).alias("tuning_max_idx"))
