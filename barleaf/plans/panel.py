"""The stage tables of the proxy panel, and the same stages as DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from barleaf.functions.exprs import inverse_normal_sql
from barleaf.operators import adjust, calendar, flags, labels, master, universe
from barleaf.operators.features import market, stock
from barleaf.operators.features.build import panel_of
from barleaf.sources import proxy
from barleaf.sources.tables import written

ORIGINAL = dt.date(1995, 1, 2)
CONFIG = proxy.settings()


class Panel:
    """Stage tables. Those that several others are made of are written once for a query, as a batch build does, and read from there: order lines are scanned once, whatever a query uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def traded(self) -> DataFrame:
        return written(proxy.traded_bars(self.spark, self.sf_dir), "traded")

    @cached_property
    def bars(self) -> DataFrame:
        return proxy.bars(self.traded, self.calendar)

    @cached_property
    def calendar(self) -> DataFrame:
        return written(calendar.build_calendar(self.traded), "calendar")

    @cached_property
    def silver(self) -> DataFrame:
        return written(flags.add_flags(self.bars, CONFIG.flags), "silver")

    @cached_property
    def curated(self) -> DataFrame:
        return self.spark.createDataFrame(proxy.CURATED_ROWS, ", ".join(f"{c} string" for c in master.CURATED))

    @cached_property
    def master(self) -> DataFrame:
        return master.build_master(self.silver, self.curated, CONFIG.flags.max_zero_volume_share_ticker, ORIGINAL, checked=False)

    @cached_property
    def universe(self) -> DataFrame:
        return universe.build_universe(self.silver, self.master, CONFIG.universe, checked=False)

    @cached_property
    def adjusted(self) -> DataFrame:
        return adjust.build_adjusted(self.silver, self.calendar, checked=False)

    @cached_property
    def labels(self) -> DataFrame:
        return labels.build_labels(self.adjusted, self.universe, self.calendar, CONFIG.labels, checked=False)

    @cached_property
    def joined(self) -> DataFrame:
        return written(panel_of(self.adjusted, self.universe), "joined")

    @cached_property
    def market(self) -> DataFrame:
        return market.market_series(self.joined)

    def stock(self, *names: str) -> DataFrame:
        rows = self.joined
        if "beta_126" in names:
            rows = rows.join(self.market.select("date", "mkt_logret"), "date", "left")
        return stock.with_features(rows, list(names))


F, U, L, V = CONFIG.flags, CONFIG.universe, CONFIG.labels, CONFIG.validation
LN = lambda a, b: f"case when {a} > 0 and {b} > 0 then ln({a} / {b}) end"
BY = "partition by ticker order by t_idx"
ROLL = lambda n, by=BY: f"over ({by} rows between {n - 1} preceding and current row)"
FULL = lambda agg, x, n, by=BY: f"case when count({x}) {ROLL(n, by)} = {n} then {agg}({x}) {ROLL(n, by)} end"
YEAR = "sqrt(252e0)"


def _labels_sql() -> str:
    steps = [f"""lab0 as (
  select a.ticker, a.date, a.t_idx, u.eligible, {", ".join(f"lead(ln(adj_open), {1 + h}) over (partition by a.ticker order by a.t_idx) - lead(ln(adj_open), 1) over (partition by a.ticker order by a.t_idx) as raw{h}" for h in L.horizons)},
         (select max(t_idx) from cal) as last_idx
  from adjusted a join universe u on a.ticker = u.ticker and a.date = u.date)"""]
    before = "lab0"
    for h in L.horizons:
        steps += [f"""lab{h}a as (
  select *, cast(t_idx + 1 + {h} as integer) as label_exit_idx_h{h}, coalesce(t_idx + 1 + {h} <= last_idx and raw{h} is not null, false) as has_label_h{h} from {before})""",
        f"""lab{h}b as (
  select *, case when has_label_h{h} then raw{h} end as ret_fwd_h{h},
         case when eligible and has_label_h{h} and count(*) filter (where eligible and has_label_h{h}) over (partition by date) >= {L.min_names} then raw{h} end as r{h} from lab{h}a)""",
        f"lab{h}c as (select *, r{h} - avg(r{h}) over (partition by date) as excess_h{h} from lab{h}b)",
        f"""lab{h}d as (
  select *, case when excess_h{h} is not null then least(greatest(excess_h{h}, quantile_cont(excess_h{h}, {L.winsor_pct[0]}) over (partition by date)), quantile_cont(excess_h{h}, {L.winsor_pct[1]}) over (partition by date)) end as y_reg_h{h},
         case when excess_h{h} is not null then cast(excess_h{h} > 0 as double) end as y_cls_h{h},
         case when r{h} is not null then (rank() over (partition by date, r{h} is null order by r{h}) + (count(*) over (partition by date, r{h}) - 1) / 2e0) / count(r{h}) over (partition by date) end as rank_pct_h{h}
  from lab{h}c)"""]  # fmt: skip
        before = f"lab{h}d"
    return ",\n".join([*steps, f"labels_t as (select * from {before})"])


#: Stage -> (stages it needs, SQL).
STAGES: dict[str, tuple[tuple[str, ...], str]] = {
    "traded": ((), """traded as (
  select p_brand as ticker, cast(date_trunc('week', l_shipdate) as date) as date,
         first(px order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as open, max(px) as high, min(px) as low,
         last(px order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as close,
         cast(sum(cast(l_quantity as bigint)) as bigint) as volume,
         cast(sum(cast(round(l_discount * 100) as bigint)) as double) / (count(*) * 100e0) as d
  from (select *, l_extendedprice / l_quantity as px from lineitem) join part on l_partkey = p_partkey group by 1, 2),
traded_bars as (select ticker, date, open, high, low, close, close * (1e0 - d) as adj_close, volume from traded)"""),
    "bars": (("traded",), """grid as (
  select ticker, dates.date from (select ticker, min(date) as first from traded_bars group by 1) f join (select distinct date from traded_bars) dates on dates.date >= f.first),
filled as (
  select g.ticker, g.date, t.open, t.high, t.low, t.volume,
         last_value(t.close ignore nulls) over (partition by g.ticker order by g.date rows between unbounded preceding and current row) as close,
         last_value(t.adj_close ignore nulls) over (partition by g.ticker order by g.date rows between unbounded preceding and current row) as adj_close
  from grid g left join traded_bars t on g.ticker = t.ticker and g.date = t.date),
bars as (select ticker, date, coalesce(open, close) as open, coalesce(high, close) as high, coalesce(low, close) as low, close, adj_close, cast(coalesce(volume, 0) as bigint) as volume from filled)"""),
    "cal": (("traded",), """cal as (
  select date, cast(row_number() over (order by date) - 1 as integer) as t_idx, cast(year(date) as integer) as year,
         row_number() over (partition by year(date), month(date) order by date) = 1 as is_month_first_day
  from (select distinct date from traded_bars))"""),
    "silver": (("bars",), f"""prev as (
  select *, cast(row_number() over w as integer) as n_obs, lag(close) over w as prev_close, {LN("close", "lag(close) over w")} as ret_close, {LN("adj_close", "lag(adj_close) over w")} as ret_adj
  from bars window w as (partition by ticker order by date)),
silver as (
  select ticker, date, open, high, low, close, adj_close, volume, n_obs, close < {F.tick_noise_min_close} as flag_tick_noise, volume = 0 as flag_zero_volume,
         open = high and high = low and low = close as flag_flat_bar,
         coalesce(abs(ret_close - ret_adj) > {F.corp_action_ret_gap} and prev_close >= {F.corp_action_min_prev_close}, false) as flag_corp_action_suspect,
         coalesce(abs(ret_adj) > {F.extreme_move_abs_ret}, false) as flag_extreme_move from prev)"""),
    "master": (("silver",), f"""derived as (
  select ticker, min(date) as first_date, max(date) as last_date, count(*) as n_obs, case when min(date) = date '{ORIGINAL}' then 'orig2000' else 'later' end as cohort,
         avg(cast(volume = 0 as double)) as zero_volume_share, quantile_cont(case when back <= 252 then close * volume end, 0.5) as median_dollar_volume_last_year
  from (select *, row_number() over (partition by ticker order by date desc) as back from silver) group by 1),
curated(ticker, issuer_id, share_class, exclusion_reason, stitching_suspect, notes) as (values {", ".join(str(r) for r in proxy.CURATED_ROWS)}),
master as (
  select d.ticker, coalesce(nullif(c.issuer_id, ''), d.ticker) as issuer_id, coalesce(c.share_class, '') as share_class, coalesce(c.exclusion_reason, '') as exclusion_reason,
         coalesce(c.stitching_suspect in ('true', '1', 'yes'), false) as stitching_suspect, coalesce(c.notes, '') as notes,
         first_date, last_date, n_obs, cohort, zero_volume_share, median_dollar_volume_last_year,
         not (zero_volume_share > {F.max_zero_volume_share_ticker} or coalesce(c.exclusion_reason, '') <> '') as include_in_universe,
         concat_ws('; ', case when coalesce(c.exclusion_reason, '') <> '' then 'curated: ' || c.exclusion_reason end,
           case when zero_volume_share > {F.max_zero_volume_share_ticker} then 'quality rule: zero-volume share ' || printf('%.1f%%', zero_volume_share * 100) || ' > {F.max_zero_volume_share_ticker * 100:.1f}%' end) as status_reason
  from derived d left join curated c on d.ticker = c.ticker)"""),
    "universe": (("master",), f"""uni as (
  select s.ticker, s.date, case when count(*) over w = 63 then median(s.close * s.volume) over w end as median_dollar_volume_63, not m.include_in_universe as fail_master,
         s.n_obs <= {U.seasoning_days} as fail_seasoning, s.close < {U.min_close} as fail_min_close, s.volume = 0 as fail_zero_volume
  from silver s join master m on s.ticker = m.ticker window w as (partition by s.ticker order by s.date rows between 62 preceding and current row)),
universe as (
  select ticker, date, not (fail_master or fail_seasoning or fail_min_close or fail_zero_volume or fail_liquidity) as eligible, fail_master, fail_seasoning, fail_min_close, fail_zero_volume, fail_liquidity, median_dollar_volume_63
  from (select *, not coalesce(median_dollar_volume_63 >= {U.min_median_dollar_volume_63}, false) as fail_liquidity from uni))"""),
    "adjusted": (("silver", "cal"), f"""adj as (
  select s.ticker, s.date, c.t_idx, adj_close / close as f, open * (adj_close / close) as adj_open, high * (adj_close / close) as h, low * (adj_close / close) as l, adj_close, volume, close * volume as dollar_volume
  from silver s join cal c on s.date = c.date),
adjusted as (
  select ticker, date, t_idx, f as adj_factor, adj_open, greatest(h, adj_open, adj_close) as adj_high, least(l, adj_open, adj_close) as adj_low, adj_close, volume, dollar_volume,
         {LN("adj_close", "lag(adj_close) over (partition by ticker order by t_idx)")} as logret_cc from adj)"""),
    "labels_t": (("adjusted", "universe"), _labels_sql()),
    "joined": (("adjusted", "universe"), """joined as (
  select a.*, u.eligible, lag(u.eligible, 1, false) over (partition by a.ticker order by a.t_idx) as member from adjusted a join universe u on a.ticker = u.ticker and a.date = u.date)"""),
    "mkt": (("joined",), """mkt0 as (select date, avg(case when member then logret_cc end) as mkt_logret, cast(count(*) filter (where eligible) as integer) as n_eligible from joined group by 1),
mkt as (select *, case when mkt_logret is not null then exp(sum(mkt_logret) over (order by date rows between unbounded preceding and current row)) end as mkt_index from mkt0)"""),
}


def oracle(final: str, *needs: str) -> str:
    """WITH the stages needed, in order, then ``final``."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in STAGES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needs:
        add(n)
    return (f"with {','.join(chr(10) + STAGES[n][1] for n in order)}\n" if order else "") + final


NORMAL = inverse_normal_sql
