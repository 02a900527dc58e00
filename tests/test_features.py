"""Features and labels against plain loops, closed forms and hand-made cases."""

import datetime as dt
import math
from statistics import mean, stdev

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleaf.config import Features, Labels
from barleaf.errors import FeatureError, LabelError
from barleaf.operators import labels as lab
from barleaf.operators.features import market, registry, stock
from barleaf.operators.features.build import build_features
from barleaf.operators.features.normalize import rank_gauss
from barleaf.sources.synthetic import business_days

ADJUSTED = "ticker string, date date, t_idx int, adj_factor double, adj_open double, adj_high double, adj_low double, adj_close double, volume long, dollar_volume double, logret_cc double"


def adjusted_rows(tickers=6, days=330, seed=5, late=None):
    rng, dates, rows = np.random.default_rng(seed), business_days(dt.date(2018, 1, 2), days), []
    for k in range(tickers):
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, days)))
        before = None
        for t in range((late or {}).get(k, 0), days):
            c, o = float(close[t]), float(close[t] * np.exp(rng.normal(0, 0.01)))
            v = 0 if rng.random() < 0.02 else int(rng.integers(1000, 5000))
            rows.append((f"T{k:02d}", dates[t], t, 0.9, o, max(o, c) * 1.01, min(o, c) * 0.99, c, v, c * v, None if before is None else math.log(c / before)))
            before = c
    return rows


@pytest.fixture(scope="module")
def panel(spark):
    rows = adjusted_rows(late={3: 20, 5: 90})
    adjusted = spark.createDataFrame(rows, ADJUSTED).cache()
    rng = np.random.default_rng(0)
    uni = spark.createDataFrame([(r[0], r[1], bool(rng.random() < 0.85)) for r in rows], "ticker string, date date, eligible boolean").cache()
    return rows, adjusted, uni


@pytest.fixture(scope="module")
def tables(panel):
    _, adjusted, uni = panel
    made = build_features(adjusted, uni)
    return {(r.ticker, r.date): r for r in made.raw.collect()}, {(r.ticker, r.date): r for r in made.model.collect()}, {r.date: r for r in made.market_series.collect()}


def plain(rows, market_return, ticker):
    """All stock features of one ticker by loops over its rows."""
    own = [r for r in rows if r[0] == ticker]
    c, hi, lo, dv, r = ([x[i] for x in own] for i in (7, 5, 6, 9, 10))
    m = [market_return.get(x[1]) for x in own]
    year = math.sqrt(252)

    def window(xs, t, n):
        w = xs[max(0, t - n + 1) : t + 1]
        return w if len(w) == n and None not in w else None

    out = []
    for t in range(len(own)):
        f = {f"ret_{k}": math.log(c[t] / c[t - k]) if t >= k else None for k in (5, 21, 63, 126, 252)}
        f["mom_12_1"] = math.log(c[t - 21] / c[t - 252]) if t >= 252 else None
        for n in (21, 63):
            w = window(r, t, n)
            f[f"vol_{n}"] = stdev(w) * year if w else None
        w = window(r, t, 63)
        f["downvol_63"] = math.sqrt(mean(min(x, 0) ** 2 for x in w)) * year if w else None
        f["vol_ratio_21_63"] = math.log(f["vol_21"] / f["vol_63"]) if f["vol_63"] else None
        w = window([math.log(a / b) ** 2 for a, b in zip(hi, lo)], t, 21)
        f["parkinson_21"] = math.sqrt(mean(w) / (4 * math.log(2))) * year if w else None
        pairs = [(a, b) if a is not None and b is not None else None for a, b in zip(r, m)]
        w = window(pairs, t, 126)
        if w:
            x, y = np.array(w).T
            f["beta_126"] = float(np.cov(x, y)[0, 1] / np.var(y, ddof=1))
        else:
            f["beta_126"] = None
        for n in (50, 200):
            w = window(c, t, n)
            f[f"px_sma_{n}"] = math.log(c[t] / mean(w)) if w else None
        w = window(c, t, 252)
        f["dist_52w_high"] = math.log(c[t] / max(w)) if w else None
        a, b = window(dv, t, 63), window(dv, t, 21)
        f["log_dvol_63"] = math.log(mean(a)) if a else None
        f["rel_dvol_21_63"] = math.log(mean(b) / mean(a)) if a else None
        w = window(r, t, 63)
        days = [(abs(x), d) for x, d in zip(r[max(0, t - 62) : t + 1], dv[max(0, t - 62) : t + 1]) if x is not None and d > 0]
        f["amihud_63"] = math.log1p(1e6 * sum(x / d for x, d in days) / len(days)) if w and days else None
        out.append((own[t][1], f))
    return out


def test_stock_features_against_loops(panel, tables):
    rows, (raw, _, series) = panel[0], tables
    returns = {d: s.mkt_logret for d, s in series.items()}
    for ticker in ("T00", "T03", "T05"):
        for date, f in plain(rows, returns, ticker):
            got = raw[(ticker, date)]
            for name, want in f.items():
                assert (got[name] is None) == (want is None), (ticker, date, name)
                assert want is None or got[name] == pytest.approx(want, rel=1e-8, abs=1e-10), (ticker, date, name)


def test_warmup_rows_match_the_registry(panel, tables):
    rows, raw = panel[0], tables[0]
    dates = sorted(r[1] for r in rows if r[0] == "T00")
    for s in registry.SPECS.values():
        if s.level == "stock" and s.name != "beta_126":
            assert next(i for i, d in enumerate(dates) if raw[("T00", d)][s.name] is not None) == s.warmup, s.name


def test_market_series_against_loops(panel, tables):
    rows, _, uni = panel
    eligible = {(r.ticker, r.date): r.eligible for r in uni.collect()}
    series, total = tables[2], 0.0
    before = {}
    by_date = {}
    for r in rows:
        if before.get(r[0]) and r[10] is not None:
            by_date.setdefault(r[1], []).append(r[10])
        before[r[0]] = eligible[r[:2]]
    for date in sorted(series):
        want = mean(by_date[date]) if date in by_date else None
        s = series[date]
        assert (s.mkt_logret is None) == (want is None) and s.n_eligible == sum(v for (_, d), v in eligible.items() if d == date)
        if want is not None:
            total += want
            assert s.mkt_logret == pytest.approx(want, abs=1e-12) and s.mkt_index == pytest.approx(math.exp(total))
        else:
            assert s.mkt_index is None


def test_cross_section_features(panel, tables):
    raw = tables[0]
    date = sorted({d for _, d in raw})[120]
    own = [r for (_, d), r in raw.items() if d == date and r.eligible]
    above = [r.px_sma_50 > 0 for r in own if r.px_sma_50 is not None]
    got = own[0]
    assert got.mkt_breadth_50 == pytest.approx(sum(above) / len(above))
    assert got.xs_disp_21 == pytest.approx(stdev(r.ret_21 for r in own if r.ret_21 is not None))


def test_model_features_are_normal_scores(tables):
    from statistics import NormalDist

    raw, model, _ = tables
    date = sorted({d for _, d in raw})[200]
    own = sorted((r.ret_21, k) for k, r in raw.items() if k[1] == date and r.eligible)
    n = len(own)
    for i, (_, k) in enumerate(own):
        assert model[k].ret_21 == pytest.approx(NormalDist().inv_cdf((i + 0.5) / n), abs=1e-9)
    assert all(r.ret_21 is None for k, r in model.items() if not r.eligible)
    assert all(model[k].mkt_ret_21 == raw[k].mkt_ret_21 for k in raw)


def test_families_do_not_change_each_other(panel, tables):
    _, adjusted, uni = panel
    only = build_features(adjusted, uni, Features(families=("market",)))
    assert only.raw.columns == ["ticker", "date", "eligible", *registry.selected(("market",))]
    full = tables[0]
    for r in only.raw.where("date = '2018-09-03'").collect():
        assert r.mkt_breadth_50 == full[(r.ticker, r.date)].mkt_breadth_50 and r.xs_disp_21 == full[(r.ticker, r.date)].xs_disp_21
    assert registry.closure(["vol_ratio_21_63"]) == ["vol_21", "vol_63", "vol_ratio_21_63"]
    for bad in (("other",), ("market", "market"), ()):
        with pytest.raises(FeatureError):
            registry.selected(bad)
    with pytest.raises(FeatureError):
        registry.get_spec("none")


def test_features_refuse_other_keys(panel):
    _, adjusted, uni = panel
    with pytest.raises(FeatureError):
        build_features(adjusted, uni.where("ticker <> 'T00'"))
    with pytest.raises(FeatureError):
        build_features(adjusted.withColumn("adj_close", F.lit(0.0)), uni)


def test_degenerate_series(spark):
    rows = [("A", d, t, 1.0, 10.0, 10.0, 10.0, 10.0, 0, 0.0, None if t == 0 else 0.0) for t, d in enumerate(business_days(dt.date(2018, 1, 2), 150))]
    df = spark.createDataFrame(rows, ADJUSTED).withColumn("mkt_logret", F.lit(0.0))
    last = stock.with_features(df, ["vol_21", "vol_63", "vol_ratio_21_63", "log_dvol_63", "rel_dvol_21_63", "amihud_63", "beta_126", "px_sma_50"]).orderBy(F.desc("t_idx")).first()
    assert last.vol_21 == 0 and last.px_sma_50 == 0
    assert all(last[c] is None for c in ("vol_ratio_21_63", "log_dvol_63", "rel_dvol_21_63", "amihud_63", "beta_126"))


def test_rank_gauss_ties_and_winsor(spark):
    xs = [1.0, 1.0, 2.0, 3.0, 1000.0]
    rows = [("2020-01-06", f"T{i}", True, x) for i, x in enumerate(xs)] + [("2020-01-06", "T9", False, 5.0), ("2020-01-07", "T0", True, 4.0), ("2020-01-06", "T8", True, None)]
    df = spark.createDataFrame(rows, "date string, ticker string, eligible boolean, x double")
    got = {(r.date, r.ticker): r.x for r in rank_gauss(df, ["x"], (0.0, 1.0)).collect()}
    assert got[("2020-01-06", "T0")] == got[("2020-01-06", "T1")] < got[("2020-01-06", "T2")]
    assert got[("2020-01-06", "T9")] is None and got[("2020-01-06", "T8")] is None and got[("2020-01-07", "T0")] == pytest.approx(0)
    with pytest.raises(FeatureError):
        rank_gauss(df, ["x"], (0.5, 0.5))


# --- labels


def hand_case(spark):
    """3 names, 8 days, h = 2; C is not eligible at t = 1."""
    opens = {"A": [10, 11, 12, 13, 14, 15, 16, 17], "B": [20, 20, 20, 20, 20, 20, 20, 20], "C": [50, 49, 48, 47, 46, 45, 44, 43]}
    dates = business_days(dt.date(2020, 1, 6), 8)
    rows = [(k, dates[t], t, 1.0, float(o), float(o), float(o), float(o), 1, 1.0, None) for k, os in opens.items() for t, o in enumerate(os)]
    adjusted = spark.createDataFrame(rows, ADJUSTED)
    uni = spark.createDataFrame([(r[0], r[1], not (r[0] == "C" and r[2] == 1)) for r in rows], "ticker string, date date, eligible boolean")
    cal = spark.createDataFrame([(d, t) for t, d in enumerate(dates)], "date date, t_idx int")
    return opens, dates, adjusted, uni, cal


def test_labels_by_hand(spark):
    opens, dates, adjusted, uni, cal = hand_case(spark)
    out = lab.build_labels(adjusted, uni, cal, Labels((2,), 2, (0.0, 1.0), 2))
    assert out.columns == lab.label_columns((2,))
    got = {(r.ticker, dates.index(r.date)): r for r in out.collect()}
    ret = lambda k, t: math.log(opens[k][t + 3] / opens[k][t + 1])
    for k in opens:
        for t in range(8):
            r = got[(k, t)]
            assert r.label_exit_idx_h2 == t + 3 and r.has_label_h2 == (t <= 4)
            assert r.ret_fwd_h2 == pytest.approx(ret(k, t)) if t <= 4 else r.ret_fwd_h2 is None
    at0 = [ret(k, 0) for k in "ABC"]
    assert got[("A", 0)].excess_h2 == pytest.approx(at0[0] - mean(at0)) and got[("A", 0)].rank_pct_h2 == 1.0 and got[("C", 0)].rank_pct_h2 == pytest.approx(1 / 3)
    assert got[("A", 0)].y_cls_h2 == 1.0 and got[("C", 0)].y_cls_h2 == 0.0
    at1 = [ret(k, 1) for k in "AB"]  # C is left out of the cross-section but has its own return
    assert got[("B", 1)].excess_h2 == pytest.approx(at1[1] - mean(at1)) and got[("C", 1)].excess_h2 is None and got[("C", 1)].ret_fwd_h2 is not None


def test_thin_dates_have_no_cross_section(spark):
    _, dates, adjusted, uni, cal = hand_case(spark)
    got = lab.build_labels(adjusted, uni, cal, Labels((2,), 2, (0.0, 1.0), 3)).collect()
    assert all(r.excess_h2 is None and r.rank_pct_h2 is None for r in got if r.date == dates[1])
    assert all(r.has_label_h2 for r in got if r.date == dates[1])


def test_labels_refuse_bad_settings_and_keys(spark):
    _, _, adjusted, uni, cal = hand_case(spark)
    for bad in (Labels((), 2), Labels((2, 2), 2), Labels((0,), 0), Labels((2,), 3), Labels((2,), 2, (0.9, 0.1))):
        with pytest.raises(LabelError):
            lab.build_labels(adjusted, uni, cal, bad)
    with pytest.raises(LabelError):
        lab.build_labels(adjusted, uni.where("ticker <> 'A'"), cal, Labels((2,), 2))


def test_market_vol_and_trend_need_full_windows(spark):
    rows = [(d, 0.01) for d in business_days(dt.date(2018, 1, 2), 210)]
    series = spark.createDataFrame(rows, "date date, mkt_logret double").withColumn("mkt_index", F.lit(1.0))
    got = market.market_features(series).orderBy("date").collect()
    assert got[19].mkt_ret_21 is None and got[20].mkt_ret_21 == pytest.approx(0.21) and got[198].mkt_trend_200 is None and got[199].mkt_trend_200 == pytest.approx(0)
    assert got[20].mkt_vol_21 == pytest.approx(0, abs=1e-9)
