"""Evaluation and strategy operators against plain versions and hand-made cases."""

import datetime as dt
import math
import random
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleaf.operators import evaluate, strategy
from barleaf.sources import synthetic

PANEL = "ticker string, date date, t_idx int, eligible boolean, s double, y double, c double"


def rows(days=30, names=25, strength=1.0, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for t, date in enumerate(synthetic.business_days(dt.date(2020, 1, 6), days)):
        s = rng.normal(size=names)
        y = strength * s + 0.3 * rng.normal(size=names)
        out += [(f"N{k:02d}", date, t, True, float(s[k]), float(y[k]), float(y[k] > 0)) for k in range(names)]
    return out


def test_rank_ic_of_perfect_reversed_and_constant_scores(spark):
    df = spark.createDataFrame(rows(5), PANEL)
    ic = lambda d, s: [r.ic for r in evaluate.rank_ic(d, s, "y").collect()]
    assert ic(df.withColumn("s", F.exp("y")), "s") == pytest.approx([1.0] * 5)
    assert ic(df.withColumn("s", -F.col("y")), "s") == pytest.approx([-1.0] * 5)
    assert ic(df.withColumn("s", F.lit(1.0)), "s") == [None] * 5
    assert ic(df.where("ticker < 'N10'"), "s") == []


def test_planted_signal_and_noise(spark):
    value = lambda d: evaluate.series_summary(evaluate.rank_ic(d, "feature_1", "excess_h20")).first()
    assert value(synthetic.planted_signal_panel(spark)).mean > 0.1
    s = value(synthetic.null_panel(spark))
    assert abs(s.mean) < 2.5 * s.std / math.sqrt(s.effective_n) and s.effective_n == 150


def test_newey_west_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = [0.0]
    for e in rng.normal(size=200):
        x.append(0.6 * x[-1] + e)
    x = [float(v) for v in x]
    dates = synthetic.business_days(dt.date(2020, 1, 6), len(x))
    df = spark.createDataFrame(list(zip(dates, x)), "date date, ic double")
    got = evaluate.newey_west(df, "ic", 5).first()
    d, n = np.array(x) - np.mean(x), len(x)
    var = d @ d + 2 * sum((1 - k / 6) * (d[k:] @ d[:-k]) for k in range(1, 6))
    assert got.se == pytest.approx(math.sqrt(var) / n) and got.mean == pytest.approx(np.mean(x))
    plain = np.std(x, ddof=1) / math.sqrt(n)
    assert got.se > 1.3 * plain


def test_quantile_spread_and_fit(spark):
    df = spark.createDataFrame(rows(10), PANEL)
    assert all(r.spread > 0 and r.top_decile >= r.bottom for r in evaluate.quantile_spread(df, "s", "y").collect())
    fit = evaluate.fit_metrics(df.withColumn("p", F.col("y") * 0.5), "p", "y").first()
    assert fit.r2_zero == pytest.approx(0.75) and fit.effective_n == 10


def test_auc_against_pairs(spark):
    rng = random.Random(3)
    data = [(f"N{i}", dt.date(2020, 1, 6), 0, True, float(rng.randint(0, 9)), 0.0, float(rng.random() < 0.4)) for i in range(120)]
    got = evaluate.auc(spark.createDataFrame(data, PANEL), "s", "c", 5).first()
    pos, neg = [r[4] for r in data if r[6]], [r[4] for r in data if not r[6]]
    want = mean((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert got.auc == pytest.approx(want) and (got.n_pos, got.n_neg) == (len(pos), len(neg))


def test_probabilities(spark):
    rng = random.Random(4)
    ps = [(i % 10 + 0.5) / 10 for i in range(4000)]
    data = [("A", dt.date(2020, 1, 6), 0, True, p, 0.0, float(rng.random() < p)) for p in ps]
    df = spark.createDataFrame(data, PANEL)
    good = evaluate.expected_calibration_error(evaluate.reliability(df, "s", "c")).first().ece
    bent = evaluate.expected_calibration_error(evaluate.reliability(df.withColumn("s", F.col("s") * F.col("s")), "s", "c")).first().ece
    assert good < 0.03 < bent
    m = evaluate.probability_metrics(df, "s", "c").first()
    assert m.brier == pytest.approx(mean((r[4] - r[6]) ** 2 for r in data)) and m.n_rows == 4000


def test_random_baseline_depends_on_key_only(spark):
    raw = spark.createDataFrame(rows(3), PANEL).select("ticker", "date", "eligible", F.col("s").alias("mom_12_1"), F.col("s").alias("ret_21"), F.col("s").alias("vol_63"))
    a = {(r.ticker, r.date): r.baseline_random for r in evaluate.baseline_scores(raw).collect()}
    b = {(r.ticker, r.date): r.baseline_random for r in evaluate.baseline_scores(raw.repartition(5).orderBy("mom_12_1")).collect()}
    assert a == b and 0.3 < mean(a.values()) < 0.7


def test_regimes_use_history_only(spark):
    dates = synthetic.business_days(dt.date(2020, 1, 6), 40)
    data = [(d, 1.0 if i > 20 else -1.0, float(i)) for i, d in enumerate(dates)]
    df = spark.createDataFrame(data, "date date, mkt_trend_200 double, mkt_vol_21 double")
    got = evaluate.regimes(df, 10).orderBy("date").collect()
    assert got[5].regime is None and got[9].regime == "down_high" and got[30].regime == "up_high"
    short = evaluate.regimes(df.where(F.col("date") <= F.lit(dates[15])), 10).orderBy("date").collect()
    assert [tuple(r) for r in short] == [tuple(r) for r in got[:16]]


SIGNAL = "ticker string, date string, eligible boolean, held boolean, rank_pct double, pred_excess double, prob_cal double, base_rate double, vol_pct double, units_are_returns boolean"


def signal(spark, rules=None, **change):
    row = {"ticker": "A", "date": "d", "eligible": True, "held": False, "rank_pct": 0.9, "pred_excess": 1.0, "prob_cal": 0.6, "base_rate": 0.5, "vol_pct": 0.5, "units_are_returns": True} | change
    got = strategy.signals(spark.createDataFrame([tuple(row.values())], SIGNAL), rules).collect()
    return (got[0].signal, set(got[0].reason_codes)) if got else None


@pytest.mark.parametrize(("change", "rules", "want", "code"), [
    ({"rank_pct": 0.8}, {}, "BUY", "ENTRY_RANK"), ({"rank_pct": 0.79}, {}, "NEUTRAL", "MIDDLE_RANK"), ({"rank_pct": 0.2}, {}, "AVOID", "AVOID_RANK"), ({"held": True, "rank_pct": 0.6}, {}, "HOLD", "HOLD_RANK"),
    ({"held": True, "rank_pct": 0.5}, {}, "HOLD", "HOLD_RANK"), ({"held": True, "rank_pct": 0.49}, {}, "SELL", "EXIT_RANK"), ({"held": True, "eligible": False}, {}, "SELL", "EXIT_INELIGIBLE"),
    ({"held": True, "rank_pct": None}, {}, "HOLD", "NO_PREDICTION"), ({"pred_excess": 0.0005}, {}, "NEUTRAL", "BLOCKED_COST"), ({"pred_excess": 0.0005}, {"cost_hurdle": False}, "BUY", "ENTRY_RANK"),
    ({"prob_cal": 0.4}, {"prob_gate": True}, "NEUTRAL", "BLOCKED_PROB"), ({"held": True, "prob_cal": 0.4}, {"prob_gate": True}, "SELL", "EXIT_PROB"), ({"vol_pct": 0.95}, {"vol_veto": True}, "NEUTRAL", "BLOCKED_VOL"),
    ({"units_are_returns": False, "pred_excess": -5.0, "prob_cal": None}, {"prob_gate": True}, "BUY", "GATE_BYPASSED_BASELINE"),
])
def test_signal_rules(spark, change, rules, want, code):
    got = signal(spark, strategy.SignalRules(**rules), **change)
    assert got[0] == want and code in got[1]


def test_names_outside_give_no_signal(spark):
    assert signal(spark, eligible=False) is None


def test_target_sizes(spark):
    df = spark.createDataFrame([(n,) for n in (42, 53, 83, 98, 150, 5)], "n int")
    rules = strategy.PortfolioRules()
    assert [r.t for r in df.select(strategy.target_size(F.col("n"), rules).alias("t")).collect()] == [10, 11, 17, 20, 25, 10]


def test_selection(spark):
    data = [("A", "d", True, True, 0.9, "HOLD"), ("B", "d", True, False, 0.9, "BUY"), ("C", "d", True, True, 0.5, "HOLD"), ("D", "d", True, False, 0.85, "BUY"), ("E", "d", True, True, 0.1, "SELL"), ("F", "d", True, False, 0.4, "NEUTRAL")]
    df = spark.createDataFrame(data, "ticker string, date string, eligible boolean, held boolean, rank_pct double, signal string")
    got = {r.ticker: (r.final_action, r.weight) for r in strategy.select_names(df, strategy.PortfolioRules(0.3, 2, 2)).collect()}
    assert got == {"A": ("HOLD", 0.5), "B": ("BUY", 0.5), "C": ("SELL", 0.0), "D": ("SKIP_CAPACITY", 0.0), "E": ("SELL", 0.0), "F": (None, 0.0)}


def test_simulation_by_hand(spark):
    dates = synthetic.business_days(dt.date(2020, 1, 6), 5)
    prices = [(k, dates[t], t, o, c) for k, px in {"A": [(10, 10), (10, 11), (12, 12), (12, 12), (12, 12)], "B": [(20, 20), (20, 20), (20, 20), (25, 20), (20, 20)]}.items() for t, (o, c) in enumerate(px)]
    px = spark.createDataFrame([(*p[:3], float(p[3]), float(p[4])) for p in prices], "ticker string, date date, t_idx int, adj_open double, adj_close double")
    w = spark.createDataFrame([("m", 0, "A", 1.0), ("m", 2, "B", 0.5)], "model_id string, t_idx int, ticker string, weight double")
    free = {r.t_idx: r for r in strategy.simulate(px, w, capital=1000.0, cost_bps=0.0).collect()}
    assert [round(free[t].nav, 6) for t in range(5)] == [1000, 1100, 1200, 600 + 24 * 20, 1080]
    assert free[1].n_holdings == 1 and free[3].turnover == pytest.approx(1.5) and free[4].cash == pytest.approx(1080)
    paid = {r.t_idx: r for r in strategy.simulate(px, w, capital=1000.0, cost_bps=100.0).collect()}
    assert paid[1].cash == pytest.approx(0, abs=1e-9) and paid[1].nav == pytest.approx(1000 / 1.01 / 10 * 11)
    late = {r.t_idx: r for r in strategy.simulate(px, w, capital=1000.0, cost_bps=0.0, fill="delay1_open").collect()}
    assert late[1].nav == 1000 and late[2].n_holdings == 1


def test_performance_and_drawdown(spark):
    navs = [100.0, 120.0, 90.0, 130.0]
    data = [("m", d, navs[i], navs[i] / navs[i - 1] - 1 if i else 0.0) for i, d in enumerate(synthetic.business_days(dt.date(2020, 1, 6), 4))]
    df = spark.createDataFrame(data, "model_id string, date date, nav double, ret double")
    assert min(r.drawdown for r in evaluate.drawdowns(df).collect()) == pytest.approx(-0.25)
    r = evaluate.performance(df).first()
    assert r.max_drawdown == pytest.approx(-0.25) and r.cagr == pytest.approx(1.3 ** (252 / 4) - 1) and r.hit_rate == 0.5
    z = evaluate.probabilistic_sharpe(df).first()
    x = np.array([d[3] for d in data])
    sr, c = x.mean() / x.std(ddof=1), x - x.mean()
    g3, g4 = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2
    assert z.psr_z == pytest.approx(sr * math.sqrt(3) / math.sqrt(1 - g3 * sr + (g4 - 1) / 4 * sr * sr))


def series(spark, xs, column="ic"):
    dates = synthetic.business_days(dt.date(2020, 1, 6), len(xs))
    return spark.createDataFrame(list(zip(dates, [None if x is None else float(x) for x in xs])), f"date date, {column} double")


def test_bootstrap_bounds(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0.1, 1.0, 120)
    got = evaluate.bootstrap(series(spark, [*x, None]), draws=600).first()
    se = x.std(ddof=1) / math.sqrt(120)
    assert got.mean == pytest.approx(x.mean()) and got.effective_n == 120
    assert got.low == pytest.approx(x.mean() - 1.96 * se, abs=0.5 * se) and got.high == pytest.approx(x.mean() + 1.96 * se, abs=0.5 * se)
    again = evaluate.bootstrap(series(spark, [*x, None]).repartition(5), draws=600).first()
    assert (again.low, again.high) == pytest.approx((got.low, got.high)) and evaluate.bootstrap(series(spark, [*x, None]), draws=600, seed=1).first().low != got.low
    # where neighbours go together, blocks give wider bounds than single dates
    walk = np.repeat(rng.normal(size=24), 5)
    single, blocks = (evaluate.bootstrap(series(spark, walk), draws=600, block=b).first() for b in (1, 10))
    assert blocks.high - blocks.low > 1.3 * (single.high - single.low)
    flat = evaluate.bootstrap(series(spark, [2.0] * 9), draws=50, block=4).first()
    assert (flat.mean, flat.low, flat.high) == (2.0, 2.0, 2.0)
    assert evaluate.bootstrap(series(spark, [None]), draws=5).first().effective_n == 0


def test_paired_difference(spark):
    rng = np.random.default_rng(8)
    common = rng.normal(size=80)
    a, b = common + 0.2 + 0.1 * rng.normal(size=80), common + 0.1 * rng.normal(size=80)
    got = evaluate.paired_difference(series(spark, a), series(spark, b[:70]), draws=300).first()
    d = (a - b)[:70]
    assert got.mean == pytest.approx(d.mean()) and got.t_stat == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(70))) and got.effective_n == 70 and 0 < got.low < d.mean() < got.high


def test_held_follows_what_was_bought_and_sold(spark):
    """Against the same rules with the state carried from date to date."""
    rng = random.Random(9)
    rules = strategy.SignalRules(prob_gate=True, vol_veto=True)
    data = [(t, f"2020-{m:02d}", rng.random() < 0.9, rng.choice([None, *[rng.random()] * 5]), rng.choice([0.0, 1.0, 1.0]), rng.choice([None, 0.2, 0.6, 0.8]), 0.5, rng.choice([0.2, 0.95, None]), rng.random() < 0.7) for t in "ABCDEF" for m in range(1, 13)]
    names = "ticker string, date string, eligible boolean, rank_pct double, pred_excess double, prob_cal double, base_rate double, vol_pct double, units_are_returns boolean"
    got = {(r.ticker, r.date): r.held for r in strategy.with_held(spark.createDataFrame(data, names), rules).collect()}
    for t in "ABCDEF":
        held = False
        for _, d, live, rank, gain, prob, base, vol, units in (r for r in data if r[0] == t):
            assert got[t, d] == held, (t, d)
            cost = not units or gain >= 0.001
            if held:
                held = live and (rank is None or not (rank < 0.5 or (units and prob is not None and prob < base)))
            else:
                held = live and rank is not None and rank >= 0.8 and cost and (not units or (prob is not None and prob >= base)) and vol is not None and vol <= 0.9


def test_relative_performance_and_deflated_sharpe(spark):
    rng = np.random.default_rng(10)
    b = rng.normal(0.0005, 0.01, 60)
    m = 0.5 * b + 0.0003 + rng.normal(0, 0.002, 60)
    dates = synthetic.business_days(dt.date(2020, 1, 6), 60)
    data = [(k, d, 1000.0 + i, float(r), 0.1, 2.0) for k, rets in (("b", b), ("m", m)) for i, (d, r) in enumerate(zip(dates, rets))]
    df = spark.createDataFrame(data, "model_id string, date date, nav double, ret double, turnover double, cost double")
    got = {r.model_id: r for r in evaluate.relative_performance(df, "b").collect()}
    beta = np.cov(m, b)[0, 1] / b.var(ddof=1)
    te = (m - b).std(ddof=1) * math.sqrt(252)
    assert got["m"].beta == pytest.approx(beta) and got["m"].alpha == pytest.approx((m.mean() - beta * b.mean()) * 252) and got["m"].information_ratio == pytest.approx((m - b).mean() * 252 / te)
    assert got["m"].turnover_year == pytest.approx(0.1 * 252) and got["b"].beta == pytest.approx(1.0) and got["b"].information_ratio is None
    one, many = (evaluate.deflated_sharpe(df, n, 0.01).where("model_id = 'm'").first() for n in (1, 50))
    assert one.expected_sr == 0.0 and many.expected_sr == pytest.approx(0.1 * 2.2, abs=0.03) and many.dsr_z < one.dsr_z
