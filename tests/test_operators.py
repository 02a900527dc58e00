"""Flags, checks, master, universe and prices at their thresholds, one rule at a time."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from barleaf.config import Flags, Universe
from barleaf.errors import AdjustError, SecurityMasterError, UniverseError, ValidationError
from barleaf.operators import adjust, calendar, checks, flags, keys, master, universe
from barleaf.sources import synthetic

BRONZE = synthetic.BRONZE


@pytest.fixture(scope="module")
def bronze(spark):
    return synthetic.clean_bars(spark).cache()


@pytest.fixture(scope="module")
def cal(bronze):
    return calendar.build_calendar(bronze).cache()


def bars(spark, prices, ticker="A", volume=100, adj=None):
    day = dt.date(2020, 1, 6)
    rows = [(ticker, day + dt.timedelta(i), p, p * 1.1, p * 0.9, p, (adj or prices)[i], volume) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, BRONZE)


def flagged(df, name):
    return [r.date.day - 6 for r in df.where(name).orderBy("date").collect()]


def test_clean_bars_have_no_flags(bronze):
    silver = flags.add_flags(bronze)
    assert silver.columns == list(flags.SILVER)
    assert not any(checks.flag_totals(silver).first()[f"n_{f[5:]}"] for f in flags.FLAGS)
    assert {r.n for r in silver.groupBy("ticker").agg(F.max("n_obs").alias("n")).collect()} == {30}


def test_flag_thresholds_are_strict(spark):
    assert flagged(flags.add_flags(bars(spark, [5.0, 4.99, 5.01])), "flag_tick_noise") == [1]
    up, over = math.exp(0.39999), math.exp(0.40001)
    assert flagged(flags.add_flags(bars(spark, [10.0, 10 * up, 10 * up * over])), "flag_extreme_move") == [2]
    # the raw close drops, the adjusted one does not
    silver = flags.add_flags(bars(spark, [10.0, 9.8, 9.0], adj=[10.0, 9.9, 9.9]))
    assert flagged(silver, "flag_corp_action_suspect") == [2]
    assert flagged(flags.add_flags(bars(spark, [4.0, 3.0], adj=[4.0, 4.0])), "flag_corp_action_suspect") == []


def test_flat_and_empty_bars(spark):
    df = bars(spark, [10.0, 10.0]).withColumns({"high": F.col("close"), "low": F.col("close"), "volume": F.lit(0).cast("long")})
    silver = flags.add_flags(df)
    assert flagged(silver, "flag_flat_bar") == [0, 1] and flagged(silver, "flag_zero_volume") == [0, 1]


def test_events_use_returns_of_all_rows(spark):
    silver = flags.add_flags(bars(spark, [10.0, 9.9, 8.0, 8.1], adj=[10.0, 9.9, 9.9, 10.0]))
    (event,) = flags.corp_action_events(silver).collect()
    assert event.prev_close == 9.9 and event.ret_close == pytest.approx(math.log(8 / 9.9)) and event.ret_adj == 0


def test_toy_edge_cases(spark):
    silver = flags.add_flags(synthetic.toy_bars(spark))
    by = {r.ticker: r for r in checks.flag_totals(silver, "ticker").collect()}
    assert by["TK01"].n_tick_noise == by["TK01"].n_rows and by["TK02"].n_corp_action_suspect == 1
    assert by["AZN"].n_zero_volume / by["AZN"].n_rows > 0.6


# --- checks


def test_clean_bars_pass(bronze, cal):
    results = checks.hard_checks(bronze, cal)
    checks.assert_passed(results)
    assert all(r["passed"] for r in results)


@pytest.mark.parametrize(("change", "name"), [
    ({"high": "low * 0.5"}, "high_bounds"), ({"low": "high * 2"}, "low_bounds"), ({"close": "cast(null as double)"}, "no_missing"),
    ({"adj_close": "-adj_close"}, "positive_prices"), ({"volume": "cast(-1 as bigint)"}, "volume_not_negative"), ({"close": "cast('NaN' as double)"}, "no_missing"),
])
def test_one_broken_rule_fails(bronze, cal, change, name):
    first = (F.col("ticker") == "AAA") & (F.col("date") == F.lit(dt.date(2020, 1, 7)))
    broken = bronze.withColumns({k: F.when(first, F.expr(v)).otherwise(F.col(k)) for k, v in change.items()})
    with pytest.raises(ValidationError) as e:
        checks.assert_passed(checks.hard_checks(broken, cal))
    assert name in {f["name"] for f in e.value.failures}


def test_schema_failure_ends_the_list(bronze, cal):
    results = checks.hard_checks(bronze.withColumn("volume", F.col("volume").cast("double")), cal)
    assert [r["name"] for r in results] == ["schema"] and not results[0]["passed"]


def test_repeated_keys_and_gaps(bronze, cal):
    twice = bronze.union(bronze.limit(1))
    assert not {r["name"]: r for r in checks.hard_checks(twice, cal)}["unique_keys"]["passed"]
    hole = bronze.where(~((F.col("ticker") == "BBB") & F.col("date").isin(dt.date(2020, 1, 8), dt.date(2020, 1, 9))))
    (gap,) = checks.calendar_gaps(hole, cal).collect()
    assert (gap.ticker, gap.n_missing, gap.first_missing) == ("BBB", 2, dt.date(2020, 1, 8))


def test_soft_checks_and_expectations(spark, bronze, tmp_path):
    cal, own = calendar.build_calendar(bronze), Flags(tick_noise_min_close=5.0)
    n = bronze.count()
    file = tmp_path / "expected.yaml"
    file.write_text(f"dataset:\n  name: x\ndimensions:\n  expected_rows: {n}\n  expected_tickers: 99\nquality:\n  expected_nulls: 0\n  expected_duplicates: 0\n  expected_unknown: 3\n")
    got = {r["name"]: r for r in checks.soft_checks(bronze, cal, own, checks.expectations(str(file)))}
    assert got["expected_rows"]["passed"] and not got["expected_tickers"]["passed"] and got["expected_nulls"]["passed"] and got["expected_duplicates"]["passed"] and "expected_unknown" not in got
    assert all(r["severity"] == "soft" for r in got.values()) and got["early_exits"]["passed"] and len(got["large_moves"]["examples"]) == 10
    assert checks.expectations('{"expected_rows": 3}') == {"expected_rows": 3} and checks.expectations(None) == {}
    first, last = (cal.orderBy(o).first().date for o in (F.asc("date"), F.desc("date")))
    tickers = sorted(r.ticker for r in bronze.select("ticker").distinct().collect())
    cut = bronze.where((F.col("ticker") != tickers[0]) | (F.col("date") < F.lit(last))).withColumn("volume", F.when(F.col("ticker") == tickers[1], 0).otherwise(F.col("volume")).cast("long"))
    got = {r["name"]: r for r in checks.soft_checks(cut, cal, own)}
    assert got["early_exits"]["count"] == 1 and not got["early_exits"]["passed"] and tickers[0] in got["early_exits"]["examples"][0]
    assert got["zero_volume_share"]["count"] == 1 and tickers[1] in got["zero_volume_share"]["examples"][0]
    assert checks.survivorship(cut)["ending_early"] == 1 and "only survivors" in checks.survivorship(bronze)["reading"]
    assert checks.survivorship(bronze.where(F.col("date") > F.lit(first)))["from_first_date"] == len(tickers)


def test_share_classes_that_should_move_together(spark):
    rows = synthetic.clean_rows(("GOOG", "GOOGL"), 40, seed=5)
    apart = spark.createDataFrame(rows, synthetic.BRONZE)
    cal = calendar.build_calendar(apart)
    one = apart.where("ticker = 'GOOG'")
    alike = one.union(one.withColumn("ticker", F.lit("GOOGL")))
    state = lambda df: next(r["passed"] for r in checks.soft_checks(df, cal, Flags()) if r["name"] == "correlation_GOOG_GOOGL")
    assert state(alike) and not state(apart)


# --- calendar


def test_calendar(cal):
    rows = cal.orderBy("date").collect()
    assert [r.t_idx for r in rows] == list(range(30)) and [r.date.day for r in rows if r.is_month_first_day] == [6, 3]
    look = calendar.TradingCalendar.of(cal)
    assert look.offset(look.first_date, 3) == dt.date(2020, 1, 9) and look.first_at_or_after(dt.date(2020, 1, 11)) == 5 and look.first_after(dt.date(2020, 1, 6)) == 1
    with pytest.raises(KeyError):
        look.idx_of(dt.date(2020, 1, 11))
    with pytest.raises(IndexError):
        look.date_at(30)
    with pytest.raises(ValueError):
        calendar.TradingCalendar([dt.date(2020, 1, 2), dt.date(2020, 1, 1)])


# --- master and universe


@pytest.fixture(scope="module")
def silver(spark):
    rows = synthetic.clean_rows(("AAA", "BBB"), 300, {"BBB": 10}, seed=11)
    return flags.add_flags(spark.createDataFrame(rows, BRONZE)).cache()


def curated(spark, *rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in master.CURATED))


def test_master_defaults_and_overrides(spark, silver):
    plain = {r.ticker: r for r in master.build_master(silver, None, 0.05, dt.date(2020, 1, 6)).collect()}
    assert plain["AAA"].cohort == "orig2000" and plain["BBB"].cohort == "later" and plain["AAA"].issuer_id == "AAA" and plain["AAA"].include_in_universe
    assert plain["BBB"].n_obs == 290 and plain["AAA"].status_reason == ""
    rows = curated(spark, ("AAA", " ", "X", "by hand", "Yes", " note "))
    got = {r.ticker: r for r in master.build_master(silver, rows, 0.05).collect()}
    assert got["AAA"].issuer_id == "AAA" and got["AAA"].stitching_suspect and not got["AAA"].include_in_universe
    assert got["AAA"].status_reason == "curated: by hand" and got["AAA"].notes == "note" and got["BBB"].share_class == ""


def test_zero_volume_rule_is_strict(spark, silver):
    thin = silver.withColumn("volume", F.when((F.col("ticker") == "AAA") & (F.col("n_obs") <= 15), 0).otherwise(F.col("volume")).cast("long"))
    at = {r.ticker: r.include_in_universe for r in master.build_master(thin, None, 0.05).collect()}
    assert at["AAA"]  # 15 of 300 is the limit itself
    below = {r.ticker: r for r in master.build_master(thin, None, 0.049).collect()}
    assert below["AAA"].status_reason == "quality rule: zero-volume share 5.0% > 4.9%"


def test_median_of_the_last_year(silver):
    rows = sorted((r.date, r.close * r.volume) for r in silver.where("ticker = 'AAA'").collect())[-252:]
    values = sorted(v for _, v in rows)
    got = master.build_master(silver, None, 0.05).where("ticker = 'AAA'").first()
    assert got.median_dollar_volume_last_year == pytest.approx((values[125] + values[126]) / 2, rel=1e-12)


@pytest.mark.parametrize("row", [("", "", "", "", "", ""), ("AAA", "", "", "", "maybe", ""), ("ZZZ", "", "", "", "", "")])
def test_bad_curated_rows(spark, silver, row):
    with pytest.raises(SecurityMasterError):
        master.build_master(silver, curated(spark, row), 0.05)
    with pytest.raises(SecurityMasterError):
        master.normalise_curated(curated(spark, ("AAA",) * 1 + ("",) * 5, ("AAA",) + ("",) * 5))


def uni(silver, rows=None, **kwargs):
    made = master.build_master(silver, rows, 0.05)
    out = universe.build_universe(silver, made, Universe(**{"min_median_dollar_volume_63": 1.0} | kwargs))
    return {(r.ticker, r.n): r for r in out.join(silver.select("ticker", "date", F.col("n_obs").alias("n")), ["ticker", "date"]).collect()}


def test_seasoning_from_the_253rd_observation(silver):
    got = uni(silver)
    assert not got[("AAA", 252)].eligible and got[("AAA", 253)].eligible and got[("BBB", 253)].eligible
    assert got[("AAA", 252)].fail_seasoning and not got[("AAA", 253)].fail_seasoning


def test_liquidity_needs_63_observations_and_is_inclusive(silver):
    got = uni(silver, seasoning_days=0)
    assert got[("AAA", 62)].median_dollar_volume_63 is None and got[("AAA", 62)].fail_liquidity and got[("AAA", 63)].eligible
    exact = got[("AAA", 100)].median_dollar_volume_63
    assert not uni(silver, seasoning_days=0, min_median_dollar_volume_63=exact)[("AAA", 100)].fail_liquidity


def test_other_reasons(spark, silver):
    got = uni(silver, curated(spark, ("BBB", "", "", "", "true", "")), drop_stitched=True, seasoning_days=0)
    assert got[("BBB", 100)].fail_master and not got[("AAA", 100)].fail_master
    got = uni(silver, cohort_filter="original55")
    assert all(r.fail_master for r in got.values())
    dead = silver.withColumn("volume", F.when(F.col("n_obs") == 280, 0).otherwise(F.col("volume")).cast("long"))
    assert uni(dead)[("AAA", 280)].fail_zero_volume and not uni(dead, require_positive_volume=False)[("AAA", 280)].fail_zero_volume
    with pytest.raises(UniverseError):
        uni(silver, cohort_filter="other")
    with pytest.raises(UniverseError):
        universe.build_universe(silver, master.build_master(silver.where("ticker = 'AAA'"), None, 0.05))
    with pytest.raises(UniverseError):
        universe.build_universe(silver.union(silver.limit(1)), master.build_master(silver, None, 0.05))


# --- adjusted prices


def test_adjusted_prices(bronze, cal):
    got = adjust.build_adjusted(bronze, cal)
    assert got.columns == list(adjust.ADJUSTED)
    for r in got.join(bronze.select("ticker", "date", "open", "close"), ["ticker", "date"]).collect():
        assert r.adj_factor == pytest.approx(0.9) and r.adj_open == pytest.approx(0.9 * r.open)
        assert r.adj_low <= min(r.adj_open, r.adj_close) and r.adj_high >= max(r.adj_open, r.adj_close)
        assert r.dollar_volume == r.close * r.volume and (r.logret_cc is None) == (r.t_idx == 0)
    assert not any(r.is_one for r in adjust.last_factors(got).collect())


def test_adjust_refuses_bad_input(bronze, cal):
    with pytest.raises(AdjustError):
        adjust.build_adjusted(bronze.withColumn("close", -F.col("close")), cal)
    with pytest.raises(AdjustError):
        adjust.build_adjusted(bronze.where("date <> '2020-01-08' or ticker <> 'AAA'"), cal)
    with pytest.raises(AdjustError):
        adjust.build_adjusted(bronze, cal.where("t_idx < 20"))


def test_key_tools(bronze):
    less = bronze.where("ticker <> 'CCC'")
    assert keys.key_mismatches(bronze, less).count() == 30 and keys.key_mismatches(less, bronze).where("side = 'right'").count() == 30
    assert keys.repeated_keys(bronze).count() == 0


def test_settings_of_flags(spark):
    assert flagged(flags.add_flags(bars(spark, [10.0, 11.0]), Flags(extreme_move_abs_ret=0.05)), "flag_extreme_move") == [1]


def test_stage_tables_of_any_bars(spark):
    made = synthetic.stage_tables(synthetic.toy_bars(spark, tickers=4, days=60))
    n = made.bronze.count()
    assert {t.count() for t in (made.silver, made.universe, made.adjusted, made.labels, made.features)} == {n} and made.master.count() == 4
    assert made.silver.columns == list(flags.SILVER) and "ret_5" in made.features.columns
