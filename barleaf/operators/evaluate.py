"""Predictive evaluation: scores against labels by date, and statistics of the daily series.

These stages are specified, not implemented, where this library's other
operators come from; definitions follow that specification. All functions take
a panel with ticker, date, t_idx, eligible, a score and a label column, and use
rows that are eligible and have both.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.functions.exprs import average_rank, full, pct_rank, trailing

MIN_NAMES, ANCHOR, EVERY = 20, 252, 20


def usable(panel: DataFrame, score: str, label: str) -> DataFrame:
    return panel.where(F.col("eligible") & F.col(score).isNotNull() & F.col(label).isNotNull())


def rank_ic(panel: DataFrame, score: str, label: str, min_names: int = MIN_NAMES, by: tuple[str, ...] = ()) -> DataFrame:
    """date, t_idx, n_names, ic: Spearman correlation on dates with enough names; NULL where one side is constant. by: columns that set panels apart, which come first."""
    rows = usable(panel, score, label).select(*by, "date", "t_idx", average_rank(score, *by, "date").alias("a"), average_rank(label, *by, "date").alias("b"))
    out = rows.groupBy(*by, "date", "t_idx").agg(F.count("*").alias("n_names"), F.covar_samp("a", "b").alias("c"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"))
    return out.where(F.col("n_names") >= min_names).select(*by, "date", "t_idx", "n_names", F.try_divide("c", F.sqrt(F.col("va") * F.col("vb"))).alias("ic"))


def non_overlapping(by_date: DataFrame, anchor: int = ANCHOR, every: int = EVERY) -> DataFrame:
    """Dates far enough apart for labels not to overlap."""
    return by_date.where((F.col("t_idx") >= anchor) & ((F.col("t_idx") - anchor) % every == 0))


def series_summary(by_date: DataFrame, column: str = "ic") -> DataFrame:
    """One row: mean, deviation, t-statistic, share above 0, effective_n."""
    x = F.col(column)
    out = by_date.where(x.isNotNull()).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.count("*").alias("effective_n"))
    return out.withColumn("t_stat", F.try_divide(F.col("mean"), F.col("std") / F.sqrt("effective_n")))


def newey_west(by_date: DataFrame, column: str = "ic", lag: int = 20) -> DataFrame:
    """One row: mean, its Newey-West standard error and t-statistic. Autocovariances are products with lagged rows of one small series."""
    rows = by_date.where(F.col(column).isNotNull()).select("date", F.col(column).alias("x"))
    w = Window.orderBy("date")
    dev = rows.crossJoin(rows.agg(F.avg("x").alias("m"))).select("date", "m", (F.col("x") - F.col("m")).alias("d"))
    products = dev.select("m", *((F.col("d") * (F.lag("d", k).over(w) if k else F.col("d"))).alias(f"p{k}") for k in range(lag + 1)))
    sums = products.agg(F.first("m").alias("mean"), F.count("*").alias("effective_n"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"g{k}") for k in range(lag + 1)))
    var: Column = F.col("g0")
    for k in range(1, lag + 1):
        var = var + 2 * (1 - k / (lag + 1)) * F.col(f"g{k}")
    se = F.try_divide(F.sqrt(F.greatest(var, F.lit(0.0))), F.col("effective_n"))
    return sums.select("mean", se.alias("se"), F.try_divide("mean", se).alias("t_stat"), "effective_n")


def bootstrap(by_date: DataFrame, column: str = "ic", *, block: int = 1, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: the mean of a daily series, the bounds that ``level`` of its resampled means lie in, effective_n.

    A resample takes runs of ``block`` dates, in a circle, from seeded starts until
    it is as long as the series: single dates for independent values, longer runs
    where neighbours depend on each other. Resamples are rows of a range joined
    with the series by place; place and seed decide them, not the order of rows.
    """
    spark = by_date.sparkSession
    # one row for each date
    series = by_date.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), (F.row_number().over(Window.orderBy("date")) - 1).alias("place"))
    n = series.count()
    if not n:
        return spark.createDataFrame([(None, None, None, 0)], "mean double, low double, high double, effective_n long")
    at = spark.range(draws * n).select(F.expr(f"id div {n}").alias("draw"), (F.col("id") % n).alias("i"))
    start = F.pmod(F.xxhash64("draw", F.expr(f"i div {block}"), F.lit(seed)), F.lit(n))
    means = at.select("draw", ((start + F.col("i") % block) % n).alias("place")).join(series, "place").groupBy("draw").agg(F.avg("x").alias("m"))
    edge = (1 - level) / 2
    bounds = means.agg(F.percentile("m", F.lit(edge)).alias("low"), F.percentile("m", F.lit(1 - edge)).alias("high"))
    return series.agg(F.avg("x").alias("mean"), F.count("*").alias("effective_n")).crossJoin(bounds).select("mean", "low", "high", "effective_n")  # one row each


def paired_difference(a: DataFrame, b: DataFrame, column: str = "ic", **resampling) -> DataFrame:
    """One row: mean, std, hit rate, t-statistic and bootstrap bounds of a - b over the dates that both have."""
    other = b.select("date", F.col(column).alias("other"))
    diff = a.select("date", column).join(other, "date").select("date", (F.col(column) - F.col("other")).alias("d"))
    return series_summary(diff, "d").drop("effective_n").crossJoin(bootstrap(diff, "d", **resampling).drop("mean"))  # one row each


def quantile_spread(panel: DataFrame, score: str, label: str, top: float = 0.8, bottom: float = 0.2, min_names: int = MIN_NAMES) -> DataFrame:
    """date, t_idx, top and bottom mean labels by percent rank of the score, their spread, and the top decile's mean."""
    rows = usable(panel, score, label).select("date", "t_idx", pct_rank(score, "date").alias("p"), F.col(label).alias("y"))
    mean = lambda c: F.avg(F.when(c, F.col("y")))
    out = rows.groupBy("date", "t_idx").agg(F.count("*").alias("n_names"), mean(F.col("p") >= top).alias("top"), mean(F.col("p") <= bottom).alias("bottom"), mean(F.col("p") >= 0.9).alias("top_decile"))
    return out.where(F.col("n_names") >= min_names).withColumn("spread", F.col("top") - F.col("bottom"))


def fit_metrics(panel: DataFrame, prediction: str, label: str) -> DataFrame:
    """Mean absolute error and R2 against a prediction of zero."""
    y, p = F.col(label), F.col(prediction)
    return usable(panel, prediction, label).agg(F.avg(F.abs(y - p)).alias("mae"), (1 - F.try_divide(F.sum((y - p) * (y - p)), F.sum(y * y))).alias("r2_zero"), F.countDistinct("date").alias("effective_n"))


def auc_inputs(panel: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: how many positives and negatives have it. What meets in the next step is distinct scores."""
    return usable(panel, score, label).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg"))


def auc(panel: DataFrame, score: str, label: str, buckets: int = 64) -> DataFrame:
    """Pooled area under the ROC curve, exact, ties as a half.

    Counts of distinct scores fall into buckets between their quantiles; running
    sums are taken within buckets and offset by the buckets' totals, so no task
    sees them all. The edges come to the driver, so that all uses agree on them.
    """
    counts = auc_inputs(panel, score, label)
    edges = counts.agg(F.percentile_approx("s", [i / buckets for i in range(1, buckets)], 10_000)).first()[0] or []
    bucket = F.lit(0)
    for e in sorted(set(edges)):
        bucket = bucket + (F.col("s") > e).cast("int")
    ranged = counts.withColumn("b", bucket)
    before = ranged.groupBy("b").agg(F.sum("neg").alias("n")).select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("before"))
    below = F.sum("neg").over(Window.partitionBy("b").orderBy("s")) - F.col("neg")
    rows = ranged.withColumn("below", below).join(before, "b")
    won = F.col("pos") * (F.col("below") + F.col("before") + F.col("neg") / 2.0)
    return rows.agg(F.try_divide(F.sum(won), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def probability_metrics(panel: DataFrame, prob: str, label: str) -> DataFrame:
    """Log-loss and Brier score."""
    y, p = F.col(label), F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    return usable(panel, prob, label).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"), F.avg((F.col(prob) - y) * (F.col(prob) - y)).alias("brier"), F.count("*").alias("n_rows"))


def reliability(panel: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Bins of about equal frequency by exact quantiles of the probability: bin, n_rows, mean_prob, rate."""
    rows = usable(panel, prob, label)
    edges = rows.agg(F.percentile(prob, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("edges"))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(prob))))
    return binned.groupBy("bin").agg(F.count("*").alias("n_rows"), F.avg(prob).alias("mean_prob"), F.avg(label).alias("rate"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_prob") - F.col("rate")) * F.col("n_rows")
    return table.agg((F.sum(gap) / F.sum("n_rows")).alias("ece"))


#: Scores that need no fitting.
BASELINES = {
    "baseline_mom12_1": lambda: F.col("mom_12_1"),
    "baseline_rev21": lambda: -F.col("ret_21"),
    "baseline_lowvol": lambda: -F.col("vol_63"),
    "baseline_random": lambda: F.pmod(F.xxhash64("ticker", "date", F.lit(42)), F.lit(1 << 52)) / float(1 << 52),
}


def baseline_scores(raw: DataFrame) -> DataFrame:
    """ticker, date, eligible and the BASELINES; the random one depends on key and seed only."""
    return raw.select("ticker", "date", "eligible", *(make().alias(name) for name, make in BASELINES.items()))


# --- regimes


def regimes(market: DataFrame, least_history: int = 252) -> DataFrame:
    """date, regime_trend, regime_vol, regime from mkt_trend_200 and the percentile of mkt_vol_21 in its history so far.

    The percentile counts each value among those up to its date, which no window
    expresses without going through all of them again for each date: one ordered
    pass over the series, one row for each date, does.
    """
    rows = market.select("date", "mkt_trend_200", "mkt_vol_21")

    def ranked(series: pa.Table) -> pa.Table:
        series, seen, out = series.sort_by("date"), [], []
        for v in series.column("v").to_pylist():
            insort(seen, v)
            a, b = bisect_left(seen, v), bisect_right(seen, v)
            out.append((a + (b - a + 1) / 2.0) / len(seen) if len(seen) >= least_history else None)
        return pa.table([series.column("date"), pa.array(out, pa.float64())], ["date", "vol_pct"])

    history = rows.where("mkt_vol_21 is not null").select("date", F.col("mkt_vol_21").alias("v")).groupBy().applyInArrow(ranked, "date date, vol_pct double")
    trend = F.when(F.col("mkt_trend_200") > 0, "up").when(F.col("mkt_trend_200").isNotNull(), "down")
    vol = F.when(F.col("vol_pct") < 1 / 3, "low").when(F.col("vol_pct") > 2 / 3, "high").when(F.col("vol_pct").isNotNull(), "mid")
    out = rows.join(history, "date", "left").select("date", trend.alias("regime_trend"), vol.alias("regime_vol"))
    return out.withColumn("regime", F.concat("regime_trend", F.lit("_"), "regime_vol"))


# --- equity


def drawdowns(equity: DataFrame) -> DataFrame:
    """model_id, date, nav, peak, drawdown."""
    w = Window.partitionBy("model_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return equity.select("model_id", "date", "nav", F.max("nav").over(w).alias("peak")).withColumn("drawdown", F.col("nav") / F.col("peak") - 1)


def performance(equity: DataFrame) -> DataFrame:
    """By model: CAGR, volatility, Sharpe, Sortino, largest drawdown, Calmar, hit rate, number of days. equity: model_id, date, nav, ret."""
    dd = drawdowns(equity).groupBy("model_id").agg(F.min("drawdown").alias("max_drawdown"))
    year = math.sqrt(252)
    loss = F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).otherwise(0.0)
    stats = equity.groupBy("model_id").agg(
        F.count("*").alias("n_days"), F.max_by("nav", "date").alias("last"), F.min_by("nav", "date").alias("first"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.sqrt(F.avg(loss)).alias("d"), F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate")
    )
    out = stats.join(dd, "model_id")
    cagr = F.pow(F.col("last") / F.col("first"), F.lit(252.0) / F.col("n_days")) - 1
    return out.select("model_id", "n_days", cagr.alias("cagr"), (F.col("s") * year).alias("volatility"), (F.try_divide("m", "s") * year).alias("sharpe"), (F.try_divide("m", "d") * year).alias("sortino"), "max_drawdown", F.try_divide(cagr, F.abs("max_drawdown")).alias("calmar"), "hit_rate")


def probabilistic_sharpe(equity: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """By model the argument of the normal distribution in the probabilistic Sharpe ratio, from daily moments."""
    s = equity.where("ret is not null").groupBy("model_id").agg(F.count("*").alias("t"), (F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.skewness("ret").alias("g3"), (F.kurtosis("ret") + 3).alias("g4"))
    z = (F.col("sr") - benchmark) * F.sqrt(F.col("t") - 1) / F.sqrt(1 - F.col("g3") * F.col("sr") + (F.col("g4") - 1) / 4 * F.col("sr") * F.col("sr"))
    return s.select("model_id", "sr", z.alias("psr_z"), F.col("t").alias("n_days"))


def relative_performance(equity: DataFrame, benchmark: str) -> DataFrame:
    """By model against one of them: tracking error, information ratio, beta, yearly alpha, yearly turnover and cost over the mean net value."""
    base = equity.where(F.col("model_id") == benchmark).select("date", F.col("ret").alias("b"))
    rows = equity.join(base, "date").withColumn("active", F.col("ret") - F.col("b"))
    s = rows.groupBy("model_id").agg(
        F.count("*").alias("n_days"), (F.stddev_samp("active") * math.sqrt(252)).alias("tracking_error"), (F.avg("active") * 252).alias("gain"), F.covar_samp("ret", "b").alias("cov"), F.var_samp("b").alias("var"), F.avg("ret").alias("m"), F.avg("b").alias("mb"),
        F.sum("turnover").alias("turnover"), (F.sum("cost") / F.avg("nav")).alias("cost"),
    )
    beta, year = F.try_divide("cov", "var"), F.lit(252.0) / F.col("n_days")
    return s.select("model_id", "n_days", "tracking_error", F.try_divide("gain", "tracking_error").alias("information_ratio"), beta.alias("beta"), ((F.col("m") - beta * F.col("mb")) * 252).alias("alpha"), (F.col("turnover") * year).alias("turnover_year"), (F.col("cost") * year).alias("cost_year"))


def deflated_sharpe(equity: DataFrame, trials: int, variance: float) -> DataFrame:
    """probabilistic_sharpe against the largest daily Sharpe ratio that ``trials`` tries without skill, whose ratios have that variance, lead one to expect."""
    normal, euler = NormalDist(), 0.5772156649015329
    expected = math.sqrt(variance) * ((1 - euler) * normal.inv_cdf(1 - 1 / trials) + euler * normal.inv_cdf(1 - 1 / (trials * math.e))) if trials > 1 else 0.0
    return probabilistic_sharpe(equity, expected).withColumnRenamed("psr_z", "dsr_z").withColumn("expected_sr", F.lit(expected))


def rolling_volatility(equity: DataFrame, n: int = 21) -> DataFrame:
    w = trailing(n, "model_id", "date")
    return equity.select("model_id", "date", (full(F.stddev_samp, "ret", n, w) * math.sqrt(252)).alias("vol"))
