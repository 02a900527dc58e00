"""Linear models over purged folds: fits, calibration, tuning, walk-forward predictions and permutation importance.

Like ``evaluate`` these stages are specified where this library's other operators
come from, not implemented there. Fits read sums only. A ridge fit needs sums of
products: they are added up by date once, and every fold and penalty adds up
dates. A logistic fit goes through the rows once for each Newton step, for all
folds together. What comes to the driver is a matrix of features by features for
each fold. Missing features count as 0, the middle of a normal score.

panel: ticker, date, t_idx, eligible, features, targets; fold tables are those of
``folds.as_table``. Predictions are for all eligible rows of a test block, with
or without label.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barleaf.errors import StageError
from barleaf.functions.exprs import pct_rank
from barleaf.operators import evaluate
from barleaf.operators.folds import CALIBRATION, CORE, TEST

#: The penalties that are tried.
ALPHAS, LOGIT_CS = (1.0, 10.0, 100.0, 1000.0, 10000.0), (0.001, 0.01, 0.1, 1.0)
#: Newton steps, and the change below which the next step would be far smaller still.
STEPS, TOLERANCE = 25, 1e-6


@dataclass
class Linear:
    """bias + weights . x by fold."""

    features: list[str]
    weights: dict[str, np.ndarray]
    bias: dict[str, float]
    rows: dict[str, int] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        """fold_id, bias, weights: a row for each fold."""
        return spark.createDataFrame([(k, float(self.bias[k]), [float(x) for x in w]) for k, w in sorted(self.weights.items())], "fold_id string, bias double, weights array<double>")

    def predict(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` (with fold_id) and the linear predictor as column ``name``."""
        out = rows.join(self.table(rows.sparkSession), "fold_id")
        value: Column = F.col("bias")
        for i, c in enumerate(self.features):
            value = value + F.get("weights", F.lit(i)) * filled(c)
        return out.withColumn(name, value).drop("bias", "weights")


def filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def of_role(panel: DataFrame, folds: DataFrame, *roles: str) -> DataFrame:
    """Eligible panel rows of the blocks, once for each fold that has their date; fold_id and role are added."""
    return panel.where("eligible").join(folds.where(F.col("role").isin(*roles)).select("fold_id", "role", "t_idx"), "t_idx")


def products(features: list[str], weight: Column, target: Column) -> dict[str, Column]:
    """Sums that a weighted least-squares fit of ``target`` needs: of the upper triangle of x x', and of x y, where x starts with 1."""
    x = [F.lit(1.0), *(filled(c) for c in features)]
    out = {f"xx_{i}_{j}": F.sum(weight * x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    return out | {f"xy_{i}": F.sum(weight * x[i] * target) for i in range(len(x))}


def matrices(row, n: int) -> tuple[np.ndarray, np.ndarray]:
    xx = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            xx[i, j] = xx[j, i] = row[f"xx_{i}_{j}"]
    return xx, np.array([row[f"xy_{i}"] for i in range(n)])


def penalty(n: int, alpha: float) -> np.ndarray:
    """The intercept is free."""
    return np.diag([0.0, *[alpha] * (n - 1)])


def ridge(panel: DataFrame, folds: DataFrame, features: list[str], target: str, alphas: list[float]) -> dict[float, Linear]:
    """A model for each penalty, fitted on the core rows of each fold that have the target."""
    y = F.col(target)
    labelled = panel.where(F.col("eligible") & y.isNotNull())
    named = products(features, F.lit(1.0), y)
    by_date = labelled.groupBy("t_idx").agg(*(c.alias(k) for k, c in named.items()))
    sums = by_date.join(folds.where(F.col("role") == CORE).select("fold_id", "t_idx"), "t_idx").groupBy("fold_id").agg(*(F.sum(k).alias(k) for k in named))
    got, n = {r.fold_id: r for r in sums.collect()}, len(features) + 1
    if not got:
        raise StageError("no fold has a row to fit on")
    out = {}
    for alpha in alphas:
        w = {k: np.linalg.solve(xx + penalty(n, alpha), xy) for k, (xx, xy) in ((k, matrices(r, n)) for k, r in got.items())}
        out[alpha] = Linear(list(features), {k: x[1:] for k, x in w.items()}, {k: float(x[0]) for k, x in w.items()}, {k: round(r["xx_0_0"]) for k, r in got.items()})
    return out


def logistic(rows: DataFrame, features: list[str], target: str, l2: float) -> Linear:
    """Newton steps for all folds at once. rows: fold_id, features, target 0 or 1; l2: weight of half the squared norm."""
    n, w = len(features) + 1, {}
    rows = rows.where(F.col(target).isNotNull()).select("fold_id", *features, F.col(target).alias("__y"))
    for step in range(STEPS):
        model = Linear(features, {k: x[1:] for k, x in w.items()}, {k: x[0] for k, x in w.items()})
        at = model.predict(rows, "__z") if step else rows.withColumn("__z", F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(F.col("__z"), F.lit(-30.0)), F.lit(30.0))))
        at = at.withColumn("__p", p)
        sums = products(features, F.col("__p") * (1 - F.col("__p")), F.lit(0.0)) | {f"xy_{i}": F.sum((F.col("__y") - F.col("__p")) * x) for i, x in enumerate([F.lit(1.0), *(filled(c) for c in features)])}
        got = at.groupBy("fold_id").agg(*(c.alias(k) for k, c in sums.items())).collect()
        moved = 0.0
        for r in got:
            xx, xy = matrices(r, n)
            before = w.get(r.fold_id, np.zeros(n))
            # a little room on the intercept keeps the step defined where all targets are alike
            change = np.linalg.solve(xx + penalty(n, l2) + 1e-9 * np.eye(n), xy - penalty(n, l2) @ before)
            w[r.fold_id] = before + change
            moved = max(moved, float(np.abs(change).max()))
        if moved < TOLERANCE:
            break
    if not w:
        raise StageError("no fold has a row to fit on")
    return Linear(list(features), {k: x[1:] for k, x in w.items()}, {k: float(x[0]) for k, x in w.items()})


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(x) if isinstance(x, str) else x)))


@dataclass
class WalkForward:
    """predictions: fold_id, ticker, date, t_idx, eligible, pred_excess, prob_raw, prob_cal, rank_pct; meta: a row for each fold."""

    predictions: DataFrame
    meta: DataFrame
    ridge: Linear
    logit: Linear


def walk_forward(panel: DataFrame, folds: DataFrame, features: list[str], y_reg: str, y_cls: str, alpha: float = 100.0, c: float = 0.1, log=None) -> WalkForward:
    """Ridge and logistic models on each fold's core, Platt scaling on its calibration block, predictions on its test block.

    Nothing is fitted again after calibration. log: a ``leakage.FitLog`` that sees
    what the classifier and the scaling read.
    """
    spark = panel.sparkSession
    reg = ridge(panel, folds, features, y_reg, [alpha])[alpha]
    core, calibration = of_role(panel, folds, CORE).where(F.col(y_cls).isNotNull()), of_role(panel, folds, CALIBRATION).where(F.col(y_cls).isNotNull())
    watch = (lambda df: log.watch(df)) if log is not None else (lambda df: df)
    logit = logistic(watch(core.select("fold_id", "t_idx", *features, y_cls)), features, y_cls, 1.0 / c)
    scaling = logistic(logit.predict(watch(calibration.select("fold_id", "t_idx", *features, y_cls)), "__score").select("fold_id", "__score", y_cls), ["__score"], y_cls, 0.0)
    tests = reg.predict(logit.predict(of_role(panel, folds, TEST), "__score"), "pred_excess")
    rows = scaling.predict(tests, "__scaled").select("fold_id", "ticker", "date", "t_idx", "eligible", "pred_excess", sigmoid("__score").alias("prob_raw"), sigmoid("__scaled").alias("prob_cal"))
    rates = core.groupBy("fold_id").agg(F.avg(y_cls).alias("train_base_rate"), F.count("*").alias("n_core"), F.min("t_idx").alias("core_first"), F.max("t_idx").alias("core_last"))
    meta = rates.join(reg.table(spark), "fold_id").withColumns({"alpha": F.lit(alpha), "c": F.lit(c), "units_are_returns": F.lit(True)})
    return WalkForward(rows.withColumn("rank_pct", pct_rank("pred_excess", "fold_id", "date")), meta, reg, logit)


def tune_ridge(panel: DataFrame, folds: DataFrame, features: list[str], y_reg: str, label: str, alphas: tuple[float, ...] = ALPHAS, *, least_names: int = evaluate.MIN_NAMES, anchor: int = evaluate.ANCHOR, every: int = evaluate.EVERY) -> DataFrame:
    """alpha, mean_ic, std_ic, effective_n over the non-overlapping dates of all validation blocks. The best is the one with the largest mean_ic, ties to the larger penalty."""
    tests, out = of_role(panel, folds, TEST), None
    for alpha, model in ridge(panel, folds, features, y_reg, list(alphas)).items():
        ic = evaluate.non_overlapping(evaluate.rank_ic(model.predict(tests, "pred_excess"), "pred_excess", label, least_names), anchor, every)
        row = evaluate.series_summary(ic).select(F.lit(alpha).alias("alpha"), F.col("mean").alias("mean_ic"), F.col("std").alias("std_ic"), "effective_n")
        out = row if out is None else out.union(row)
    return out


def best_alpha(tuned: DataFrame) -> float:
    return tuned.orderBy(F.desc_nulls_last("mean_ic"), F.desc("alpha")).first().alpha


def tune_logistic(panel: DataFrame, folds: DataFrame, features: list[str], y_cls: str, cs: tuple[float, ...] = LOGIT_CS) -> DataFrame:
    """c, log_loss, n_rows on the validation blocks. The best has the smallest loss."""
    core, tests, out = of_role(panel, folds, CORE), of_role(panel, folds, TEST), None
    for c in cs:
        scored = logistic(core, features, y_cls, 1.0 / c).predict(tests, "__score").withColumn("prob", sigmoid("__score"))
        row = evaluate.probability_metrics(scored, "prob", y_cls).select(F.lit(c).alias("c"), "log_loss", "n_rows")
        out = row if out is None else out.union(row)
    return out


# --- importance


def permutation_importance(panel: DataFrame, folds: DataFrame, model: Linear, groups: dict[str, list[str]], label: str, *, repeats: int = 10, seed: int = 42, least_names: int = evaluate.MIN_NAMES, anchor: int = evaluate.ANCHOR, every: int = evaluate.EVERY) -> DataFrame:
    """fold_id, group, ic_baseline, ic_permuted_mean, drop, drop_std: how much the mean rank IC of a fold's test loses when a group of features is permuted within dates.

    A linear score is a sum of the groups' parts, so a permuted score is the
    score with one part of another row. Row i of a date takes the parts of the row
    that is i-th in a seeded order, one order for a date and repeat; all groups and
    repeats are rows of one plan.
    """
    names = [g for g, columns in groups.items() if set(columns) & set(model.features)]
    if not names:
        raise StageError("no group holds a feature of the model")
    tests = evaluate.non_overlapping(of_role(panel, folds, TEST).where(F.col(label).isNotNull()), anchor, every)
    rows = tests.join(model.table(panel.sparkSession), "fold_id")
    own = [sum((F.get("weights", F.lit(i)) * filled(c) for i, c in enumerate(model.features) if c in groups[g]), F.lit(0.0)) for g in names]
    every_part = sum((F.get("weights", F.lit(i)) * filled(c) for i, c in enumerate(model.features)), F.lit(0.0))
    keys = ["fold_id", "date"]
    rows = rows.select(*keys, "t_idx", "eligible", "ticker", F.col(label).alias("y"), every_part.alias("score"), F.array(*own).alias("parts"))
    again = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    by = Window.partitionBy(*keys, "repeat")
    placed = again.withColumn("i", F.row_number().over(by.orderBy("ticker")))
    other = again.select(*keys, "repeat", F.row_number().over(by.orderBy(F.xxhash64("ticker", "date", "repeat", F.lit(seed)), "ticker")).alias("i"), F.col("parts").alias("given"))
    both = placed.join(other, [*keys, "repeat", "i"]).select(*keys, "t_idx", "eligible", "y", "repeat", "score", "given", F.posexplode("parts").alias("k", "part"))
    moved = both.select(*keys, "t_idx", "eligible", "y", "repeat", "k", (F.col("score") - F.col("part") + F.element_at("given", F.col("k") + 1)).alias("score"))
    base = evaluate.rank_ic(rows, "score", "y", least_names, by=("fold_id",)).groupBy("fold_id").agg(F.avg("ic").alias("ic_baseline"))
    runs = evaluate.rank_ic(moved, "score", "y", least_names, by=("fold_id", "k", "repeat")).groupBy("fold_id", "k", "repeat").agg(F.avg("ic").alias("ic"))
    out = runs.join(base, "fold_id").withColumn("drop", F.col("ic_baseline") - F.col("ic"))
    group = F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1)
    return out.groupBy("fold_id", group.alias("group")).agg(F.first("ic_baseline").alias("ic_baseline"), F.avg("ic").alias("ic_permuted_mean"), F.avg("drop").alias("drop"), F.stddev_samp("drop").alias("drop_std"))


def importance_stability(importance: DataFrame) -> DataFrame:
    """group, mean_drop, sign_share: how many folds agree with the sign of the group's mean drop."""
    mean = F.avg("drop").over(Window.partitionBy("group"))
    rows = importance.select("group", "drop", mean.alias("mean_drop"))
    return rows.groupBy("group").agg(F.first("mean_drop").alias("mean_drop"), F.avg((F.signum("drop") == F.signum("mean_drop")).cast("double")).alias("sign_share"))
