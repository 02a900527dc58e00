"""Linear models against NumPy, on noise and on planted signals; calibration, tuning and importance."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barleaf.errors import LeakageError, StageError
from barleaf.operators import folds, leakage, models
from barleaf.sources import synthetic

FEATURES = ["a", "b", "c"]
SPACING = folds.Spacing(5, 1, 30, 2, 3)


def rows(days=200, names=25, strength=0.5, seed=1):
    """ticker, date, t_idx, eligible, a, b, c, y, cls: the label follows a; some features and labels are missing."""
    rng, out = np.random.default_rng(seed), []
    for t, date in enumerate(synthetic.business_days(dt.date(2020, 1, 6), days)):
        x = rng.normal(size=(3, names))
        y = strength * x[0] + rng.normal(size=names)
        for k in range(names):
            label = None if t >= days - 6 or rng.random() < 0.02 else float(y[k])
            out.append((f"N{k:02d}", date, t, bool(rng.random() < 0.95), *(None if rng.random() < 0.03 else float(v) for v in x[:, k]), label, None if label is None else float(label > 0)))
    return out


SCHEMA = "ticker string, date date, t_idx int, eligible boolean, a double, b double, c double, y double, cls double"


@pytest.fixture(scope="module")
def world(spark):
    data = rows()
    made = [folds.make_fold("f1", folds.DEV, 2020, (120, 149), SPACING), folds.make_fold("f2", folds.DEV, 2020, (150, 199), SPACING)]
    return data, spark.createDataFrame(data, SCHEMA).cache(), made, folds.as_table(spark, made).cache()


def design(data, dates, target):
    use = [r for r in data if r[2] in set(dates) and r[3] and r[target] is not None]
    return np.array([[1.0, *(v or 0.0 for v in r[4:7])] for r in use]), np.array([r[target] for r in use])


def newton(x, y, l2):
    w, keep = np.zeros(x.shape[1]), np.diag([0.0] + [l2] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
    return w


def test_ridge_against_numpy(world):
    data, panel, made, table = world
    got = models.ridge(panel, table, FEATURES, "y", [1.0, 100.0])
    for alpha, model in got.items():
        for f in made:
            x, y = design(data, f.core, 7)
            want = np.linalg.solve(x.T @ x + np.diag([0.0, alpha, alpha, alpha]), x.T @ y)
            assert np.allclose([model.bias[f.fold_id], *model.weights[f.fold_id]], want) and model.rows[f.fold_id] == len(y)


def test_walk_forward_against_numpy(spark, world):
    data, panel, made, table = world
    log = leakage.FitLog()
    out = models.walk_forward(panel, table, FEATURES, "y", "cls", 10.0, 0.1, log)
    got = {(r.fold_id, r.ticker, r.t_idx): r for r in out.predictions.collect()}
    # every eligible row of a test has a prediction, also the last ones without a label
    assert set(got) == {(f.fold_id, r[0], r[2]) for f in made for r in data if r[2] in f.test and r[3]}
    for f in made:
        x, y = design(data, f.core, 7)
        ridge = np.linalg.solve(x.T @ x + np.diag([0.0, 10, 10, 10]), x.T @ y)
        x, y = design(data, f.core, 8)
        logit = newton(x, y, 10.0)
        xc, yc = design(data, f.calibration, 8)
        scale = newton(np.column_stack([np.ones(len(xc)), xc @ logit]), yc, 0.0)
        for r in data:
            if r[2] in f.test and r[3]:
                v = np.array([1.0, *(a or 0.0 for a in r[4:7])])
                p = got[f.fold_id, r[0], r[2]]
                assert p.pred_excess == pytest.approx(v @ ridge) and p.prob_raw == pytest.approx(1 / (1 + np.exp(-v @ logit))) and p.prob_cal == pytest.approx(1 / (1 + np.exp(-scale[0] - scale[1] * (v @ logit))), abs=1e-6)
    meta = {r.fold_id: r for r in out.meta.collect()}
    assert all(meta[f.fold_id].core_last == f.core[-1] and meta[f.fold_id].n_core == len(design(data, f.core, 8)[1]) for f in made)
    # no fit saw a date after its fold's training; the classifier saw the core, the scaling the calibration block
    assert max(r["last"] for r in log.table(spark).collect()) <= max(f.train_end for f in made)
    log.assert_until(spark, made[-1].train_end)
    with pytest.raises(LeakageError):
        log.assert_until(spark, made[0].train_end - 1)


def test_tuning_prefers_what_ranks_better(world):
    _, panel, _, table = world
    tuned = models.tune_ridge(panel, table, FEATURES, "y", "y", (1.0, 1e4), anchor=120, every=5)
    assert {r.alpha for r in tuned.collect()} == {1.0, 1e4} and models.best_alpha(tuned) in (1.0, 1e4)
    assert all(r.mean_ic > 0.2 for r in tuned.collect())
    losses = {r.c: r.log_loss for r in models.tune_logistic(panel, table, FEATURES, "cls", (0.0001, 0.1)).collect()}
    assert losses[0.1] < losses[0.0001] < 0.7


def test_planted_signals_are_found_and_noise_is_not(spark, world):
    made, table = world[2], world[3]

    def run(data, seed):
        from barleaf.operators import evaluate

        panel = spark.createDataFrame(data, SCHEMA)
        out = models.ridge(panel, table, FEATURES, "y", [10.0])[10.0].predict(models.of_role(panel, table, folds.TEST), "p")
        return evaluate.rank_ic(out, "p", "y"), evaluate.auc(out, "p", "cls").first().auc

    ics, auc = run(rows(strength=1.5, seed=5), 0)
    assert ics.agg(F.avg("ic")).first()[0] > 0.5 and auc > 0.6
    out = leakage.null_panel_test(run, lambda seed: rows(strength=0.0, seed=100 + seed), range(10), leakage.NullLimits(auc=0.04))
    assert out["n_seeds"] == 10 and made


def test_importance_of_the_planted_group(spark, world):
    _, panel, _, table = world
    model = models.ridge(panel, table, FEATURES, "y", [1.0])[1.0]
    groups = {"signal": ["a"], "noise": ["b", "c"], "none": ["zz"]}
    make = lambda seed: models.permutation_importance(panel, table, model, groups, "y", repeats=5, seed=seed, least_names=5, anchor=120, every=1)
    got = {(r.fold_id, r.group): r for r in make(1).collect()}
    assert {g for _, g in got} == {"signal", "noise"}
    for f in ("f1", "f2"):
        assert got[f, "signal"].drop > 0.2 and abs(got[f, "noise"].drop) < 0.1 and got[f, "signal"].ic_baseline == got[f, "noise"].ic_baseline
    again = {(r.fold_id, r.group): r for r in make(1).collect()}
    assert all(again[k][2:] == pytest.approx(got[k][2:], abs=1e-9) for k in got)
    stable = {r.group: r for r in models.importance_stability(make(1)).collect()}
    assert stable["signal"].sign_share == 1.0
    with pytest.raises(StageError):
        models.permutation_importance(panel, table, model, {"none": ["zz"]}, "y")
