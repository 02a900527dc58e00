"""Columns that Spark lacks, against plain Python."""

import math
from statistics import NormalDist, median

import pytest
from pyspark.sql import functions as F

from barleaf.functions import exprs


def one(spark, column, **values):
    kinds = ", ".join(f"{k} double" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_guarded_logs(spark):
    assert one(spark, exprs.safe_ln("a"), a=math.e) == pytest.approx(1)
    assert one(spark, exprs.safe_ln("a"), a=0.0) is None and one(spark, exprs.safe_ln("a"), a=-1.0) is None
    assert one(spark, exprs.ln_ratio("a", "b"), a=2.0, b=0.0) is None
    assert one(spark, exprs.null_nan("a"), a=float("nan")) is None and one(spark, exprs.null_nan("a"), a=float("inf")) is None


def test_clip_keeps_missing_values_missing(spark):
    clip = exprs.clip(F.col("x"), F.col("a"), F.col("b"))
    assert one(spark, clip, x=5.0, a=1.0, b=3.0) == 3.0 and one(spark, clip, x=0.0, a=1.0, b=3.0) == 1.0
    assert one(spark, clip, x=None, a=1.0, b=3.0) is None and one(spark, clip, x=2.0, a=None, b=3.0) is None


def test_inverse_normal_in_every_branch(spark):
    ps = [1e-300, 1e-20, 1e-9, 1e-4, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.924, 0.926, 0.99, 0.9999999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select("p", exprs.inverse_normal("p").alias("z"))
    for r in df.collect():
        if r.p in (None, 0.0, 1.0):
            assert r.z is None
        else:
            assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-9, rel=1e-12)


def test_average_and_pct_rank_with_ties_and_gaps(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("a", 5.0), ("b", 3.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double").select("g", "x", exprs.average_rank("x", "g").alias("r"), exprs.pct_rank("x", "g").alias("p"))
    got = {(r.g, r.x): (r.r, r.p) for r in df.collect()}
    assert got[("a", 1.0)] == (1.0, 0.25) and got[("a", 2.0)] == (2.5, 0.625) and got[("a", 5.0)] == (4.0, 1.0)
    assert got[("a", None)] == (None, None) and got[("b", 3.0)] == (1.0, 1.0)


def test_full_windows_and_framed_median(spark):
    xs = [3.0, None, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "ticker string, t_idx int, x double")
    got = df.select("t_idx", exprs.full(exprs.framed_median, "x", 3, exprs.trailing(3)).alias("m"), exprs.full(F.avg, "x", 3, exprs.trailing(3)).alias("a")).orderBy("t_idx").collect()
    for i, r in enumerate(got):
        w = xs[max(0, i - 2) : i + 1]
        ok = len(w) == 3 and None not in w
        assert r.m == (median(w) if ok else None)
        assert (r.a == pytest.approx(sum(w) / 3)) if ok else r.a is None
