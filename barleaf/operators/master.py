"""The security master: curated facts and derived ones, one row for each ticker."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.errors import SecurityMasterError
from barleaf.functions.exprs import framed_median
from barleaf.operators.keys import assert_none

CURATED = ("ticker", "issuer_id", "share_class", "exclusion_reason", "stitching_suspect", "notes")
MASTER = (*CURATED, "first_date", "last_date", "n_obs", "cohort", "zero_volume_share", "median_dollar_volume_last_year", "include_in_universe", "status_reason")
LAST_YEAR = 252
ORIGINAL = dt.date(2000, 1, 3)
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no", "")


def normalise_curated(raw: DataFrame, checked: bool = True) -> DataFrame:
    """Strings stripped, blanks for missing, issuer from ticker where blank, suspect as boolean."""
    if tuple(raw.columns) != CURATED:
        raise SecurityMasterError(f"curated columns are {raw.columns}")
    rows = raw.select(*(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in CURATED))
    low = F.lower("stitching_suspect")
    if checked:
        check_curated(rows)
    return rows.withColumns({"stitching_suspect": low.isin(*TRUE), "issuer_id": F.when(F.col("issuer_id") == "", F.col("ticker")).otherwise(F.col("issuer_id"))})


def check_curated(rows: DataFrame) -> None:
    low = F.lower("stitching_suspect")
    assert_none(rows, SecurityMasterError, blank_ticker=F.col("ticker") == "", bad_boolean=~low.isin(*TRUE, *FALSE))
    if rows.groupBy("ticker").count().where("count > 1").limit(1).count():
        raise SecurityMasterError("curated tickers repeat")


def unknown_tickers(curated: DataFrame, silver: DataFrame) -> DataFrame:
    return curated.select("ticker").join(silver.select("ticker").distinct(), "ticker", "left_anti")


def derived(silver: DataFrame, original: dt.date = ORIGINAL) -> DataFrame:
    """Facts of each ticker from its bars: two aggregates over one partitioning."""
    last = Window.partitionBy("ticker").orderBy(F.desc("date"))
    rows = silver.select("ticker", "date", (F.col("volume") == 0).alias("zero"), (F.col("close") * F.col("volume").cast("double")).alias("dv"), F.row_number().over(last).alias("back"))
    return rows.groupBy("ticker").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("n_obs"),
        F.when(F.min("date") == F.lit(original), F.lit("orig2000")).otherwise(F.lit("later")).alias("cohort"),
        F.avg(F.col("zero").cast("double")).alias("zero_volume_share"),
        framed_median(F.when(F.col("back") <= LAST_YEAR, F.col("dv"))).alias("median_dollar_volume_last_year"),
    )


def build_master(silver: DataFrame, curated: DataFrame | None, max_zero_volume_share: float, original: dt.date = ORIGINAL, checked: bool = True) -> DataFrame:
    """Curated rows override the defaults; an exclusion or too many bars without volume leaves a ticker out."""
    if checked:
        assert_none(silver, SecurityMasterError, missing=F.col("ticker").isNull() | F.col("date").isNull() | F.col("close").isNull() | F.col("volume").isNull())
    base = derived(silver, original)
    if curated is None:
        rows = base.select("*", *(F.lit(None).cast("boolean" if c == "stitching_suspect" else "string").alias(c) for c in CURATED[1:]))
    else:
        curated = normalise_curated(curated, checked)
        if checked and (bad := unknown_tickers(curated, silver).limit(5).collect()):
            raise SecurityMasterError(f"curated tickers without data: {[r.ticker for r in bad]}")
        rows = base.join(curated, "ticker", "left")
    rows = rows.withColumns({
        "issuer_id": F.coalesce("issuer_id", "ticker"),
        "stitching_suspect": F.coalesce("stitching_suspect", F.lit(False)),
        **{c: F.coalesce(c, F.lit("")) for c in ("share_class", "exclusion_reason", "notes")},
    })
    too_many = F.col("zero_volume_share") > max_zero_volume_share
    percent = F.format_string("%.1f%%", F.col("zero_volume_share") * 100)
    reason = F.concat_ws(
        "; ",
        F.when(F.col("exclusion_reason") != "", F.concat(F.lit("curated: "), "exclusion_reason")),
        F.when(too_many, F.concat(F.lit("quality rule: zero-volume share "), percent, F.lit(f" > {max_zero_volume_share * 100:.1f}%"))),
    )
    return rows.withColumns({"include_in_universe": ~(too_many | (F.col("exclusion_reason") != "")), "status_reason": reason}).select(*MASTER)
