"""Validation: hard checks that stop a build, soft ones that are only reported."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.config import Flags
from barleaf.errors import ValidationError
from barleaf.functions.exprs import ln_ratio
from barleaf.operators.calendar import with_t_idx
from barleaf.operators.flags import BRONZE, FLAGS, by_ticker
from barleaf.operators.keys import bad_number, count_where, repeated_keys

TYPES = {"ticker": "string", "date": "date", "open": "double", "high": "double", "low": "double", "close": "double", "adj_close": "double", "volume": "bigint"}
LARGE_MOVE = 0.4
PRICES = ("open", "high", "low", "close", "adj_close")


def null_counts(bronze: DataFrame) -> DataFrame:
    """column, n_missing: one pass over all required columns."""
    counts = bronze.agg(*(F.count_if(bad_number(c) if TYPES[c] == "double" else F.col(c).isNull()).alias(c) for c in BRONZE))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, BRONZE)), F.array(*BRONZE))).alias("column", "n_missing"))


def ohlc_violations(bronze: DataFrame) -> DataFrame:
    """Rows whose high or low does not bound the others, or whose prices aren't positive, with the rule broken."""
    rules = F.array(
        F.when(F.col("high") < F.greatest("open", "close"), F.lit("high_bounds")),
        F.when(F.col("low") > F.least("open", "close"), F.lit("low_bounds")),
        F.when(F.col("high") < F.col("low"), F.lit("high_below_low")),
        F.when(F.least(*PRICES) <= 0, F.lit("not_positive")),
        F.when(F.col("volume") < 0, F.lit("negative_volume")),
    )
    return bronze.select("ticker", "date", F.explode(F.array_compact(rules)).alias("rule"))


def calendar_gaps(bronze: DataFrame, calendar: DataFrame) -> DataFrame:
    """Tickers that miss calendar dates between their first and last: ticker, n_missing, first_missing."""
    rows = with_t_idx(bronze.select("ticker", "date"), calendar)
    spans = rows.groupBy("ticker").agg(F.min("t_idx").alias("a"), F.max("t_idx").alias("b"), F.countDistinct("t_idx").alias("n")).where("b - a + 1 <> n")
    every = spans.select("ticker", F.explode(F.sequence("a", "b")).alias("t_idx"))
    missing = every.join(rows.select("ticker", "t_idx"), ["ticker", "t_idx"], "left_anti").join(calendar.select("t_idx", "date"), "t_idx")
    return missing.groupBy("ticker").agg(F.count("*").alias("n_missing"), F.min("date").alias("first_missing"))


def hard_checks(bronze: DataFrame, calendar: DataFrame) -> list[dict]:
    """name, severity, passed, count, message, examples. A wrong schema ends the list at once.

    File order has no meaning for a DataFrame; instead of "sorted", keys must be unique.
    """
    found = dict(bronze.dtypes)
    wrong = [f"{c}: {found.get(c)} for {t}" for c, t in TYPES.items() if found.get(c) != t]
    out = [result("schema", "hard", len(wrong), "; ".join(wrong))]
    if wrong:
        return out
    n = count_where(
        bronze,
        no_missing=F.greatest(*(F.when(bad_number(c) if TYPES[c] == "double" else F.col(c).isNull(), 1).otherwise(0) for c in BRONZE)) == 1,
        positive_prices=F.least(*PRICES) <= 0,
        volume_not_negative=F.col("volume") < 0,
        high_bounds=F.col("high") < F.greatest("open", "close"),
        low_bounds=F.col("low") > F.least("open", "close"),
        high_not_below_low=F.col("high") < F.col("low"),
    )
    out += [result(name, "hard", k, f"{k} rows") for name, k in n.items()]
    repeated = repeated_keys(bronze)
    some = repeated.limit(5).collect()
    out.append(result("unique_keys", "hard", repeated.count() if some else 0, "repeated keys", [str(r.asDict()) for r in some]))
    gaps = calendar_gaps(bronze, calendar)
    some = gaps.orderBy("ticker").limit(5).collect()
    out.append(result("no_gaps", "hard", gaps.count() if some else 0, "tickers with gaps", [str(r.asDict()) for r in some]))
    return out


def result(name: str, severity: str, count: int, message: str = "", examples: list[str] | None = None) -> dict:
    return {"name": name, "severity": severity, "passed": not count, "count": int(count), "message": message, "examples": examples or []}


def assert_passed(results: list[dict]) -> None:
    if failed := [r for r in results if r["severity"] == "hard" and not r["passed"]]:
        raise ValidationError(failed)


#: Two share classes of one issuer, which should move together, and by how much.
SHARE_CLASSES, LEAST_CORRELATION = (("GOOG", "GOOGL"),), 0.99


def expectations(source: str | None) -> dict[str, object]:
    """The expected values of a JSON text, or of a JSON or YAML file; the sections of a file are taken together."""
    if not source:
        return {}
    text = source if source.lstrip().startswith("{") else Path(source).read_text(encoding="utf-8")
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text) or {}
    flat = {}
    for k, v in found.items():
        flat |= v if isinstance(v, dict) else {k: v}
    return flat


def measured(bronze: DataFrame, calendar: DataFrame, low_close: float) -> dict[str, object]:
    """What expectations can name, without their prefix ``expected_``: two aggregates, by ticker and over these."""
    bad = F.greatest(*(F.when(bad_number(c) if TYPES[c] == "double" else F.col(c).isNull(), 1).otherwise(0) for c in BRONZE))
    by = bronze.groupBy("ticker").agg(
        F.count("*").alias("n"), F.countDistinct("date").alias("dates"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(F.col("volume") == 0).alias("idle"), F.count_if(F.col("close") < low_close).alias("low"), F.sum(bad).alias("bad"),
    )
    r = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "dates", "idle", "low", "bad")), F.count("*").alias("tickers"), F.min("first").alias("first"), F.max("last").alias("last"), F.map_from_entries(F.collect_list(F.struct("ticker", "idle"))).alias("idle_by")).first()
    out = {
        "rows": r.n, "n_rows": r.n, "tickers": r.tickers, "n_tickers": r.tickers, "trading_days": calendar.count(), "date_min": str(r["first"]), "date_max": str(r["last"]),
        "zero_volume_total": r.idle, f"close_under_{low_close:g}_rows": r.low, "duplicates": r.n - r.dates, "nulls": r.bad,
    }
    return out | {"n_dates": out["trading_days"]} | {f"{ticker.lower()}_zero_volume": n for ticker, n in (r.idle_by or {}).items()}


def soft_checks(bronze: DataFrame, calendar: DataFrame, settings: Flags, expected: dict[str, object] | None = None) -> list[dict]:
    """What is only reported: values that differ from expected ones, and findings that a reader should know. Examples are small aggregates."""
    facts, out = measured(bronze, calendar, settings.tick_noise_min_close), []
    for key, want in (expected or {}).items():
        if (name := key.removeprefix("expected_")) in facts:
            have = facts[name]
            out.append(result(f"expected_{name}", "soft", int(str(have) != str(want)), f"{have} for {want}"))
    limit = settings.max_zero_volume_share_ticker
    exits, idle = early_exits(bronze), zero_volume_share(bronze).where(F.col("zero_volume_share") > limit)
    noise, moves = rows_below_by_year(bronze, settings.tick_noise_min_close).where("n_tick_noise > 0"), count_moves(bronze, LARGE_MOVE)
    findings = {
        "early_exits": (exits.count(), "tickers end before the last date", exits.orderBy("ticker").limit(10)),
        "zero_volume_share": (idle.count(), f"tickers without volume on more than {limit:.0%} of their days", idle.orderBy(F.desc("zero_volume_share"), "ticker").limit(10)),
    }
    facts_only = {
        "tick_noise": (facts[f"close_under_{settings.tick_noise_min_close:g}_rows"], f"closes under {settings.tick_noise_min_close:g}", noise.orderBy("year")),
        "large_moves": (moves.agg(F.coalesce(F.sum("n_moves"), F.lit(0))).first()[0], f"moves of more than {LARGE_MOVE:.0%}", top_moves(bronze)),
    }
    for name, (n, what, some) in (findings | facts_only).items():
        found = result(name, "soft", n, f"{n} {what}", [str(r.asDict()) for r in some.collect()])
        out.append(found | {"passed": True} if name in facts_only else found)
    for a, b in SHARE_CLASSES:
        r = pair_correlation(bronze, a, b, "adj_close").first()
        if r.n_pairs > 1 and r.corr is not None:
            out.append(result(f"correlation_{a}_{b}", "soft", int(r.corr < LEAST_CORRELATION), f"{r.corr:.4f} over {r.n_pairs} days"))
    return out


def survivorship(bronze: DataFrame) -> dict:
    """How many tickers there are from the first date on and how many end early: data without exits holds survivors only."""
    by = bronze.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    r = by.crossJoin(by.agg(F.min("a").alias("first"), F.max("b").alias("last"))).agg(F.count("*").alias("tickers"), F.count_if(F.col("a") == F.col("first")).alias("from_first_date"), F.count_if(F.col("b") < F.col("last")).alias("ending_early")).first()
    return r.asDict() | {"reading": "only survivors: no ticker ends before the last date" if r.tickers and not r.ending_early else f"{r.ending_early} tickers end before the last date"}


def dataset_counts(bronze: DataFrame) -> DataFrame:
    return bronze.agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("date").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def zero_volume_share(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("ticker").agg(F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume_share"), F.count("*").alias("n_obs"))


def rows_below_by_year(bronze: DataFrame, min_close: float) -> DataFrame:
    return bronze.groupBy(F.year("date").alias("year")).agg(F.count_if(F.col("close") < min_close).alias("n_tick_noise"), F.count("*").alias("n_rows"))


def early_exits(bronze: DataFrame) -> DataFrame:
    """Tickers that end before the last date of all."""
    last = bronze.groupBy("ticker").agg(F.max("date").alias("last_date"))
    return last.crossJoin(bronze.agg(F.max("date").alias("panel_last"))).where("last_date < panel_last")


def top_moves(bronze: DataFrame, k: int = 10) -> DataFrame:
    """The k largest simple returns of the raw close, ties by ticker and date."""
    ret = F.col("close") / F.lag("close").over(by_ticker()) - 1
    return bronze.select("ticker", "date", ret.alias("ret")).where("ret is not null").orderBy(F.desc(F.abs("ret")), "ticker", "date").limit(k)


def count_moves(bronze: DataFrame, above: float) -> DataFrame:
    """How many simple returns exceed a size, by ticker."""
    ret = F.col("close") / F.lag("close").over(by_ticker()) - 1
    return bronze.select("ticker", ret.alias("ret")).groupBy("ticker").agg(F.count_if(F.abs("ret") > above).alias("n_moves"))


def pair_correlation(bronze: DataFrame, a: str, b: str, price: str = "close") -> DataFrame:
    """Correlation of two tickers' log returns over their common dates. The pivot is two conditional maxima."""
    both = bronze.where(F.col("ticker").isin(a, b)).groupBy("date").agg(F.max(F.when(F.col("ticker") == a, F.col(price))).alias("a"), F.max(F.when(F.col("ticker") == b, F.col(price))).alias("b")).where("a is not null and b is not null")
    w = Window.orderBy("date")  # one row for each date of two tickers
    rets = both.select(ln_ratio(F.col("a"), F.lag("a").over(w)).alias("ra"), ln_ratio(F.col("b"), F.lag("b").over(w)).alias("rb")).where("ra is not null and rb is not null")
    return rets.agg(F.count("*").alias("n_pairs"), F.corr("ra", "rb").alias("corr"))


def flag_totals(silver: DataFrame, *by: str) -> DataFrame:
    """Counts of each flag, in all or by ``ticker`` or ``year``."""
    rows = silver.withColumn("year", F.year("date"))
    return rows.groupBy(*by).agg(*(F.count_if(f).alias(f"n_{f[5:]}") for f in FLAGS), F.count("*").alias("n_rows"))


def flag_totals_all(silver: DataFrame) -> DataFrame:
    """In all, by year and by ticker in one pass: grouping sets."""
    rows = silver.withColumn("year", F.year("date"))
    return rows.groupingSets([[], ["year"], ["ticker"]], "year", "ticker").agg(*(F.count_if(f).alias(f"n_{f[5:]}") for f in FLAGS))
