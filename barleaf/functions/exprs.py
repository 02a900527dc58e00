"""Columns that Spark has no function for. All stay inside code generation.

Missing is NULL everywhere; NaN never occurs inside the library. Every boolean
that compares a maybe-missing value is coalesced to false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TRADING_DAYS = 252


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def safe_ln(x: str | Column) -> Column:
    """Natural logarithm; NULL for zero, negative and missing values."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


def ln_ratio(a: str | Column, b: str | Column) -> Column:
    return F.when((col(a) > 0) & (col(b) > 0), F.ln(col(a) / col(b)))


def null_nan(x: str | Column) -> Column:
    """NaN and infinities to NULL, once, where a table comes in."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def trailing(n: int, by: str = "ticker", order: str = "t_idx") -> WindowSpec:
    """The last n rows of a ticker."""
    return Window.partitionBy(by).orderBy(order).rowsBetween(-(n - 1), 0)


def full(agg: Callable[[Column], Column], x: str | Column, n: int, w: WindowSpec) -> Column:
    """agg over w where the window holds n present values, else NULL."""
    x = col(x)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def framed_median(x: str | Column) -> Column:
    """Exact median, also over a row frame (where ``median`` is rejected)."""
    return F.percentile(col(x), F.lit(0.5))


def clip(x: Column, low: Column, high: Column) -> Column:
    """x between low and high; NULL if any is missing (``least`` alone would skip a NULL)."""
    return F.when(x.isNotNull() & low.isNotNull() & high.isNotNull(), F.least(F.greatest(x, low), high))


def average_rank(x: str, *by: str | Column) -> Column:
    """1-based rank within ``by``, the mean of the places for ties; NULL for missing values."""
    x = col(x)
    order = Window.partitionBy(*by, x.isNull()).orderBy(x)
    ties = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(x.isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def pct_rank(x: str, *by: str | Column) -> Column:
    """Average rank over the number of present values."""
    return average_rank(x, *by) / F.count(col(x)).over(Window.partitionBy(*by))


#: Coefficients of Wichura's AS241 (PPND16), lowest power first.
AS241_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
AS241_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
AS241_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def horner(c: tuple[float, ...], x: str) -> str:
    out = f"{c[-1]!r}e0" if "e" not in repr(c[-1]) else repr(c[-1])
    for a in reversed(c[:-1]):
        out = f"({out} * {x} + {a!r}{'' if 'e' in repr(a) else 'e0'})"
    return out


def inverse_normal_sql(p: str) -> str:
    """SQL text (Spark and DuckDB alike) of the standard normal quantile of ``p`` in (0, 1)."""
    q = f"({p} - 0.5e0)"
    r = f"(0.180625e0 - {q} * {q})"
    s = f"sqrt(-ln(CASE WHEN {q} < 0e0 THEN {p} ELSE 1e0 - {p} END))"
    ratio = lambda pair, x: f"({horner(pair[0], x)}) / ({horner(pair[1], x)})"
    tail = f"CASE WHEN {s} <= 5e0 THEN {ratio(AS241_MIDDLE, f'({s} - 1.6e0)')} ELSE {ratio(AS241_TAIL, f'({s} - 5e0)')} END"
    return f"CASE WHEN {p} <= 0e0 OR {p} >= 1e0 THEN NULL WHEN abs({q}) <= 0.425e0 THEN {q} * {ratio(AS241_CENTRE, r)} ELSE (CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END) * ({tail}) END"


def inverse_normal(p: str) -> Column:
    """The standard normal quantile of column ``p``."""
    return F.expr(inverse_normal_sql(p))
