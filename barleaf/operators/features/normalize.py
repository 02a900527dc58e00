"""Per date: clip to quantiles, rank, and map ranks to normal scores, over eligible rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barleaf.errors import FeatureError
from barleaf.functions.exprs import average_rank, clip, inverse_normal


def check_winsor(pct: tuple[float, float]) -> None:
    if not 0 <= pct[0] < pct[1] <= 1:
        raise FeatureError(f"bad winsor_pct {pct}")


def rank_gauss(panel: DataFrame, columns: list[str], winsor: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Replaces the columns by normal scores of their average ranks within date; NULL on rows that aren't eligible.

    All columns are ranked at once as rows (ticker, date, name, x): one exchange
    on (date, name) whatever their number, so that a date with many names is as
    many tasks as there are columns, and one expression to compile instead of
    one for each.
    """
    check_winsor(winsor)
    if not columns:
        return panel
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("name"), F.col(c).alias("x")) for i, c in enumerate(columns))))
    rows = panel.where("eligible").select("ticker", "date", cells.alias("cell")).select("ticker", "date", "cell.name", "cell.x").where("x is not null")
    group = Window.partitionBy("date", "name")
    low, high = (F.percentile("x", F.lit(q)).over(group) for q in winsor)
    rows = rows.withColumn("x", clip(F.col("x"), low, high))
    rows = rows.withColumn("p", (average_rank("x", "date", "name") - 0.5) / F.count("*").over(group))
    scores = rows.select("ticker", "date", "name", inverse_normal("p").alias("z"))
    wide = scores.groupBy("ticker", "date").agg(*(F.max(F.when(F.col("name") == i, F.col("z"))).alias(c) for i, c in enumerate(columns)))
    rest = panel.drop(*columns).join(wide, ["ticker", "date"], "left")
    return rest.select(*panel.columns)
