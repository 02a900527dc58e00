"""Checks on keys: unique, equal between tables, without gaps. Each is one small action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.errors import StageError

KEYS = ("ticker", "date")


def repeated_keys(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, error: type[StageError], keys: tuple[str, ...] = KEYS) -> None:
    if bad := repeated_keys(df, keys).limit(1).collect():
        raise error(f"repeated key {bad[0].asDict()}")


def key_mismatches(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Keys that only one of the tables has, with ``side`` (left, right): two anti-joins."""
    a, b = left.select(*keys), right.select(*keys)
    only_left = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left"))
    return only_left.unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def assert_same_keys(left: DataFrame, right: DataFrame, error: type[StageError], what: str) -> None:
    if bad := key_mismatches(left, right).limit(1).collect():
        raise error(f"{what}: keys differ, first {bad[0].asDict()}")


def gaps(df: DataFrame) -> DataFrame:
    """Rows whose t_idx does not follow the ticker's row before."""
    step = F.col("t_idx") - F.lag("t_idx").over(Window.partitionBy("ticker").orderBy("t_idx"))
    return df.select("ticker", "date", "t_idx", step.alias("step")).where("step <> 1")


def assert_contiguous(df: DataFrame, error: type[StageError]) -> None:
    if bad := gaps(df).limit(1).collect():
        raise error(f"t_idx is not consecutive: {bad[0].asDict()}")


def count_where(df: DataFrame, **conditions: Column) -> dict[str, int]:
    """How many rows meet each condition, all in one pass."""
    row = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items())).first()
    return row.asDict()


def assert_none(df: DataFrame, error: type[StageError], **conditions: Column) -> None:
    bad = {k: v for k, v in count_where(df, **conditions).items() if v}
    if bad:
        raise error(f"bad rows: {bad}")


def bad_number(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def bad_positive(c: str) -> Column:
    return bad_number(c) | (F.col(c) <= 0)
