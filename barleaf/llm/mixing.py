"""Mixing sources to target weights by fitting subset sums.

A document's size is its number of words. Sources, by code point with null
last, weigh 5, 2, 1 and so on in turn and share 150 % of all sizes; a target
stops at twice its source's size and what is over goes to the others by
weight, round by round: each round is one sum over the table of sources, of
which there may be as many as hosts. With target T and size S a source takes every document T // S times;
for the rest R it picks documents to take once more:

1. Its documents are counted by exact size. Of each size the same share is
   taken, rounded down: R / S, less room for ``RESERVE`` of the largest ones.
2. What is left of the budget is little more than one document of each size. It
   is filled largest size first while more than ``EXACT`` words remain, then by
   a bounded knapsack over the counts left: the largest sum up to the budget.
3. Of each (source, size) the wanted number of documents is taken in the order
   of a seeded hash.

Only counts meet in one place: a row for each size that a source has (words S
have at most the root of 2 S different sizes). Picking in step
3 cuts large (source, size) groups into ranges of the hash, ranks within
these, and adds the counts of the ranges before.

Defined results: null texts have size 0 and are taken 0 times; repeated rows
are documents of their own; null keys take part; sources without words have
target 0; an empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barleaf.llm.common import WORD, drop_path, materialize, null_safe, pick

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of budget that the knapsack fits exactly; largest documents left for it; documents in a range of the hash; the seed.
EXACT, RESERVE, RANGE, SEED = 1 << 16, 4, 512, 17


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def water_level(budget: float, stopped: Callable[[float], tuple[int, int, int]]) -> float:
    """What a weight of 1 gets of the budget when targets stop at their caps: the excess is shared again until no further target stops.

    stopped(level): of the sources whose cap is at most level * weight, the sum of
    caps and their number; and the weight of the others: (caps, weight, number).
    """
    level, before = -1.0, -1
    while True:
        caps, weight, number = stopped(level)
        if number == before:
            return level
        if not weight:
            return float("inf")
        level, before = (budget - caps) / weight, number


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size add up to the largest sum up to the budget."""
    taken = np.zeros(len(sizes), "i8")
    by = np.full(budget + 1, -1, "i8")  # the first size whose use reaches a sum
    reach = np.zeros(budget + 1, bool)
    reach[0] = True
    for i in np.argsort(-sizes, kind="stable"):
        s, most = int(sizes[i]), int(counts[i])
        if not 0 < s <= budget or not most:
            continue
        used = np.where(reach, 0, most + 1)
        # within each remainder modulo the size, how many steps since a sum reached without it
        rows = -(-(budget + 1) // s)
        grid = np.pad(used, (0, rows * s - budget - 1), constant_values=most + 1).reshape(rows, s)
        place = np.arange(rows)[:, None]
        last = np.maximum.accumulate(np.where(grid == 0, place, -most - rows - 1), axis=0)
        new = ((place - last <= most).ravel()[: budget + 1]) & ~reach
        by[new] = i
        reach |= new
        if reach[budget]:
            break
    at = int(np.flatnonzero(reach)[-1])
    while at:
        i = by[at]
        taken[i] += 1
        at -= int(sizes[i])
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take for the budget, at most ``counts``."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    evenly = max(0, budget - RESERVE * int(sizes.max()))
    taken = np.array([int(c) * evenly // total for c in counts], "i8")
    left, spare = budget - int((sizes * taken).sum()), counts - taken
    for i in np.argsort(-sizes, kind="stable"):
        if left <= EXACT:
            break
        n = min(int(spare[i]), (left - EXACT) // int(sizes[i]))
        taken[i], spare[i], left = taken[i] + n, spare[i] - n, left - n * int(sizes[i])
    return taken + knapsack(sizes, spare, left)


def source_plan(rows: DataFrame) -> DataFrame:
    """s, source_size, target of each source. rows: s, size, m."""
    spark = rows.sparkSession
    order = [F.col("s") == "n", F.col("s")]
    sizes = rows.groupBy("s").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    # places in the whole order: those within ranges, and how many are in the ranges before
    ranged = sizes.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select("s", "source_size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i")), "sources")
    counts = sorted((r["range"], r.n) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())
    before = spark.createDataFrame([(k, sum(n for _, n in counts[:j])) for j, (k, _) in enumerate(counts)], "range int, before long")
    weights = F.array(*map(F.lit, WEIGHTS))
    weighed = ranged.join(before, "range").select("s", "source_size", F.get(weights, ((F.col("i") + F.col("before")) % len(WEIGHTS)).cast("int")).cast("long").alias("weight"))
    weighed = materialize(weighed, "weights")
    drop_path(spark, ranged.scratch_path)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    cap = MOST * F.col("source_size")

    def stopped(level: float) -> tuple[int, int, int]:
        stops = cap <= F.lit(level) * F.col("weight")
        r = weighed.agg(F.sum(F.when(stops, cap)), F.sum(F.when(~stops, F.col("weight"))), F.count_if(stops)).first()
        return r[0] or 0, r[1] or 0, r[2]

    level = water_level(SHARE * total, stopped)
    return weighed.select("s", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys (long columns that tell documents apart), size, source_size, target, taken, source."""
    rows = pick(docs, **dict.fromkeys(keys, "long"), text="string", source="string").select(*keys, "source", null_safe("source", "s"), size_of("text").alias("size"))
    # equal rows are interchangeable: one row with their number
    rows = materialize(rows.groupBy("s", "size", *keys, "source").agg(F.count("*").alias("m")), "sizes")
    plan = source_plan(rows)

    def whole(source: pd.DataFrame) -> pd.DataFrame:
        total, target = int(source["source_size"].iloc[0]), float(source["target"].iloc[0])
        times, budget = divmod(round(target), total) if total else (0, 0)
        some = (source["size"] > 0).to_numpy()
        more = np.zeros(len(source), "i8")
        if some.any():
            more[some] = fit(source["size"].to_numpy()[some], source["n"].to_numpy()[some], budget)
        return source.assign(times=np.where(some, times, 0), more=more)

    counts = rows.groupBy("s", "size").agg(F.sum("m").alias("n")).join(plan, "s")
    wanted = materialize(counts.groupBy("s").applyInPandas(whole, "s string, size long, n long, source_size long, target double, times long, more long"), "wanted")
    ranges = F.greatest(F.ceil(F.col("n") / RANGE), F.lit(1))
    dealt = rows.join(wanted, ["s", "size"]).withColumn("o", F.xxhash64(*keys, F.lit(SEED))).withColumn("r", F.pmod(F.xxhash64("o"), ranges))
    dealt = materialize(dealt, "dealt")
    each = dealt.where(F.col("n") > RANGE).groupBy("s", "size", "r").agg(F.sum("m").alias("k"))
    before = each.select("s", "size", "r", (F.sum("k").over(Window.partitionBy("s", "size").orderBy("r")) - F.col("k")).alias("before"))
    own = Window.partitionBy("s", "size", "r").orderBy("o", *keys)
    # dealt out by range as well, so that a frequent size of a large source is many tasks
    ranked = dealt.repartition("s", "size", "r").withColumn("place", F.sum("m").over(own) - F.col("m")).join(before, ["s", "size", "r"], "left")
    extra = F.col("more") - F.col("place") - F.coalesce("before", F.lit(0))
    each_row = ranked.withColumn("extra", extra).select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i"))
    taken = F.col("size") * (F.col("times") + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0))
    return each_row.select(*keys, "size", "source_size", "target", taken.alias("taken"), "source")
