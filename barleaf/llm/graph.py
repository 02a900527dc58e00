"""Connected components by alternating large-star and small-star (Kiveris et al. 2014), all in tables.

The smallest neighbours are written before they are joined, so that adaptive
execution can split the pairs of a node that a large part of all pairs has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barleaf.llm.common import drop_path, materialize


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: u, v. Links each node's (larger or smaller) neighbours to the smallest node among them and itself."""
    if large:
        pairs = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "least")
    if large:
        out = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(least)
    out = materialize(out.where("u <> v").distinct(), "stars")
    drop_path(pairs.sparkSession, least.scratch_path)
    return out


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> node long, root long for every linked node but the roots: root is the component's smallest node."""
    spark = links.sparkSession
    now, mark = materialize(links.select("u", "v").where("u <> v").distinct(), "links"), None
    while True:
        half = _star(now, True)
        drop_path(spark, now.scratch_path)
        after = _star(half, False)
        drop_path(spark, half.scratch_path)
        # as many pairs with the same sum of hashes: nothing has moved
        state = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        now = after
        if state == mark:
            out = now.toDF("node", "root")
            out.scratch_path = now.scratch_path
            return out
        mark = state
