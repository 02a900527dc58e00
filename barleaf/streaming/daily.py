"""Flags for arriving bars, equal to those of a batch build.

A flag looks one row of its ticker back, so each micro-batch is joined with the
last silver row of its tickers and only new rows are written: what was written
never changes. Late rows, for dates that their ticker is past, are set aside.

Every batch writes folders of its own by its number, silver, rejected rows and
each ticker's last row after the batch, and reads the last rows of the batch
before. So a batch that is tried again writes the same folders once more, and a
batch costs its own rows and one row for each ticker, however long silver is.
Silver belongs to one checkpoint: batch numbers of another would start anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from barleaf.config import Flags
from barleaf.errors import StageError
from barleaf.functions.exprs import false_if_null
from barleaf.operators.flags import BRONZE, FLAGS, SILVER, by_ticker, flag_columns, previous_row_returns

SCHEMA = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume long"
LAST = f"{SCHEMA}, n_obs int"


def part(root: str, table: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{table}/batch={batch_id}"


def read_part(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """None if the path does not exist; every other failure is one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def silver(spark: SparkSession, root: str) -> DataFrame:
    """All silver rows so far."""
    return spark.read.schema(f"{LAST}, {', '.join(f'{f} boolean' for f in FLAGS)}, batch long").parquet(f"{root.rstrip('/')}/silver").select(*SILVER)


def rejected(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, batch long").parquet(f"{root.rstrip('/')}/rejected").select(*BRONZE)


def append_batch(spark: SparkSession, new: DataFrame, batch_id: int, root: str, settings: Flags | None = None) -> None:
    """One micro-batch: rows after their ticker's last date become silver."""
    if batch_id:
        last = read_part(spark, part(root, "last", batch_id - 1), LAST)
        if last is None:
            raise StageError(f"batch {batch_id}: {root} lacks what batch {batch_id - 1} leaves")
    else:
        last = spark.createDataFrame([], LAST)
        if read_part(spark, part(root, "last", 1), LAST) is not None:
            raise StageError(f"{root} holds the batches of another checkpoint")
    write = lambda df, table: df.write.mode("overwrite").parquet(part(root, table, batch_id))
    joined = new.select(*BRONZE).join(last.select("ticker", F.col("date").alias("last_date")), "ticker", "left")
    write(joined.where("date <= last_date").select(*BRONZE), "rejected")
    fresh = joined.where("last_date is null or date > last_date").select(*BRONZE)
    context = last.join(fresh.select("ticker").distinct(), "ticker", "left_semi")
    rows = fresh.withColumns({"n_obs": F.lit(None).cast("int"), "is_new": F.lit(True)}).unionByName(context.withColumn("is_new", F.lit(False)))
    rows = rows.withColumns(previous_row_returns())
    before = F.coalesce(F.max("n_obs").over(Window.partitionBy("ticker")), F.lit(0))
    rows = rows.withColumn("n_obs", (before + F.sum(F.col("is_new").cast("int")).over(by_ticker())).cast("int"))
    flags = {n: false_if_null(c) for n, c in flag_columns(settings or Flags()).items()}
    write(rows.where("is_new").select(*BRONZE, "n_obs", *(c.alias(n) for n, c in flags.items())).select(*SILVER), "silver")
    done = read_part(spark, part(root, "silver", batch_id), LAST)
    now = last.unionByName(done.select(*last.columns)).groupBy("ticker").agg(F.max_by(F.struct(*last.columns), "date").alias("row")).select("row.*")
    write(now, "last")


def start(spark: SparkSession, landing: str, root: str, checkpoint: str, settings: Flags | None = None) -> StreamingQuery:
    """A query over a folder of bronze Parquet files; ``availableNow`` takes what is there and ends."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(landing)
    run = lambda df, batch_id: append_batch(df.sparkSession, df, batch_id, root, settings)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
