"""What the training-data operators share: column picking, scratch tables, sizes.

Inputs may carry any further columns, also ones that clash with an operator's
own names or differ from the wanted ones in case only: ``pick`` takes the
wanted columns by position and leaves the rest behind.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of all contracts: runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Scratch paths and who wrote them; who writes now, in this thread.
_written: dict[str, str] = {}
_owner: ContextVar[str] = ContextVar("owner", default="")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast to the given types, whatever else ``df`` holds."""
    bound_batches(df.sparkSession)
    inner = [f"__{i}" for i in range(len(df.columns))]
    flat = df.toDF(*inner)
    return flat.select(*(F.col(inner[df.columns.index(name)]).cast(kind).alias(name) for name, kind in types.items()))


#: Bytes of an Arrow batch that goes to Python. Rows alone, Spark's default, don't bound it: texts can be long.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limit for Arrow batches to BATCH_BYTES, unless a lower one is set."""
    now = spark.conf.get(_BATCH_SETTING).rstrip("b")
    if not (now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where unset, in local mode only, set to one that goes with this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="barleaf-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root := f"file://{folder}")
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _written[path] = _owner.get()
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut of its lineage that outlives executors."""
    spark = df.sparkSession
    df.write.option("compression", "zstd").parquet(path := scratch(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Scratch tables written inside belong to ``owner``."""
    before = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(before)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the scratch tables of ``owner``, who holds no result built on them."""
    for path in [p for p, o in list(_written.items()) if o == owner]:
        drop_path(spark, path)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the input bytes below ``df`` without running it; None if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_for(df: DataFrame, bytes_each: int) -> int:
    """How many parts keep each near ``bytes_each`` of input, and at least the session's shuffle partitions."""
    return max(shuffle_partitions(df.sparkSession), -(-(plan_bytes(df) or 0) // bytes_each))


def null_safe(key: str, like: str) -> Column:
    """``key`` (a string) made joinable: null and text never give the same value."""
    return F.when(F.col(key).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(key))).alias(like)
