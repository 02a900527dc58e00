"""Raw daily bars: zip, CSV and Parquet in; bronze out."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barleaf.errors import IngestError, SchemaError
from barleaf.functions.exprs import null_nan

#: CSV header -> bronze column and type.
RAW = {
    "Ticker": ("ticker", T.StringType()), "Date": ("date", T.DateType()), "Open": ("open", T.DoubleType()), "High": ("high", T.DoubleType()),
    "Low": ("low", T.DoubleType()), "Close": ("close", T.DoubleType()), "Adj Close": ("adj_close", T.DoubleType()), "Volume": ("volume", T.LongType()),
}


def extract_csv(zip_path: str, csv_path: str) -> None:
    """Unless it is there: the archive's member of that name, or its only CSV. Written aside and renamed."""
    target = Path(csv_path)
    if target.exists():
        return
    if not Path(zip_path).exists():
        raise IngestError(f"neither {csv_path} nor {zip_path} exists")
    with zipfile.ZipFile(zip_path) as z:
        members = [m for m in z.namelist() if m.lower().endswith(".csv")]
        named = [m for m in members if Path(m).name == target.name]
        if len(named or members) != 1:
            raise IngestError(f"{zip_path} has {len(members)} CSV members, none of them clearly {target.name}")
        part = target.with_name(target.name + ".part")
        with z.open((named or members)[0]) as source, open(part, "wb") as out:
            while block := source.read(1 << 20):
                out.write(block)
        os.replace(part, target)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bronze from a CSV with exactly the RAW header. Bad values fail the read; no row is dropped."""
    header = spark.read.text(path).limit(1).collect()
    names = header[0][0].lstrip("﻿").split(",") if header else []
    if names != list(RAW):
        raise SchemaError(f"header is {names}")
    schema = T.StructType([T.StructField(n, t) for n, (_, t) in RAW.items()])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return bronze(df.select(*(F.col(f"`{n}`").alias(c) for n, (c, _) in RAW.items())))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Bronze from Parquet: dates from time stamps, NaN to NULL, columns in order."""
    df = spark.read.parquet(path)
    if missing := [c for c, _ in RAW.values() if c not in df.columns]:
        raise SchemaError(f"{path} lacks {missing}")
    return bronze(df)


def bronze(df: DataFrame) -> DataFrame:
    """Fixed columns and types; the one place where NaN becomes NULL."""
    return df.select(*((null_nan(F.col(c).cast("double")) if isinstance(t, T.DoubleType) else F.col(c).cast(t)).alias(c) for c, t in RAW.values()))
