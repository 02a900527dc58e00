"""Stage tables as Parquet: exact columns, one folder for each variant."""

from __future__ import annotations

import atexit
import csv
import hashlib
import json
import os
import shutil
import subprocess
import tempfile
import uuid
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.errors import FrozenDatasetError, StageError
from barleaf.operators.master import MASTER

REGISTRY = ("run_id", "timestamp", "stage", "variant", "config_hash", "data_hash", "git_commit", "model", "seed", "split", "metric", "value", "artifact", "notes")


def table_path(root: str, variant: str, name: str) -> str:
    return f"{root.rstrip('/')}/{variant}/{name}"


def write_table(df: DataFrame, path: str, sort: tuple[str, ...] = ("ticker", "date")) -> None:
    """Parquet, a ticker's rows together and sorted: one exchange, and readers skip row groups by ticker and date."""
    keys = [k for k in sort if k in df.columns]
    out = df.repartition(keys[0]).sortWithinPartitions(*keys) if keys else df
    out.write.mode("overwrite").option("compression", "snappy").parquet(path)


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...] | None, error: type[StageError], command: str, types: dict[str, str] | None = None) -> DataFrame:
    """The table, if it has exactly these columns and, where ``types`` names some, these types; errors name the command that makes it."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:
        raise error(f"{path} can't be read; run `{command}`: {str(e).splitlines()[0]}") from e
    if columns is not None and tuple(df.columns) != tuple(columns):
        raise error(f"{path} has columns {df.columns}; run `{command}`")
    found = dict(df.dtypes)
    if wrong := [f"{c} is {found.get(c)}, not {t}" for c, t in (types or {}).items() if found.get(c) != t]:
        raise error(f"{path}: {'; '.join(wrong)}; run `{command}`")
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, where it is unset, one that goes with this process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise StageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="barleaf-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: a stage that several others read, and that lost executors don't take along."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small table in its order as one CSV with a header, row by row from Spark."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = Path(path).with_suffix(".part")
    with open(part, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())
    os.replace(part, path)


def write_master(master: DataFrame, path: str) -> None:
    """One CSV, sorted by ticker, ISO dates, true/false. The master has one row for each ticker."""
    rows = master.orderBy("ticker").select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in MASTER)).collect()
    part = Path(path).with_suffix(".part")
    with open(part, "w", encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(MASTER)
        out.writerows(rows)
    os.replace(part, path)


def read_master(spark: SparkSession, path: str) -> DataFrame:
    df = read_text_csv(spark, path)
    if tuple(df.columns) != MASTER:
        raise StageError(f"{path} has columns {df.columns}; run `build-master`")
    kinds = {"stitching_suspect": "boolean", "include_in_universe": "boolean", "first_date": "date", "last_date": "date", "n_obs": "long", "zero_volume_share": "double", "median_dollar_volume_last_year": "double"}
    return df.select(*(F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in MASTER))


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; blanks are blanks, not NULL."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns))


def sha256_file(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 16):
            digest.update(block)
    return digest.hexdigest()


def sha256_json(x: object) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def git_commit() -> str:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def read_manifest(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else {}


def check_frozen(manifest: dict, digest: str) -> None:
    """Before anything is written: the data that was ingested first stays the data."""
    if manifest and manifest.get("sha256") != digest:
        raise FrozenDatasetError(f"source digest {digest} differs from the frozen {manifest.get('sha256')}")


def write_manifest(bronze: DataFrame, source: str, digest: str, path: str) -> dict:
    row = bronze.agg(F.count("*").alias("rows"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).first()
    out = {"source": os.path.basename(source), "sha256": digest, "columns": bronze.columns} | {k: v if isinstance(v, int) else str(v) for k, v in row.asDict().items()}
    write_text(json.dumps(out, indent=2, sort_keys=True) + "\n", path)
    return out


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = Path(path).with_name(Path(path).name + ".tmp")
    part.write_text(text, encoding="utf-8", newline="\n")
    os.replace(part, path)


def append_registry(row: dict, path: str) -> None:
    """One line to the run registry: exactly the REGISTRY columns, never rewriting older lines."""
    if set(row) != set(REGISTRY):
        raise ValueError(f"registry columns differ: {sorted(set(row) ^ set(REGISTRY))}")
    fresh = not Path(path).exists()
    with open(path, "a", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, REGISTRY, lineterminator="\n")
        if fresh:
            out.writeheader()
        out.writerow(row)


def new_run_id(stage: str, now: datetime | None = None) -> str:
    return f"{(now or datetime.now()).strftime('%Y%m%dT%H%M%S')}-{stage}-{os.urandom(3).hex()}"


def markdown_table(header: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def render_report(results: list[dict], totals: dict, survivors: dict | None = None) -> str:
    """Markdown of the checks: the same text for the same results."""
    parts = ["# Data quality", markdown_table(["fact", "value"], [[k, v] for k, v in totals.items()])]
    if survivors:
        parts += ["## Survivorship", markdown_table(["fact", "value"], [[k, v] for k, v in survivors.items()])]
    state = lambda r: "passed" if r["passed"] else "FAILED" if r["severity"] == "hard" else "warning"
    parts += ["## Checks", markdown_table(["check", "severity", "state", "count", "message"], [[r["name"], r["severity"], state(r), r["count"], r["message"]] for r in results])]
    for r in results:
        if r["examples"]:
            parts += [f"### {r['name']}", "\n".join(f"- {x}" for x in r["examples"])]
    return "\n\n".join(parts) + "\n"
