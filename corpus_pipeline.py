"""The corpus pipeline: quality, near duplicates, secrets, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. Stages that drop or change
documents return the columns of ``documents``.

1. quality classifier: documents that it rejects go.
2. n-gram Jaccard join: of each group of near duplicates the document with the
   smallest key stays.
3. secret scans: secrets are masked in the text and n_chars counted again; no
   document goes.
4. mixing sources to target weights: each document comes as often as the mix
   takes it, so 0, 1 or 2 times.
5. BPE encoding and decoding: token ids, and whether they decode to the text.

Rows that repeat a key or have none are documents of their own in every stage:
stage 2 numbers rows, and of equal keys the first row stays, keys before null;
stage 4 tells rows apart by key and text, and whole copies, which are
interchangeable, come as often as the mix takes them together. Joins that decide
are sort-merge joins at every size, since they have a row for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barleaf.llm import bpe, jaccard, mixing, quality, secrets
from barleaf.llm.common import drop_path, materialize, owned, pick, release, shared_root

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
#: SQL can't express the trained classifier, the seeded mixture or byte-pair merges.
ORACLE_SQL = None


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """When a stage starts, the one before has been written: its scratch tables can go."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with owned("pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), COLUMNS)
    return judged.where("keep").select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # written once, so that numbers are the same wherever they are read
    docs = materialize(pick(docs, **COLUMNS).withColumn("row", F.monotonically_increasing_id()), "numbered")
    gone = materialize(jaccard.near_duplicates(docs, row="row").where("not first").select("row"), "gone")
    return docs.join(gone.hint("merge"), "row", "left_anti").select(*COLUMNS)


@stage
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, str(public_tokenizers.path("byte_bpe_50k.tiktoken")))


@stage
def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # doc_id may be missing: 0 and a mark stand for it
    keys = {"k": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull().cast("long"), "digest": F.xxhash64("text", "lang", "source", "n_chars")}
    docs = pick(docs, **COLUMNS).withColumns(keys)
    mixed = mixing.mix_sources(docs, tuple(keys)).where("taken > 0")
    # rows with the same keys are equal: they are taken as often as all of them are
    times = materialize(mixed.groupBy(*keys).agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times")), "times")
    one = docs.groupBy(*keys).agg(F.first(F.struct(*COLUMNS)).alias("row"))
    taken = one.join(times.hint("merge"), list(keys))
    return taken.select("row.*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i")).drop("i")


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixture),
    ("BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs, root = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_root(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex[:12]}"
    for i, (_, f) in enumerate(STAGES[:-1]):
        out = f(spark, docs, sf_dir)
        out.write.mode("overwrite").option("compression", "zstd").parquet(path := f"{root}/{i}")
        docs = spark.read.schema(out.schema).parquet(path)
        if i:
            drop_path(spark, f"{root}/{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
