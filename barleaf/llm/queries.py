"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from barleaf.llm import bpe, extract, jaccard, knn, langid, media, mixing, quality, secrets, tokenstore
from barleaf.llm.common import documents

END_ID = 2


@cache
def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenstore.write_store(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"), END_ID)
    return tokenstore.read_store(spark, manifest)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.tiktoken"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(documents(spark, sf_dir), vocabulary_file("byte_bpe_50k.json"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.of_payloads(documents(spark, sf_dir))


def op6_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir)).drop("row", "first")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_secret_scan, op3_language_mixture, op4_bpe_roundtrip, op5_media_columns, op6_voronoi_top_k, op7_html_main_text, op8_quality_classifier, op9_ngram_jaccard_join, op10_source_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op6_voronoi_top_k": knn.ORACLE, "op9_ngram_jaccard_join": jaccard.ORACLE}
