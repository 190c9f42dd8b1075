"""A corpus from documents to mix: five stages, each over all that the one before it kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns as its operator does (see there); it
keeps the five columns of documents and drops all others.  Documents without a letter, so also null and empty texts, go in ``language``; of documents that
repeat id and text one stays in ``near``; a stage that is given no row gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import decontaminate, langid, line_dedup, mixing, near_duplicates
from logtide.llm.common import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without a letter go."""
    prototypes = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    return langid.predict(docs, prototypes).where(F.col("lang_pred") != langid.UND).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; a document goes if nothing of it is left."""
    left = line_dedup.dedup_lines(docs)
    kept = left.where((F.col("n_gone") == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(F.col("n_gone") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least id."""
    return near_duplicates.keep_one(docs).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of each."""
    return mixing.mix(docs).select(*COLUMNS, "size", "source_size", "target", "taken")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language", language), ("lines", lines), ("near", near), ("benchmark", benchmark), ("mix", mixed)]
#: SQL cannot express the first three stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
