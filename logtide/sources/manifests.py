"""Manifests: which windows of which groups are archived, in which objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CORRUPT, MANIFEST


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON texts to manifest columns and ``valid``; every caller decides what an invalid one means to it."""
    parsed = texts.withColumn("m", F.from_json(column, f"{MANIFEST}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT}))
    valid = F.col(f"m.{CORRUPT}").isNull() & F.coalesce(F.col("m.version") == 1, F.lit(False)) & F.col("m.window_end_ms").isNotNull()
    return parsed.select("m.*", valid.alias("valid")).drop(CORRUPT)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Manifests as ``write`` writes them: a line each."""
    return parse(spark.read.option("recursiveFileLookup", True).text(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of others: a file each, printed over any number of lines."""
    return parse(spark.read.option("recursiveFileLookup", True).text(path, wholetext=True))


def latest(manifests: DataFrame) -> DataFrame:
    """Of the valid manifests of a window the last one: a reconciled manifest is written beside the one that it replaces."""
    valid = manifests.where("valid")
    keys = ["account", "log_group", "window_start_ms", "window_end_ms"]
    names = [c for c in valid.columns if c not in (*keys, "valid")]
    when = F.struct(F.coalesce("reconciled_at_ms", F.lit(-1)), F.coalesce("completed_at_ms", F.lit(-1)), F.size("objects"))
    return valid.groupBy(*keys).agg(F.max_by(F.struct(*names), when).alias("m")).select(*keys, "m.*")


def none(spark: SparkSession) -> DataFrame:
    """An archive's manifests before its first run."""
    return parse(spark.createDataFrame([], "value string"))


def write_rows(rows: DataFrame, path: str) -> None:
    """A run's outcome, before it changes what the outcome is computed from; a run that is repeated writes it anew."""
    rows.write.mode("overwrite").parquet(path)


def write(manifests: DataFrame, path: str) -> None:
    """One JSON line a manifest; written after the objects that it names."""
    fields = [f.split()[0] for f in MANIFEST.split(", ") if not f.startswith(("etag", "crc32c", "body_len", "raw_bytes", "storage_class", "min_ts", "max_ts"))]
    have = [c for c in fields if c in manifests.columns]
    manifests.select(F.to_json(F.struct(*have)).alias("value")).write.mode("append").text(path)


def covers(account: str, group: str, start: int, end: int):
    """Predicate on parsed manifests: this one proves that window."""
    return F.col("valid") & (F.col("account") == account) & (F.col("log_group") == group) & (F.col("window_start_ms") == start) & (F.col("window_end_ms") == end)
