"""What each group costs now and could cost archived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.costs import BYPASS, DAYS_PER_MONTH, LOG_INGEST, LOG_STORAGE, PRICES, SIZE_FACTOR, STANDARD, gib
from ..functions.times import format_bytes
from ..session import scratch

METRICS_PER_CALL = 500


def sampled(groups: DataFrame, metrics: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Groups with the sum of their ingest metric in a range; none is 0."""
    keys = [c for c in ("account", "log_group") if c in metrics.columns and c in groups.columns]
    sums = metrics.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms)).groupBy(*keys).agg(F.sum("value").alias("ingest_bytes_sampled"))
    return groups.join(sums, keys, "left").na.fill(0.0, ["ingest_bytes_sampled"])


def costs(groups: DataFrame, days: int) -> DataFrame:
    """Monthly measures of each row (stored_bytes, ingest_bytes_sampled over ``days``)."""
    stored, monthly = gib(F.col("stored_bytes").cast("double")), F.col("ingest_bytes_sampled") / float(max(days, 1)) * DAYS_PER_MONTH
    rows = groups.withColumn("ingest_bytes_monthly", monthly).withColumns({
        "log_storage_usd": stored * LOG_STORAGE, "log_ingest_usd": gib(F.col("ingest_bytes_monthly")) * LOG_INGEST,
        "archive_standard_usd": stored * SIZE_FACTOR * STANDARD, "archive_cold_usd": stored * SIZE_FACTOR * PRICES["GLACIER_IR"],
    })
    rows = rows.withColumns({"log_total_usd": F.col("log_storage_usd") + F.col("log_ingest_usd"), "bypass_usd": F.col("log_ingest_usd") * BYPASS})
    return rows.withColumn("savings_usd", (F.col("log_storage_usd") - F.col("archive_standard_usd")) + F.col("bypass_usd"))


def top(groups: DataFrame, days: int, k: int = 20) -> DataFrame:
    """The ``k`` dearest groups: a report's display limit; totals cover all groups."""
    return costs(groups, days).orderBy(F.desc("log_total_usd"), "log_group").limit(k)


def total(groups: DataFrame, days: int) -> DataFrame:
    sums = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("stored_bytes").alias("stored_bytes"), F.sum("ingest_bytes_sampled").alias("ingest_bytes_sampled"))
    return costs(sums, days)


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place in ``order``, from 0 on, without one task for all: each range of the order is counted, and what stands before it is added.

    The ordered rows are written to the shared folder, as ranges drawn twice might differ.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "ordered")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    there = spark.read.parquet(path).withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    counts = {r["_part"]: r["n"] for r in there.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, offsets = 0, []
    for part in sorted(counts):
        offsets.append((part, before))
        before += counts[part]
    table = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))
    return there.join(table, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_id", "_part", "_at", "_before")


QUERY_ID = r"^m(0|[1-9][0-9]*)$"


def place_of(query_id: Column) -> Column:
    """The place that a query id names; null for what ``metric_batches`` would not write."""
    return F.when(query_id.rlike(QUERY_ID), F.regexp_extract(query_id, QUERY_ID, 1).try_cast("long"))


def metric_batches(groups: DataFrame, size: int = METRICS_PER_CALL) -> DataFrame:
    """Number the groups (log_group, of an account where they have one) in order and split each account's into calls."""
    keys = [c for c in ("account", "log_group") if c in groups.columns]
    rows = numbered(groups.select(*keys), keys)
    if "account" in keys:
        first = rows.groupBy("account").agg(F.min("place").alias("_first"))
        rows = rows.join(first, "account").withColumn("place", F.col("place") - F.col("_first"))
    return rows.select(*keys, F.format_string("m%d", F.col("place")).alias("query_id"), F.floor(F.col("place") / size).cast("long").alias("call"))


def lines(rows: DataFrame) -> DataFrame:
    """(log_group, lines) of ``costs`` as text for people."""
    money = lambda name: F.concat(F.lit("$"), F.format_string("%.4f", F.col(name)))
    out = [
        F.col("log_group"),
        F.concat(F.lit("  stored: "), format_bytes(F.col("stored_bytes")), F.lit(", a month in: "), format_bytes(F.col("ingest_bytes_monthly").cast("long"))),
        F.concat(F.lit("  a month: "), money("log_total_usd"), F.lit(" as logs, "), money("archive_standard_usd"), F.lit(" archived, "), money("archive_cold_usd"), F.lit(" cold")),
        F.concat(F.lit("  saves "), money("savings_usd"), F.lit(", "), money("bypass_usd"), F.lit(" of it by the gateway")),
    ]
    return rows.select("log_group", F.array_join(F.array(*out), "\n").alias("lines"))
