"""Coverage and cost of an archive, from manifests alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import LOG_RATIO, LOG_STORAGE, gib, price_per_gib_month, ratio
from ..functions.times import fmt_ts, format_bytes

KEYS = ["account", "log_group"]


def coverage(manifests: DataFrame) -> DataFrame:
    """Per account and group: windows, records, coverage bounds and gaps (a window that begins after the end of the one before it)."""
    order = Window.partitionBy(*KEYS).orderBy("window_start_ms", "window_end_ms")
    gap = F.when(F.col("window_start_ms") > F.lag("window_end_ms").over(order), 1).otherwise(0)
    return manifests.withColumn("gap", gap).groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("windows"), F.sum("record_count").alias("records"), F.min("window_start_ms").alias("coverage_from_ms"),
        F.max_by("window_end_ms", F.struct("window_start_ms", "window_end_ms")).alias("coverage_to_ms"), F.sum("gap").alias("coverage_gaps"),
    )


def by_class(manifests: DataFrame) -> DataFrame:
    """(account, log_group, class, bytes ...) over the objects; an unknown class counts as STANDARD."""
    objects = manifests.select(*KEYS, F.explode("objects").alias("o")).select(*KEYS, "o.*")
    return objects.groupBy(*KEYS, F.coalesce("storage_class", F.lit("STANDARD")).alias("class")).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("body_len").alias("bytes"), F.coalesce(F.sum("raw_bytes"), F.lit(0)).alias("raw"),
        F.count(F.when(F.col("raw_bytes").isNull(), 1)).alias("no_raw"), F.count(F.when(F.col("storage_class").isNull(), 1)).alias("assumed"),
    )


def _priced(sums: DataFrame) -> DataFrame:
    return sums.withColumns({
        "compression_ratio": ratio(F.col("raw_bytes"), F.col("compressed_bytes"), F.col("objects_missing_raw")),
        "log_usd": gib(F.col("raw_bytes")) / LOG_RATIO * LOG_STORAGE,
        "is_lower_bound": F.col("objects_missing_raw") > 0,
    }).withColumn("savings_usd", F.col("log_usd") - F.col("archive_usd"))


def _sums() -> list[Column]:
    return [
        F.sum("objects").alias("objects"), F.sum("raw").alias("raw_bytes"), F.sum("no_raw").alias("objects_missing_raw"), F.sum("bytes").alias("compressed_bytes"),
        F.sum("assumed").alias("objects_assumed_standard"), F.sum(gib(F.col("bytes")) * price_per_gib_month(F.col("class"))).alias("archive_usd"),
    ]


def groups(manifests: DataFrame) -> DataFrame:
    """One row a group of an account.  Windows and objects are summed each at its own grain, then joined."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "bytes")))).alias("bytes_by_class")
    sums = by_class(manifests).groupBy(*KEYS).agg(*_sums(), entries)
    joined = coverage(manifests).join(sums, KEYS, "left")
    zero = ["objects", "raw_bytes", "objects_missing_raw", "compressed_bytes", "objects_assumed_standard"]
    return _priced(joined.na.fill(0, zero).na.fill(0.0, ["archive_usd"]))


def total(manifests: DataFrame) -> DataFrame:
    """Groups of each account and their grand total (both null); prices and ratio anew from the sums."""
    sums = by_class(manifests).groupingSets([KEYS, []], *KEYS).agg(F.grouping("log_group").alias("is_total"), *_sums())
    return _priced(sums)


def lines(rows: DataFrame) -> DataFrame:
    """(account, log_group, lines) of ``groups`` as text for people."""
    c, cat = F.col, F.concat
    text = lambda name: F.coalesce(c(name), F.lit(0)).cast("string")
    gaps = cat(text("coverage_gaps"), F.lit(" gap"), F.when(c("coverage_gaps") == 1, "").otherwise("s"))
    known = F.when(c("compression_ratio").isNotNull(), cat(F.lit(" ("), F.format_string("%.1f", F.bround("compression_ratio", 1)), F.lit("x)")))
    known = known.when(c("objects_missing_raw") > 0, cat(F.lit(" (ratio unknown for "), text("objects_missing_raw"), F.lit(" objects)"))).otherwise("")
    money = lambda name: cat(F.lit("$"), F.format_string("%.4f", F.col(name)))
    out = [
        c("log_group"),
        cat(F.lit("  windows: "), text("windows"), F.lit(", "), fmt_ts(c("coverage_from_ms")), F.lit(" .. "), fmt_ts(c("coverage_to_ms")), F.lit(", "), gaps),
        cat(F.lit("  records: "), text("records"), F.lit(" in "), text("objects"), F.lit(" objects")),
        cat(F.lit("  bytes: "), format_bytes(c("raw_bytes")), F.lit(" raw, "), format_bytes(c("compressed_bytes")), F.lit(" compressed"), known),
        cat(F.lit("  a month: "), money("log_usd"), F.lit(" as logs, "), money("archive_usd"), F.lit(" archived"), F.when(c("is_lower_bound"), " (lower bound)").otherwise("")),
    ]
    return rows.select("account", "log_group", F.array_join(F.array(*out), "\n").alias("lines"))
