"""Re-ingest: wrapped messages, size limits, batches and what a service rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import MAX_BYTES, OVERHEAD, batches

TOO_OLD_MS = 14 * 86_400_000


def wrap(message: Column, stream: Column, timestamp: Column, group: Column | None) -> Column:
    """A JSON object with its keys in order; the group only if there is more than one source group."""
    fields = [message.alias("message")] + ([group.alias("original_log_group")] if group is not None else [])
    return F.to_json(F.struct(*fields, stream.alias("original_stream"), timestamp.alias("original_timestamp")))


def event_cost(message: Column) -> Column:
    return (F.octet_length(message) + OVERHEAD).cast("long")


def events(records: DataFrame, raw: bool, several_groups: bool, now_ms: int) -> DataFrame:
    """Records as they are sent: ``out``, its cost, too_large (they are skipped) and too_old (counted when raw)."""
    group = F.col("log_group") if several_groups else None
    out = F.col("message") if raw else wrap(F.col("message"), F.col("stream"), F.col("timestamp"), group)
    rows = records.withColumn("out", out).withColumn("cost", event_cost(F.col("out")))
    return rows.withColumns({"too_large": F.col("cost") > MAX_BYTES, "too_old": F.lit(raw) & (F.col("timestamp") < now_ms - TOO_OLD_MS)})


def batched(sent: DataFrame, keys: list[str], order: list[str], **limits: int) -> DataFrame:
    return batches(sent.where(~F.col("too_large")), keys, order, "cost", **limits)


def rejections(rows: DataFrame) -> DataFrame:
    """too_new (from its index on), too_old and expired (before theirs), each within the batch's length."""
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("batch_len"))
    out = rows.withColumns({
        "too_new": F.when(F.col("too_new_start").isNull(), 0).otherwise(F.col("batch_len") - clamp("too_new_start")).cast("long"),
        "too_old": F.coalesce(clamp("too_old_end"), F.lit(0)).cast("long"),
        "expired": F.coalesce(clamp("expired_end"), F.lit(0)).cast("long"),
    })
    return out.withColumn("rejected", F.col("too_new") + F.col("too_old") + F.col("expired"))
