"""Streaming ingest: requests are exploded, routed and written by group and UTC day.

Buffers, flushes and the write-ahead log of a hand-written gateway are Structured Streaming's micro-batches and checkpoint:
a trigger's interval is the age limit, the source's bytes a trigger the size limit, ``availableNow`` the final flush.  Each
micro-batch replaces its own folder, so one that is run again after a failure writes no row twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.layout import date_of
from ..operators.routing import fan_out, route
from ..schemas import REQUEST

MAX_AGE, MAX_BYTES = "60 seconds", 8 << 20


def requests(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(REQUEST)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader.option("maxBytesPerTrigger", MAX_BYTES)
    return reader.json(path)


def records(incoming: DataFrame, account: str, rules: list, default: str) -> DataFrame:
    """One row an event with its action; works on batches and streams alike."""
    rows = incoming.select(F.col("logGroupName").alias("log_group"), F.col("logStreamName").alias("stream"), F.explode("logEvents").alias("e"))
    rows = rows.select(F.lit(account).alias("account"), "log_group", "stream", "e.timestamp", "e.message", date_of(F.col("e.timestamp")).alias("dt"))
    return rows.withColumn("action", route(F.col("log_group"), F.col("stream"), rules, default))


def ingest(rows: DataFrame, archive: str, forward: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write archived and forwarded rows; ``once`` takes all that is there and stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        to_archive, to_service = fan_out(F.col("action"))
        batch.where(to_archive).drop("action").write.mode("overwrite").partitionBy("account", "log_group", "dt").parquet(f"{archive}/batch={batch_id}")
        batch.where(to_service).drop("action").write.mode("overwrite").parquet(f"{forward}/batch={batch_id}")
        batch.unpersist()

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=MAX_AGE)).start()


def late_filter(rows: DataFrame, delay: str = "15 minutes") -> DataFrame:
    """Drop repeated events within the delay that sources may have; what comes later is left to reconciliation."""
    timed = rows.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["account", "log_group", "stream", "timestamp", "message"])


def flushes(rows: DataFrame) -> DataFrame:
    """What one flush of all buffers would write: rows and bytes by group and day."""
    size = F.octet_length("message") + F.octet_length("stream") + 64
    return rows.groupBy("log_group", "dt").agg(F.count(F.lit(1)).alias("records"), F.sum(size).cast("long").alias("bytes"))


FLUSH = "log_group string, dt string, number long, reason string, records long, bytes long, first_ms long"
BUFFER = "number long, records long, bytes long, first_ms long"
ROW_BYTES = 64


def buffered(rows: DataFrame, max_bytes: int = MAX_BYTES, max_age_ms: int = 60_000, lateness: str = "10 minutes") -> DataFrame:
    """What a buffer for each group and day would write, as a stream of ``FLUSH`` rows in update mode.

    ``rows`` (log_group, dt, stream, message, arrival_ms, arrival) are taken in order of arrival.  A buffer is closed by ``size`` once it has ``max_bytes``, by ``age`` when a row
    arrives ``max_age_ms`` after its first or when the watermark says that none came; after each micro-batch an ``open`` row tells what the buffer holds.  Only
    counts, bytes and the first time are kept as state.
    """
    size = (F.octet_length("message") + F.octet_length("stream") + ROW_BYTES).cast("long").alias("size")
    timed = rows.select("log_group", "dt", "arrival_ms", "arrival", size, F.timestamp_millis("arrival_ms").alias("arrived")).withWatermark("arrived", lateness)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, records, total, first = state.get if state.exists else (0, 0, 0, 0)
        out = []

        def close(reason: str) -> None:
            nonlocal number, records, total
            out.append((*key, number, reason, records, total, first))
            number, records, total = number + 1, 0, 0

        if state.hasTimedOut:
            if records:
                close("age")
        else:
            for at, _, n in sorted(x for part in parts for x in part[["arrival_ms", "arrival", "size"]].itertuples(index=False, name=None)):
                if records and at - first >= max_age_ms:
                    close("age")
                if not records:
                    first = at
                records, total = records + 1, total + n
                if total >= max_bytes:
                    close("size")
            if records:
                out.append((*key, number, "open", records, total, first))
        state.update((number, records, total, first))
        if records:
            state.setTimeoutTimestamp(max(first + max_age_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in FLUSH.split(", ")])

    return timed.groupBy("log_group", "dt").applyInPandasWithState(step, FLUSH, BUFFER, "update", "EventTimeTimeout")


def flushed(told: DataFrame) -> DataFrame:
    """All flushes of the rows that ``buffered`` gave until it was stopped: what was open then is written by ``shutdown``."""
    last = F.max_by(F.struct("reason", "records", "bytes", "first_ms"), F.struct(F.col("reason") != "open", "records")).alias("last")
    rows = told.groupBy("log_group", "dt", "number").agg(last).select("log_group", "dt", "number", "last.*")
    return rows.withColumn("reason", F.when(F.col("reason") == "open", "shutdown").otherwise(F.col("reason")))


def buffer_run(rows: DataFrame, out: str, checkpoint: str, **limits: int) -> DataFrame:
    """Take all that is there, and the flushes of it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    flow = buffered(rows, **limits).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    flow.awaitTermination()
    if flow.exception():
        raise flow.exception()
    return flushed(rows.sparkSession.read.schema(FLUSH).parquet(out))
