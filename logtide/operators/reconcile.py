"""Late data: source events that the archive lacks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import reconcile_name
from ..session import settled
from ..sources import archive as archive_source
from ..sources import manifests as manifest_source
from . import drain
from .windows import with_window

CONTENT = ["timestamp", "stream", "message"]
SCOPE = ["account", "log_group"]


def identities(archive: DataFrame) -> DataFrame:
    """What ``archive`` knows events by, as a table in the shared folder, so that its objects are opened once: scope and id, or content where a record has no id (else null)."""
    return settled(archive.select(*SCOPE, "event_id", *[F.when(F.col("event_id").isNull(), F.col(c)).alias(c) for c in CONTENT]), "identities")


def _identities(archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids and contents, to be merged: an archive has as many as events, and what it takes on disk, packed, would have Spark send them through the driver to every executor."""
    by_id = archive.where("event_id is not null").select(*SCOPE, "event_id")
    return by_id.hint("merge"), archive.where("event_id is null").select(*SCOPE, *CONTENT).hint("merge")


def missing(source: DataFrame, archive: DataFrame) -> DataFrame:
    """Events of ``source`` to append; of several of one identity the first (by ``arrival``, or by time of ingestion).

    An event with an id is in the archive if the id is, or if an archived record without id has its content; one without id if such a record has its content.
    """
    by_id, by_content = _identities(archive)
    late = source.join(by_id, [*SCOPE, "event_id"], "left_anti").join(by_content, [*SCOPE, *CONTENT], "left_anti").select(source.columns)
    # Rows with and without id never share an identity; id rows leave the content out of theirs.
    own = [F.when(F.col("event_id").isNull(), F.col(c)) for c in CONTENT]
    order = [c for c in ("arrival", "ingestion_time", *CONTENT) if c in source.columns]
    first = F.row_number().over(Window.partitionBy(*SCOPE, "event_id", *own).orderBy(*order))
    return late.withColumn("_first", first).where("_first = 1").select(source.columns)


def archived(source: DataFrame, archive: DataFrame) -> DataFrame:
    """Events of ``source`` that the archive has, by the rule of ``missing``."""
    by_id, by_content = (x.distinct().withColumn(name, F.lit(True)).hint("merge") for x, name in zip(_identities(archive), ("_by_id", "_by_content"), strict=True))
    joined = source.join(by_id, [*SCOPE, "event_id"], "left").join(by_content, [*SCOPE, *CONTENT], "left")
    return joined.where(F.col("_by_id").isNotNull() | F.col("_by_content").isNotNull()).select(source.columns)


def next_attempt(names: DataFrame, keys: list[str]) -> DataFrame:
    """One more than the greatest attempt in names ``<start>-rAABBBB``; more than 99 is an error to report."""
    number = F.try_to_number(F.regexp_extract("name", r"-r(\d{2})\d{4}$", 1), F.lit("99")).cast("int")
    return names.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).cast("long").alias("attempt")).withColumn("allowed", F.col("attempt") <= 99)


def _attempts(known: DataFrame) -> DataFrame:
    """The next attempt of each window, by the names in its manifest."""
    names = archive_source.named(known).withColumn("window_start_ms", F.regexp_extract("object", r"^(-?\d+)-", 1).cast("long")).withColumnRenamed("object", "name")
    attempts = next_attempt(names, [*SCOPE, "window_start_ms"])
    return attempts.select(*SCOPE, "window_start_ms", F.when(F.col("allowed"), F.col("attempt")).otherwise(F.raise_error(F.lit("more than 99 attempts"))).alias("attempt"))


def append(late: DataFrame, known: DataFrame, path: str, target: int, size: Column, order: list[str], run: str) -> None:
    """Write late events (with their windows) to objects of the next attempt of their windows, as those of ``run``; no manifest names them yet."""
    _append(settled(late, "late"), known, path, target, size, order, run)


def _append(late: DataFrame, known: DataFrame, path: str, target: int, size: Column, order: list[str], run: str) -> None:
    numbered = late.join(_attempts(known), [*SCOPE, "window_start_ms"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(1).cast("long")))
    drain.write_windows(numbered, path, reconcile_name(F.col("window_start_ms"), F.col("attempt"), F.col("seq")), order, size, target, run)


def run(source: DataFrame, known: DataFrame, path: str, width: int, target: int, size: Column, order: list[str], now_ms: int) -> DataFrame:
    """Append to the windows that ``known`` (one manifest a window) covers the events of ``source`` that their archive lacks.

    What the archive has is read from the objects that the manifests of these windows name, so only their folders are opened.  Late events go to objects of the window's next
    attempt; then the window's manifest is written anew, with the objects it had and those of this run, ``reconciled_at_ms``
    and ``reconciled_added``.  A run that is lost before its manifests has appended nothing: the next one finds the same events late.  Returns
    (account, log_group, window, source_events, archived_events, appended); a run with nothing late writes no object and no manifest.  An attempt beyond 99 is an error.
    """
    spark, keys, own = source.sparkSession, [*SCOPE, *drain.WINDOW], uuid.uuid4().hex
    rows = with_window(source, width)
    touched = settled(known.where("version = 1").join(rows.select(*keys).distinct(), keys, "left_semi"), "touched")
    rows = rows.join(drain.covered(touched), keys, "left_semi")
    there = identities(archive_source.read_named(spark, f"{path}/data", touched))
    late = settled(missing(rows, there), "late")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("source_events")).join(late.groupBy(*keys).agg(F.count(F.lit(1)).alias("appended")), keys, "left").na.fill(0, ["appended"])
    outcome = counts.select(*keys, "source_events", (F.col("source_events") - F.col("appended")).alias("archived_events"), "appended")
    manifest_source.write_rows(outcome, f"{path}/outcome/{now_ms}")
    outcome = spark.read.schema(outcome.schema).parquet(f"{path}/outcome/{now_ms}")
    changed = outcome.where("appended > 0")
    if not changed.isEmpty():
        _append(late, touched, path, target, size, order, own)
        made = drain.described(changed.select(*keys), path, size, own).select(*keys, F.col("objects").alias("_new"), F.col("record_count").alias("_more"))
        made = touched.join(made, keys).join(changed.select(*keys, F.col("appended").alias("_added")), keys)
        made = made.withColumns({
            "objects": F.sort_array(F.concat("objects", "_new")), "record_count": F.col("record_count") + F.col("_more"),
            "reconciled_at_ms": F.lit(now_ms).cast("long"), "reconciled_added": F.col("_added"),
        })
        manifest_source.write(made.select(known.columns), f"{path}/manifest")
    return outcome


def everything(source: DataFrame, windows: DataFrame, known: DataFrame, path: str, width: int, target: int, size: Column, order: list[str], now_ms: int) -> DataFrame:
    """Windows without a manifest are drained, those with one reconciled: (account, log_group, window, had_manifest, source_events, archived_events, appended) of both."""
    keys = [*SCOPE, *drain.WINDOW]
    old = run(source, known, path, width, target, size, order, now_ms).withColumn("had_manifest", F.lit(True))
    made = drain.run(source, windows, known, path, width, target, size, order, now_ms)
    n = F.coalesce("record_count", F.lit(0))
    new = made.select(*keys, n.alias("source_events"), F.lit(0).cast("long").alias("archived_events"), n.alias("appended"), F.lit(False).alias("had_manifest"))
    return old.unionByName(new)


def report(windows: DataFrame) -> DataFrame:
    """Totals over per-window rows (had_manifest, source_events, archived_events, appended)."""
    return windows.groupBy(*SCOPE).agg(
        F.count(F.when(~F.col("had_manifest"), 1)).alias("windows_drained"), F.count(F.when(F.col("had_manifest"), 1)).alias("windows_reconciled"),
        F.count(F.when(F.col("had_manifest") & (F.col("appended") > 0), 1)).alias("windows_repaired"), F.sum("source_events").alias("source_events"),
        F.sum("archived_events").alias("archived_events"), F.sum("appended").alias("appended"),
    )
