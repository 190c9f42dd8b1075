"""Windowed extraction: what each window holds, what is archived already, what it costs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.costs import LOG_RATIO, LOG_STORAGE, STANDARD, gib
from ..functions.layout import data_key, date_of, drain_name
from ..functions.times import format_bytes
from ..session import scratch, settled
from ..sources import archive
from ..sources import manifests as manifest_source
from .folds import hot, rotate
from .windows import LAG_MS, with_grid, with_window

WINDOW = ["window_start_ms", "window_end_ms"]
KEYS = ["account", "log_group"]


def covered(manifests: DataFrame) -> DataFrame:
    """Keys of windows with a valid manifest; an undecodable one or one of another version covers nothing."""
    return manifests.where("version = 1").select("account", "log_group", *WINDOW).distinct()


def pending(windows: DataFrame, manifests: DataFrame) -> DataFrame:
    return windows.join(covered(manifests), ["account", "log_group", *WINDOW], "left_anti")


def skipped(windows: DataFrame, manifests: DataFrame) -> DataFrame:
    return windows.join(covered(manifests), ["account", "log_group", *WINDOW], "left_semi")


def window_summary(windows: DataFrame, records: DataFrame, width: int) -> DataFrame:
    """Per window of the grid its records and bytes, empty windows included."""
    size = F.octet_length("message")
    sums = with_window(records, width).groupBy("account", "log_group", *WINDOW).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("raw_bytes"))
    joined = windows.join(sums, ["account", "log_group", *WINDOW], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("records", "raw_bytes")})


def outcome_report(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Sum outcomes (skipped, records, dropped, raw_bytes, compressed_bytes, objects); a skipped window adds only itself."""
    done = ~F.col("skipped")
    sums = {c: F.sum(F.when(done, F.col(c)).otherwise(0)).alias(to) for c, to in (
        ("records", "records"), ("dropped", "events_outside_window"), ("raw_bytes", "raw_bytes"), ("compressed_bytes", "compressed_bytes"), ("objects", "objects_written"),
    )}
    report = outcomes.groupBy(*keys).agg(
        F.count(F.when(F.col("skipped"), 1)).alias("windows_skipped"), F.count(F.when(done, 1)).alias("windows_processed"),
        F.count(F.when(done & (F.col("records") == 0), 1)).alias("windows_empty"), *sums.values(),
    )
    return report.withColumns({"log_usd": _log(F.col("raw_bytes")), "archive_usd": gib(F.col("compressed_bytes")) * STANDARD}).withColumn(
        "savings_usd", F.col("log_usd") - F.col("archive_usd")
    )


def lines(report: DataFrame, *keys: str) -> DataFrame:
    """(keys, lines, json) of ``outcome_report``: text for people, and for programs."""
    n = lambda name: F.col(name).cast("string")
    money = lambda name: F.concat(F.lit("$"), F.format_string("%.4f", F.col(name)))
    out = [
        F.concat(n("windows_processed"), F.lit(" windows archived, "), n("windows_empty"), F.lit(" of them empty, "), n("windows_skipped"), F.lit(" skipped")),
        F.concat(n("records"), F.lit(" records in "), n("objects_written"), F.lit(" objects, "), n("events_outside_window"), F.lit(" outside")),
        F.concat(format_bytes(F.col("raw_bytes")), F.lit(" raw, "), format_bytes(F.col("compressed_bytes")), F.lit(" compressed")),
        F.concat(F.lit("a month: "), money("log_usd"), F.lit(" as logs, "), money("archive_usd"), F.lit(" archived")),
    ]
    counts = ["windows_skipped", "windows_processed", "windows_empty", "records", "events_outside_window", "raw_bytes", "compressed_bytes", "objects_written"]
    return report.select(*keys, F.array_join(F.array(*out), "\n").alias("lines"), F.to_json(F.struct(*keys, *counts)).alias("json"))


def _log(raw: Column) -> Column:
    return gib(raw) / LOG_RATIO * LOG_STORAGE


def manifest_rows(objects: DataFrame) -> DataFrame:
    """Nested manifests from flat objects (a row without data_key stands for an empty window)."""
    fields = ["data_key", "etag", "crc32c", "body_len", "raw_bytes", "storage_class", "record_count", "min_ts", "max_ts"]
    have = [c for c in fields if c in objects.columns]
    text = ("data_key", "etag", "storage_class")
    one = F.struct(*[F.col(c) if c in have else F.lit(None).cast("string" if c in text else "long").alias(c) for c in fields])
    return objects.groupBy("account", "log_group", *WINDOW).agg(
        F.sort_array(F.collect_list(F.when(F.col("data_key").isNotNull(), one))).alias("objects"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("record_count")
    ).withColumn("version", F.lit(1).cast("long"))


def shards(streams: DataFrame, keys: list[str], wanted: int, most: int = 100) -> DataFrame:
    """Deal a key's streams, in order, round to shards of at most ``most``."""
    own = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(own)
    count = F.least(n, F.greatest(F.lit(max(wanted, 1)), F.ceil(n / most)))
    place = F.row_number().over(own.orderBy("stream")) - 1
    return streams.withColumns({"shard": F.pmod(place, count).cast("long"), "shards": count.cast("long")})


def due(groups: DataFrame, now_ms: int, width: int, start_ms: int | None = None) -> DataFrame:
    """Whole windows of each group, from ``start_ms`` or else its creation, that ended at least the source's lag ago."""
    low = F.col("creation_time_ms") if start_ms is None else F.lit(start_ms).cast("long")
    return with_grid(groups, low, F.lit(now_ms - LAG_MS).cast("long"), width, complete=True).select(*KEYS, *WINDOW)


def write_windows(records: DataFrame, path: str, name: Column, order: list[str], size: Column, target: int, run: str) -> None:
    """Cut the records of each window to objects of about ``target`` bytes, in ``order``, and write them under their names (of column ``seq``) as those of ``run``."""
    sized, folder = records.withColumn("_size", size.cast("long")), [*KEYS, date_of(F.col("window_start_ms"))]
    near = None if hot(sized, folder) else folder
    cut = rotate(sized, [*KEYS, *WINDOW], order, "_size", target, near=near)
    archive.write_objects(cut.withColumn("object", name), f"{path}/data", run, together=near is not None)


def _empty(windows: DataFrame) -> DataFrame:
    return manifest_rows(windows.withColumns({"data_key": F.lit(None).cast("string"), "record_count": F.lit(None).cast("long")}))


def described(windows: DataFrame, path: str, size: Column, run: str) -> DataFrame:
    """Manifests of ``windows`` with the objects that ``run`` wrote, as they are read back, and those of empty windows."""
    spark = windows.sparkSession
    first, last = windows.agg(F.min("window_start_ms"), F.max("window_end_ms")).first()
    if first is None:
        return _empty(windows.limit(0))
    days = spark.range(1).select(date_of(F.lit(first).cast("long")), date_of(F.lit(last - 1).cast("long"))).first()
    objects = archive.decoded(archive.read_run(spark, f"{path}/data", run, tuple(days)), size)  # one listing of the folders and one reading tell all
    key = data_key(F.lit(""), F.col("account"), F.col("log_group"), F.col("dt"), F.col("object"))
    start = F.regexp_extract("object", r"^(-?\d+)-", 1).cast("long")
    objects = objects.select(
        *KEYS, start.alias("window_start_ms"), key.alias("data_key"), F.col("run").alias("etag"), F.col("bytes").alias("body_len"), "raw_bytes", "record_count", "min_ts", "max_ts"
    )
    return manifest_rows(windows.join(objects, [*KEYS, "window_start_ms"], "left"))


def run(
    records: DataFrame, windows: DataFrame, known: DataFrame, path: str, width: int, target: int, size: Column, order: list[str], now_ms: int, dry_run: bool = False
) -> DataFrame:
    """Archive the windows that no manifest of ``known`` covers, and return their manifests; ``dry_run`` writes nothing and returns ``window_summary`` of them.

    Objects are written first, named by window and sequence number, below ``path``/data; then a manifest for every window, empty ones
    too, below ``path``/manifest.  What was read back decides what manifests say.  Every run writes its objects as its own (a fresh id, the manifests' ``etag``), so a run that is lost
    before its manifests leaves objects that nothing names, and the next one archives their windows anew: each event is in one named object.  A run
    with nothing pending writes nothing.
    """
    todo = pending(windows, known)
    if dry_run:
        return window_summary(todo, records, width)
    todo = settled(todo, "pending")
    if todo.isEmpty():
        return manifest_source.none(windows.sparkSession)
    rows, own = with_window(records, width).join(todo, [*KEYS, *WINDOW], "left_semi"), uuid.uuid4().hex
    if not rows.isEmpty():
        write_windows(rows, path, drain_name(F.col("window_start_ms"), F.col("seq")), order, size, target, own)
        made = described(todo, path, size, own)
    else:
        made = _empty(todo)
    manifest_source.write(made.withColumn("completed_at_ms", F.lit(now_ms).cast("long")), f"{path}/manifest")
    return manifest_source.read(windows.sparkSession, f"{path}/manifest").where("valid").join(todo, [*KEYS, *WINDOW], "left_semi")


HASHES, MOST_FAILURES = 1 << 30, 1_000
OUTCOME = "account string, log_group string, window_start_ms long, window_end_ms long, error string"


def _alone(windows: DataFrame, action: Callable[[DataFrame], object], failed: list[tuple]) -> None:
    """Do ``action`` on ``windows`` (with _hash), and where it fails on their halves, until those that fail stand alone, in ``failed``; on no part of none."""
    parts = [(0, HASHES)]
    while parts:
        low, high = parts.pop()
        part = windows.where((F.col("_hash") >= low) & (F.col("_hash") < high)).drop("_hash")
        try:
            action(part)
        except Exception as e:
            alone = part.limit(2).collect()  # two rows at most
            if len(alone) == 1 or high - low == 1:
                failed += [(*row, str(e).splitlines()[0][:300]) for row in alone]
                if len(failed) > MOST_FAILURES:
                    raise
            else:
                parts += [(low, (low + high) // 2), ((low + high) // 2, high)]


def isolated(records: DataFrame, windows: DataFrame, known: DataFrame, path: str, width: int, target: int, size: Column, order: list[str], now_ms: int) -> DataFrame:
    """As ``run``, but a window that fails keeps none of the others from being archived.

    Where the run over all pending windows fails, those whose records cannot be read are looked for: one pass over the records of a part, which is taken in two halves (by a
    hash of the window) where it fails, until those that fail stand alone.  All others are then archived in one run; only if this fails too, in halves in the same way.
    Returns (account, log_group, window, error) of every pending window; only those without error have manifests.  More than ``MOST_FAILURES`` failures are no
    matter of single windows, and the last one is raised.
    """
    spark, listed = windows.sparkSession, scratch(windows.sparkSession, "pending")
    hashed = pending(windows, known).select(*KEYS, *WINDOW).withColumn("_hash", F.pmod(F.xxhash64(*KEYS, *WINDOW), F.lit(HASHES)))
    hashed.write.parquet(listed)  # parts are taken of it, and no part works the windows out anew
    todo, failed = spark.read.schema(hashed.schema).parquet(listed), []
    needed = list(dict.fromkeys([*KEYS, "timestamp", "stream", "message", "ingestion_time", "event_id", *order]))

    def archived(part: DataFrame) -> None:
        run(records, part, known.limit(0), path, width, target, size, order, now_ms)

    def readable(part: DataFrame) -> None:
        rows = with_window(records, width).join(part, [*KEYS, *WINDOW], "left_semi")
        rows.agg(F.max(F.xxhash64(*needed, size))).collect()  # one value

    try:
        archived(todo.drop("_hash"))
    except Exception:
        _alone(todo, readable, failed)
        _alone(todo.join(F.broadcast(spark.createDataFrame(failed, OUTCOME)), [*KEYS, *WINDOW], "left_anti"), archived, failed)
    return todo.drop("_hash").join(F.broadcast(spark.createDataFrame(failed, OUTCOME)), [*KEYS, *WINDOW], "left")


def isolated_report(outcomes: DataFrame, groups: DataFrame) -> DataFrame:
    """Per account and group: windows, failed, the retention of groups where all went well (J8: no other may be changed), and ``label``, how many of all groups those are."""
    sums = outcomes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("windows"), F.count("error").alias("failed"))
    well = F.count(F.when(F.col("failed") == 0, 1))
    label = sums.agg(F.concat_ws("/", well.cast("string"), F.count(F.lit(1)).cast("string")).alias("label"))  # one row
    kept = groups.select(*KEYS, "retention_days")
    joined = sums.join(kept, KEYS, "left").crossJoin(F.broadcast(label))
    return joined.withColumn("retention_days", F.when(F.col("failed") == 0, F.col("retention_days")))


def outside(records: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """Per account and group the records that lie in none of the ``windows``."""
    rows = with_window(records, width).groupBy(*KEYS, *WINDOW).agg(F.count(F.lit(1)).alias("n"))
    left = rows.join(windows.select(*KEYS, *WINDOW).withColumn("_there", F.lit(1)), [*KEYS, *WINDOW], "left")
    return left.groupBy(*KEYS).agg(F.coalesce(F.sum(F.when(F.col("_there").isNull(), F.col("n"))), F.lit(0)).alias("events_outside_window"))


def failures(outcomes: DataFrame) -> DataFrame:
    """Per group of outcomes (window and ``error``, null where it went well): failed, ok, any_failed and the first failed window's error."""
    bad = F.col("error").isNotNull()
    return outcomes.groupBy(*KEYS).agg(
        F.count(F.when(bad, 1)).alias("failed"), F.count(F.when(~bad, 1)).alias("ok"), F.max(bad).alias("any_failed"),
        F.min(F.when(bad, F.struct("window_start_ms", "error"))).alias("_first"),
    ).select(*KEYS, "failed", "ok", "any_failed", F.col("_first.window_start_ms").alias("first_failed_ms"), F.col("_first.error").alias("first_error"))
