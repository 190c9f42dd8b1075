"""Search and restore: a time range, groups and a pattern over log records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.layout import date_of
from ..functions.patterns import matches, search_regex
from ..functions.times import fmt_ts, in_range, valid_range

ORDER = ["timestamp", "stream", "log_group", "arrival"]


def scan(records: DataFrame, start: int, end: int, groups: str | list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """Records of a half-open range.  A ``dt`` partition column is filtered too, as a filter on time alone does not prune it."""
    valid_range(start, end)
    found = records
    if "dt" in records.columns:
        first, last = (date_of(F.lit(t).cast("long")) for t in (start, end - 1))
        found = found.where(F.col("dt").between(first, last))
    if isinstance(groups, list):
        found = found.where(F.col("log_group").isin(groups))
    elif groups is not None:
        found = found.where(matches(F.col("log_group"), groups))
    found = found.where(in_range(F.col("timestamp"), start, end))
    return found.where(F.col("message").rlike(search_regex(pattern))) if pattern else found


def ordered(records: DataFrame) -> DataFrame:
    """Globally by time, then stream; ties in order of arrival where the rows have it."""
    return records.orderBy(*[c for c in ORDER if c in records.columns])


def grep(records: DataFrame, start: int, end: int, pattern: str | None, groups: str | list[str] | None = None) -> DataFrame:
    found = ordered(scan(records, start, end, groups, pattern))
    return found.select("log_group", "timestamp", "stream", "message")


def grep_lines(records: DataFrame, start: int, end: int, pattern: str | None, groups: str | list[str] | None = None) -> DataFrame:
    return grep(records, start, end, pattern, groups).select(F.concat_ws(" ", fmt_ts(F.col("timestamp")), "stream", "message").alias("line"))


def jsonl(records: DataFrame) -> DataFrame:
    """One JSON line a record; absent values are left out."""
    return records.select(F.to_json(F.struct("timestamp", "stream", "message", "ingestion_time", "event_id")).alias("line"))


def split_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON lines tolerantly: record columns and ``bad`` for lines that are no record; blank lines go."""
    from ..schemas import CORRUPT, RECORD

    parsed = lines.where(F.trim(column) != "").withColumn("r", F.from_json(column, f"{RECORD}, {CORRUPT} STRING", {"columnNameOfCorruptRecord": CORRUPT}))
    missing = F.col("r.timestamp").isNull() | F.col("r.stream").isNull() | F.col("r.message").isNull()
    return parsed.select("r.timestamp", "r.stream", "r.message", "r.ingestion_time", "r.event_id", (F.col(f"r.{CORRUPT}").isNotNull() | missing).alias("bad"))


def scan_counts(records: DataFrame, start: int, end: int, groups: str | list[str] | None = None, pattern: str | None = None) -> DataFrame:
    """One row: what a scan of tolerant rows (``bad``) would read, refuse, skip and find."""
    valid_range(start, end)
    here = F.lit(True) if groups is None else F.col("log_group").isin(groups) if isinstance(groups, list) else matches(F.col("log_group"), groups)
    good = ~F.col("bad")
    inside = good & here & in_range(F.col("timestamp"), start, end)
    hit = inside & F.col("message").rlike(search_regex(pattern)) if pattern else inside
    return records.agg(
        F.count(F.lit(1)).alias("read"), F.count(F.when(F.col("bad"), 1)).alias("bad"), F.count(F.when(good & ~inside, 1)).alias("outside"),
        F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(hit, 1)).alias("matched"),
    )


def observed(records: DataFrame, start: int, end: int, groups: str | list[str] | None = None, pattern: str | None = None) -> tuple[DataFrame, Observation]:
    """A scan, and an Observation that has ``matched`` of it after an action."""
    seen = Observation("scan")
    return scan(records, start, end, groups, pattern).observe(seen, F.count(F.lit(1)).alias("matched")), seen


def cleaned(events: DataFrame) -> DataFrame:
    """Events of a source as records: absent message or stream is empty, an event without time is no record."""
    return events.where("timestamp is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("message", "stream")})
