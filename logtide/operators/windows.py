"""Window grids: tumbling windows that restart every UTC day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import DAY_MS
from ..functions.times import align_down, next_boundary

LAG_MS = 15 * 60_000


def _starts(low: Column, high: Column, width: int) -> Column:
    """Starts of all windows from that which holds ``low`` to before ``high``."""
    day = lambda c: c - F.pmod(c, F.lit(DAY_MS))
    days = F.sequence(day(low), F.greatest(day(high), day(low)), F.lit(DAY_MS))
    every = F.flatten(F.transform(days, lambda d: F.sequence(d, d + DAY_MS - 1, F.lit(width))))
    return F.filter(every, lambda s: (s >= align_down(low, width)) & (s < high))


def with_grid(rows: DataFrame, low: Column, high: Column, width: int, complete: bool) -> DataFrame:
    """A row for each window of each row's range: those that end by ``high`` (complete) or all that start before it."""
    if width <= 0:
        raise ValueError("a window needs a positive width")
    grid = rows.withColumn("window_start_ms", F.explode(F.when(low < high, _starts(low, high, width)).otherwise(F.array().cast("array<bigint>"))))
    grid = grid.withColumn("window_end_ms", next_boundary(F.col("window_start_ms"), width))
    return grid.where(F.col("window_end_ms") <= high) if complete else grid


def grid(spark: SparkSession, start: int, end: int, width: int, complete: bool = True) -> DataFrame:
    return with_grid(spark.range(1).select(), F.lit(start).cast("long"), F.lit(end).cast("long"), width, complete)


def with_window(records: DataFrame, width: int) -> DataFrame:
    """Each record's own window, by arithmetic."""
    start = align_down(F.col("timestamp"), width)
    return records.withColumns({"window_start_ms": start, "window_end_ms": next_boundary(start, width)})
