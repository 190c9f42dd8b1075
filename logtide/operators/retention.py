"""The retention gate: a group's logs may expire only where every older window is archived."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import DAY_MS
from ..functions.times import fmt_ts
from .drain import WINDOW, covered
from .windows import with_grid

KEYS = ["account", "log_group"]
SHOWN = 20


def required(groups: DataFrame, now_ms: int, days: int, width: int) -> DataFrame:
    """Windows of each group (account, log_group, creation_time_ms) from its creation to the cutoff."""
    if days <= 0:
        raise ValueError("retention days must be positive")
    cutoff = F.lit(now_ms - days * DAY_MS).cast("long")
    return with_grid(groups.select("account", "log_group", "creation_time_ms"), F.col("creation_time_ms"), cutoff, width, complete=False)


def missing_windows(groups: DataFrame, manifests: DataFrame, now_ms: int, days: int, width: int) -> DataFrame:
    return required(groups, now_ms, days, width).join(covered(manifests), ["account", "log_group", *WINDOW], "left_anti")


def gate(groups: DataFrame, manifests: DataFrame, now_ms: int, days: int, width: int) -> DataFrame:
    """Per account and group: required_windows, missing_windows, allowed.  A group without required windows is allowed."""
    lacking = covered(manifests).withColumn("_there", F.lit(1))
    windows = required(groups, now_ms, days, width).join(lacking, [*KEYS, *WINDOW], "left")
    counts = windows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("required_windows"), F.count(F.when(F.col("_there").isNull(), 1)).alias("missing_windows"))
    joined = groups.select(*KEYS).join(counts, KEYS, "left").na.fill(0, ["required_windows", "missing_windows"])
    return joined.withColumn("allowed", F.col("missing_windows") == 0)


def shown(missing: DataFrame, most: int = SHOWN) -> DataFrame:
    """Per account and group the first ``most`` missing windows, a display limit, and how many more there are."""
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*WINDOW))
    first = missing.withColumn("_place", place).groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.when(F.col("_place") <= most, F.struct(*WINDOW)))).alias("first"), F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more")
    )
    lines = F.transform("first", lambda w: F.concat_ws("/", fmt_ts(w["window_start_ms"]), fmt_ts(w["window_end_ms"])))
    return first.select(*KEYS, F.array_join(lines, ";").alias("windows"), F.col("more").cast("long").alias("more"))
