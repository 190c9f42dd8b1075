"""Blocks of records with their least and greatest time: index, pruning, clustering, coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import overlaps
from ..session import scratch


def frame_index(records: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Per frame (``keys`` with frame_idx) its count, bytes, time bounds and offset in its object."""
    index = records.groupBy(*keys, "frame_idx").agg(
        F.count(F.lit(1)).alias("records"), F.sum(size).alias("original_size"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")
    )
    before = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumn("original_offset", F.coalesce(F.sum("original_size").over(before), F.lit(0)))


def prune(index: DataFrame, start: int, end: int) -> DataFrame:
    return index.where(overlaps(F.col("min_ts"), F.col("max_ts"), start, end))


def _level(low: Column, high: Column) -> Column:
    """The power of two that is the width of bins of which an interval, both ends included, meets two at most."""
    return F.ceil(F.log2((high - low + 1).cast("double"))).cast("int")


def _binned(rows: DataFrame, low: str, high: str, levels: Column) -> DataFrame:
    """A row for each bin that each interval meets, at each of ``levels``."""
    rows = rows.withColumn("_level", F.explode(levels))
    width = F.pow(F.lit(2.0), F.col("_level")).cast("long")
    first = F.floor(F.col(low) / width).cast("long")
    return rows.withColumns({f"_first_{low}": first, "_bin": F.explode(F.sequence(first, F.floor(F.col(high) / width).cast("long")))})


def prune_many(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pairs of frames (min_ts, max_ts) and ``ranges`` (start, end; half open) that meet, each once.

    Intervals are met by bins of time, with one join of equal bins a side: each range at the width that fits it with all frames that are no
    longer, and each frame at its own with all ranges that are shorter.  So an interval has at most two bins at each width that occurs, and a bin holds what is near.
    """
    frames = index.where("min_ts <= max_ts").withColumn("_own", _level(F.col("min_ts"), F.col("max_ts")))
    wanted = ranges.where(F.col("start") < F.col("end")).withColumn("_last", F.col("end") - 1).withColumn("_asked", _level(F.col("start"), F.col("_last")))
    there = lambda df, c: F.array(*[F.lit(r[0]) for r in df.select(c).distinct().orderBy(c).collect()]).cast("array<int>")  # noqa: E731  # some 60 widths at most
    of_frames, of_ranges = there(frames, "_own"), there(wanted, "_asked")
    sides = [
        (_binned(wanted, "start", "_last", F.array("_asked")), _binned(frames, "min_ts", "max_ts", F.filter(of_ranges, lambda x: x >= F.col("_own")))),
        (_binned(wanted, "start", "_last", F.filter(of_frames, lambda x: x > F.col("_asked"))), _binned(frames, "min_ts", "max_ts", F.array("_own"))),
    ]
    meet = overlaps(F.col("min_ts"), F.col("max_ts"), F.col("start"), F.col("end")) & (F.col("_bin") == F.greatest("_first_start", "_first_min_ts"))
    found = [a.join(b, ["_level", "_bin"]).where(meet).select(*ranges.columns, *index.columns) for a, b in sides]
    return found[0].unionByName(found[1])


def met_sums(index: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(key, frames, records, first_ts): how many frames each key's ``ranges`` (start, end; half open) meet, their records and least min_ts; keys that meet none are left out.

    As ``prune_many`` and a sum over its pairs, but no pair is made, so work grows with frames and ranges alone.  Frames that a range meets are those that begin before its end, less those
    that end before its start; the first of them has the least beginning of all that end at the start or later.  So each end of a range needs one running sum over
    the times of all frames.  Times are ordered by range into partitions, which are written, as ranges drawn twice might differ; each is summed by itself, and what stands before or behind it is added.
    """
    spark, path = index.sparkSession, scratch(index.sparkSession, "times")
    frames = index.where("min_ts <= max_ts").select("min_ts", "max_ts", F.coalesce("records", F.lit(0)).cast("long").alias("records"))
    wanted = ranges.where(F.col("start") < F.col("end")).select(F.col(key).alias("_key"), "start", "end")
    none, no_key = F.lit(None).cast("long").alias("_low"), F.lit(None).cast(wanted.schema["_key"].dataType).alias("_key")
    one = F.count(F.lit(1))
    begins = frames.groupBy(F.col("min_ts").alias("_t")).agg(one.alias("_begun"), F.sum("records").alias("_r"))
    ends = frames.groupBy(F.col("max_ts").alias("_t")).agg(one.alias("_over"), F.sum("records").alias("_r"), F.min("min_ts").alias("_low"))
    zero, told = F.lit(0).cast("long"), lambda kind: F.lit(kind).alias("_kind")
    # Of one time, ends of ranges (kinds 0 and 1) come before frames.
    points = begins.select("_t", told(2), F.col("_begun"), F.col("_r").alias("_begun_r"), zero.alias("_over"), zero.alias("_over_r"), none, no_key, none.alias("_end"))
    points = points.unionByName(ends.select("_t", told(2), zero.alias("_begun"), zero.alias("_begun_r"), "_over", F.col("_r").alias("_over_r"), "_low", no_key, none.alias("_end")))
    for kind, at, end in ((0, "start", F.col("end")), (1, "end", none)):
        points = points.unionByName(wanted.select(F.col(at).alias("_t"), told(kind), *[zero.alias(c) for c in SUMS], none, "_key", end.alias("_end")))
    points.repartitionByRange("_t", "_kind", F.xxhash64("_key")).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    there = spark.read.schema(points.schema.add("_part", "integer")).parquet(path)
    totals = there.groupBy("_part").agg(*[F.sum(c).alias(f"_all{c}") for c in SUMS], F.min("_low").alias("_all_low"))  # a row a partition
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_all{c}").over(up), F.lit(0)).alias(f"_before{c}") for c in SUMS], F.min("_all_low").over(down).alias("_behind"))
    rising = Window.partitionBy("_part").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = Window.partitionBy("_part").orderBy(F.desc("_t"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = there.select("*", *[F.sum(c).over(rising).alias(f"_run{c}") for c in SUMS]).withColumn("_least", F.min("_low").over(falling))
    met = run.where("_kind < 2").join(F.broadcast(offsets), "_part")
    begun, begun_r, over, over_r = (F.col(f"_run{c}") + F.col(f"_before{c}") for c in SUMS)
    least = F.least("_least", "_behind")
    ending = F.col("_kind") == 1
    sums = met.groupBy(F.col("_key").alias(key)).agg(
        F.sum(F.when(ending, begun).otherwise(-over)).alias("frames"), F.sum(F.when(ending, begun_r).otherwise(-over_r)).alias("records"),
        F.min(F.when(~ending & (least < F.col("_end")), least)).alias("first_ts"),
    )
    return sums.where("frames > 0")


SUMS = ["_begun", "_begun_r", "_over", "_over_r"]
"""Frames begun and over, and their records."""


def zipped(offsets: DataFrame, times: DataFrame, key: str) -> DataFrame:
    """Join the two halves of an index by frame; objects whose halves differ in length have ``ok`` false."""
    joined = offsets.join(times, [key, "frame_idx"], "full")
    both = F.col("byte_start").isNotNull() & F.col("min_ts").isNotNull()
    return joined.withColumn("ok", F.min(both).over(Window.partitionBy(key)))


def cluster(index: DataFrame, keys: list[str]) -> DataFrame:
    """Number the runs of frames whose times overlap: a frame joins while it begins at or before the run's greatest time."""
    order = Window.partitionBy(*keys).orderBy("min_ts", "frame_idx")
    reach = F.max("max_ts").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("min_ts") > reach), 1).otherwise(0)
    return index.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(order) - 1).drop("_new")


def coalesce_spans(spans: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Merge byte spans of an object that are at most ``gap`` apart, in object order."""
    order = Window.partitionBy(*keys).orderBy("byte_start", "frame_idx")
    apart = F.greatest(F.col("byte_start") - F.lag("byte_end").over(order), F.lit(0))
    new = F.when(apart.isNull() | (apart > gap), 1).otherwise(0)
    runs = spans.withColumn("_new", new).withColumn("run", F.sum("_new").over(order) - 1)
    return runs.groupBy(*keys, "run").agg(
        F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), F.count(F.lit(1)).alias("frames"), F.sum("original_size").alias("original_size")
    )
