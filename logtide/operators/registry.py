"""Groups and streams that have been seen, and pages of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = 50


def registry(records: DataFrame) -> DataFrame:
    return records.groupBy("log_group", "stream").agg(F.min("ingestion_time").alias("first_seen"), F.count(F.lit(1)).alias("records"))


def describe(names: DataFrame, column: str, prefix: str = "", token: int = 0, limit: int | None = None) -> DataFrame:
    """A page of names with a prefix: at most 50, from ``token`` on; next_token where more follow."""
    n = min(max(limit if limit is not None else PAGE, 1), PAGE)
    rows = names.where(F.col(column).startswith(prefix)).select(column).distinct().orderBy(column).limit(token + n + 1)  # no task sorts more names than that
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(column)) - 1)
    rows = rows.withColumn("next_token", F.when(F.max("place").over(Window.partitionBy()) >= token + n, F.lit(token + n).cast("long")))
    return rows.where((F.col("place") >= token) & (F.col("place") < token + n)).select(column, F.col("place").cast("long").alias("place"), "next_token")


def find(names: DataFrame, column: str, name: str) -> DataFrame:
    """The row of exactly this name; a ValueError if there is none."""
    found = names.where(F.col(column) == name)
    if found.isEmpty():
        raise ValueError(f"{column} {name} was not found")
    return found


def create_checks(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """What creating each (log_group, stream) says, a null stream being the group itself: exists, no group, or created."""
    groups = known.select("log_group").distinct().withColumn("_group", F.lit(True))
    streams = known.where("stream is not null").select("log_group", "stream").distinct().withColumn("_stream", F.lit(True))
    joined = wanted.join(groups, "log_group", "left").join(streams, ["log_group", "stream"], "left")
    has_group, has_stream = F.col("_group").isNotNull(), F.col("_stream").isNotNull()
    said = F.when(F.col("stream").isNull(), F.when(has_group, "exists").otherwise("created")).when(~has_group, "no group").when(has_stream, "exists").otherwise("created")
    return joined.select(*wanted.columns, said.alias("outcome"))
