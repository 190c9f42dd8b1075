"""Log tables derived from the ``events`` table, for queries and tests; each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import data_key, date_of
from ..operators.drain import manifest_rows

ACCOUNT, HOUR, DAY = "123456789012", 3_600_000, 86_400_000
T0 = 1_704_067_200_000
"""2024-01-01T00:00:00Z, when the events begin."""


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return events.select(
        F.lit(ACCOUNT).alias("account"), F.concat(F.lit("/app/"), "event_type").alias("log_group"),
        F.concat(F.lit("app/i-"), (F.col("user_id") % 16).cast("string")).alias("stream"), ts.alias("timestamp"),
        F.concat(F.upper("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" "), "props").alias("message"),
        (ts + 250).alias("ingestion_time"), F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("evt-"), F.col("event_id").cast("string"))).alias("event_id"),
        F.col("event_id").alias("arrival"),
    )


LOGS = """lr AS (SELECT '123456789012' AS account, '/app/' || event_type AS log_group, 'app/i-' || CAST(user_id % 16 AS VARCHAR) AS stream,
  epoch_us(ts) // 1000 AS timestamp, upper(event_type) || ' user=' || CAST(user_id AS VARCHAR) || ' ' || props AS message, epoch_us(ts) // 1000 + 250 AS ingestion_time,
  CASE WHEN event_id % 10 <> 0 THEN 'evt-' || CAST(event_id AS VARCHAR) END AS event_id, event_id AS arrival FROM events)"""


OTHER = "210987654321"


def two_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records dealt to two accounts, so that groups of both have the same names."""
    return log_records(spark, sf_dir).withColumn("account", F.when(F.col("arrival") % 3 == 0, OTHER).otherwise(F.col("account")))


TWO = f"l2 AS (SELECT * REPLACE (CASE WHEN arrival % 3 = 0 THEN '{OTHER}' ELSE account END AS account) FROM lr)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat archive objects: one or two for each group and hour, but for hours with remainder 3 by 11."""
    rows = log_records(spark, sf_dir).withColumn("window_start_ms", F.col("timestamp") - F.col("timestamp") % HOUR)
    rows = rows.withColumns({"h": F.floor(F.col("window_start_ms") / HOUR), "part": F.col("arrival") % 2})
    flat = rows.where("h % 11 <> 3").groupBy("account", "log_group", "window_start_ms", "h", "part").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum(F.octet_length("message") + 40).alias("raw"), F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts")
    )
    name = F.format_string("%d-%06d", "window_start_ms", "part")
    key = data_key(F.lit("arc"), F.col("account"), F.col("log_group"), date_of(F.col("window_start_ms")), name)
    cls = F.when(F.col("h") % 5 == 1, "STANDARD").when(F.col("h") % 5 == 2, "STANDARD_IA").when(F.col("h") % 5 == 3, "GLACIER_IR")
    return flat.select(
        "account", "log_group", "window_start_ms", (F.col("window_start_ms") + HOUR).alias("window_end_ms"), key.alias("data_key"),
        F.expr("raw div 6").alias("body_len"), F.when(F.col("h") % 5 != 4, F.col("raw")).alias("raw_bytes"), cls.alias("storage_class"), "record_count", "min_ts", "max_ts",
    )


OBJECTS = f"""{LOGS}, ob AS (SELECT account, log_group, h * 3600000 AS window_start_ms, h * 3600000 + 3600000 AS window_end_ms, h, part,
  raw // 6 AS body_len, CASE WHEN h % 5 <> 4 THEN raw END AS raw_bytes,
  CASE h % 5 WHEN 1 THEN 'STANDARD' WHEN 2 THEN 'STANDARD_IA' WHEN 3 THEN 'GLACIER_IR' END AS storage_class, record_count
  FROM (SELECT account, log_group, timestamp // 3600000 AS h, arrival % 2 AS part, count(*) AS record_count, CAST(sum(strlen(message) + 40) AS BIGINT) AS raw
        FROM lr WHERE (timestamp // 3600000) % 11 <> 3 GROUP BY ALL)),
mf AS (SELECT account, log_group, window_start_ms, window_end_ms, CAST(sum(record_count) AS BIGINT) AS record_count FROM ob GROUP BY ALL)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_rows(objects(spark, sf_dir))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group: created at its first record's day, bytes, and retention for some."""
    rows = log_records(spark, sf_dir).groupBy("account", "log_group").agg(F.min("timestamp").alias("first"), F.sum(F.octet_length("message")).alias("bytes"))
    first = F.col("first") - F.col("first") % DAY
    days = F.when(F.col("log_group").like("%e%"), F.length("log_group").cast("int") * 5)
    return rows.select("account", "log_group", first.alias("creation_time_ms"), days.alias("retention_days"), (F.col("bytes") * 1000).alias("stored_bytes"))


GROUPS = f"""{LOGS}, gr AS (SELECT account, log_group, min(timestamp) // 86400000 * 86400000 AS creation_time_ms,
  CASE WHEN log_group LIKE '%e%' THEN length(log_group) * 5 END AS retention_days, CAST(sum(strlen(message)) * 1000 AS BIGINT) AS stored_bytes FROM lr GROUP BY account, log_group)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily ingest sums, for all groups but one."""
    rows = log_records(spark, sf_dir).where("log_group <> '/app/view'")
    day = F.col("timestamp") - F.col("timestamp") % DAY
    return rows.groupBy("log_group", day.alias("ts_ms")).agg(F.sum(F.octet_length("message") + 26).cast("double").alias("value"))


METRICS = f"""{GROUPS}, mt AS (SELECT log_group, timestamp // 86400000 * 86400000 AS ts_ms, CAST(sum(strlen(message) + 26) AS DOUBLE) AS value
  FROM lr WHERE log_group <> '/app/view' GROUP BY ALL)"""


def framed(spark: SparkSession, sf_dir: str, size: int = 16) -> DataFrame:
    """Records dealt to frames of ``size`` within each group and day, in a slightly jittered order, so that frames overlap."""
    from pyspark.sql import Window

    rows = log_records(spark, sf_dir).withColumn("dt", date_of(F.col("timestamp")))
    order = Window.partitionBy("log_group", "dt").orderBy(F.col("timestamp") + (F.col("arrival") * 7919 % 7) * 600_000, "arrival")
    return rows.withColumn("frame_idx", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


FRAMED = f"""{LOGS}, fr AS (SELECT *, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS dt, CAST((row_number() OVER (PARTITION BY log_group, timestamp // 86400000
  ORDER BY timestamp + (arrival * 7919 % 7) * 600000, arrival) - 1) // 16 AS INTEGER) AS frame_idx FROM lr),
fi AS (SELECT log_group, dt, frame_idx, count(*) AS records, CAST(sum(strlen(message)) AS BIGINT) AS original_size, min(timestamp) AS min_ts, max(timestamp) AS max_ts
  FROM fr GROUP BY log_group, dt, frame_idx)"""
