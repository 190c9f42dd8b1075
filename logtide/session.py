"""A session with the settings the library needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Account numbers keep their leading zeros and dt stays text.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def session(app: str = "logtide", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names; only a local master may do without, with a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("logtide.scratch", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="logtide-")
        spark.conf.set("logtide.scratch", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` as a table in the shared folder, so that several uses do not work them out anew."""
    path = scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
