"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests on one machine) is a temporary folder made,
    once for the session.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("logtide.scratch", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="logtide-")
        spark.conf.set("logtide.scratch", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The written table cuts the lineage and survives the loss of any executor.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def text_of(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> StructType:
    """A new schema: that of ``df`` and further (name, type) fields."""
    schema = StructType(list(df.schema.fields))
    for name, kind in fields:
        schema.add(name, kind)
    return schema
