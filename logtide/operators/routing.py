"""Ordered routing rules: the first rule whose group and stream globs match decides."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import glob_regex, literal_prefix
from ..schemas import RULES

ACTIONS = ("s3", "cloudwatch", "both", "drop")


def parse_rules(text: str) -> tuple[list[tuple[int, str, str, str]], str]:
    """Rules and the default action of a TOML text."""
    config = tomllib.loads(text)
    default = config.get("default_action", "s3")
    rules = [(i, r["log_group"], r.get("stream", "*"), r["action"]) for i, r in enumerate(config.get("rule", []))]
    for i, group, stream, action in [*rules, (-1, "*", "*", default)]:
        if action not in ACTIONS:
            raise ValueError(f"rule {i}: unknown action {action}")
        glob_regex(group), glob_regex(stream)
    return rules, default


def route(group: Column, stream: Column, rules: list[tuple[int, str, str, str]], default: str) -> Column:
    """For a fixed list of rules: one CASE expression, evaluated in order."""
    out = F.lit(default)
    for _, g, s, action in sorted(rules, reverse=True):
        out = F.when(group.rlike(glob_regex(g)) & stream.rlike(glob_regex(s)), F.lit(action)).otherwise(out)
    return out


TABLE = f"{RULES}, group_regex STRING, stream_regex STRING, group_start STRING, stream_start STRING"
NAMES = [f.split()[0] for f in TABLE.split(", ")]


def rule_table(spark: SparkSession, rules: list[tuple[int, str, str, str]]) -> DataFrame:
    """Rules with their expressions and the literal text that each glob begins with."""
    return spark.createDataFrame([(*r, glob_regex(r[1]), glob_regex(r[2]), literal_prefix(r[1]), literal_prefix(r[2])) for r in rules], TABLE)


def rule_rows(rules: DataFrame) -> DataFrame:
    """``rule_table`` of rules in a table (rule_idx, group_glob, stream_glob, action), however many: each pair of globs once, with its least rule, as no later one of the same globs
    ever decides; expressions are made by tasks."""
    first = rules.groupBy("group_glob", "stream_glob").agg(F.min_by("action", "rule_idx").alias("action"), F.min("rule_idx").alias("rule_idx"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            globs = [batch.column(i).to_pylist() for i in (1, 2)]
            made = [pa.array([f(g) for g in column], pa.string()) for f in (glob_regex, literal_prefix) for column in globs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], NAMES)

    return first.select(F.col("rule_idx").cast("int"), "group_glob", "stream_glob", "action").mapInArrow(run, TABLE)


def _met(rows: DataFrame, rules: DataFrame, starts: dict[str, str]) -> DataFrame:
    """``rows`` with the rules whose globs begin as their columns do (``starts``: column of rows, of rules).

    A row asks once for each combination of lengths that rules begin with, a few dozens at most; equal beginnings are joined, and no row meets a rule
    that begins otherwise.
    """
    lengths = [F.length(c).alias(f"_n{i}") for i, c in enumerate(starts.values())]
    asked = [r.asDict() for r in rules.select(*lengths).distinct().collect()]
    if not asked:
        return rows.limit(0).join(rules.limit(0), F.lit(True))
    shapes = F.array(*[F.struct(*[F.lit(n).alias(k) for k, n in a.items()]) for a in asked])
    rows = rows.withColumn("_shape", F.explode(shapes))
    for i, (c, start) in enumerate(starts.items()):
        rows = rows.withColumns({f"_k{i}": F.substring(F.col(c), F.lit(1), F.col(f"_shape._n{i}")), f"_n{i}": F.col(f"_shape._n{i}")})
        rules = rules.withColumns({f"_k{i}": F.col(start), f"_n{i}": F.length(start)})
    keys = [f"_{k}{i}" for i in range(len(starts)) for k in "kn"]
    return rows.drop("_shape").join(rules, keys).drop(*keys)


def routed(streams: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For rules in a table: each distinct (log_group, stream) with the action of the least rule that matches it; expressions are tried on rules that begin alike only."""
    names = streams.select("log_group", "stream").distinct()
    met = _met(names, rules.drop("group_glob", "stream_glob"), {"log_group": "group_start", "stream": "stream_start"})
    hits = met.where(F.rlike("log_group", F.col("group_regex")) & F.rlike("stream", F.col("stream_regex")))
    least = hits.groupBy("log_group", "stream").agg(F.min_by("action", "rule_idx").alias("action"))
    return names.join(least, ["log_group", "stream"], "left").withColumn("action", F.coalesce("action", F.lit(default)))


def reaches_service(groups: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Per group: may any of its streams go on to the log service?  The stream glob does not count."""
    names = groups.select("log_group").distinct()
    onward = rules.where(F.col("action").isin("cloudwatch", "both")).select("group_regex", "group_start")
    hits = _met(names, onward, {"log_group": "group_start"}).where(F.rlike("log_group", F.col("group_regex"))).select("log_group").distinct().withColumn("_hit", F.lit(True))
    return names.join(hits, "log_group", "left").select("log_group", (F.coalesce("_hit", F.lit(False)) | F.lit(default in ("cloudwatch", "both"))).alias("reaches"))


def fan_out(action: Column) -> tuple[Column, Column]:
    """Whether a record goes to the archive and to the log service."""
    return action.isin("s3", "both"), action.isin("cloudwatch", "both")
