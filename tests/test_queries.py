"""Every query with SQL against DuckDB, and what the entry module promises."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from logtide.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((x is None, x or "") for x in r)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).columns == ["log_group", "timestamp", "stream", "message"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "logtide")):
        for name in names:
            if name.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"^\s*(from|import)\b.*\bllm\b", f.read(), re.M), name


def test_drain_covers_every_event(spark):
    from logtide.plans import fixtures as fx

    records, queries = fx.log_records(spark, SF), entry.queries()
    n = records.count()
    assert queries["drain_window_summary_whole"](spark, SF).selectExpr("sum(records)").first()[0] == n == queries["archive_roundtrip_whole"](spark, SF).count()
    last = records.selectExpr("max(timestamp)").first()[0]
    assert queries["drain_skip_whole"](spark, SF).selectExpr("max(window_end_ms)").first()[0] > last
    hours = records.where(f"(timestamp div {fx.HOUR}) % 4 <> 0").count()
    assert queries["drain_report_whole"](spark, SF).selectExpr("sum(records)").first()[0] == hours
