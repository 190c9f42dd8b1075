"""Queries with SQL against DuckDB."""

import pytest

from logtide.llm import registry
from tests.test_queries import duck, plain  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    df = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((x is None, x or "") for x in r)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=key)
