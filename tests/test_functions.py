import re
from urllib.parse import quote

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtide.functions import costs, layout, patterns, times


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_sanitize_round_trip(spark):
    names = ["/aws/lambda/payments-prod", "g=1%2", "a b*c~é+", "", "plain._-"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", layout.sanitize(F.col("n")).alias("s"))
    for r in rows.withColumn("back", layout.unsanitize(F.col("s"))).collect():
        assert r.s == quote(r.n, safe="").replace("~", "%7E")
        assert r.back == r.n
    assert one(spark, layout.unsanitize(F.lit("%zz"))) is None


def test_keys(spark):
    key = one(spark, layout.data_key(F.lit("/p/"), F.lit("123456789012"), F.lit("/a/b"), F.lit("2026-06-10"), F.lit("1717900000000-000001")))
    assert key == "p/data/account=123456789012/loggroup=%2Fa%2Fb/dt=2026-06-10/1717900000000-000001.jsonl.zst"
    parsed = {k: one(spark, c) for k, c in layout.parse_data_key(F.lit(key)).items()}
    assert parsed == {"account": "123456789012", "log_group": "/a/b", "dt": "2026-06-10", "name": "1717900000000-000001"}
    assert one(spark, layout.parse_data_key(F.lit("p/data/x"))["name"]) is None


@pytest.mark.parametrize("ms, day", [(0, "1970-01-01"), (1765411200000, "2025-12-11"), (-1, "1969-12-31"), (10**17, "1970-01-01")])
def test_date(spark, ms, day):
    assert one(spark, layout.date_of(F.lit(ms).cast("long"))) == day


def test_times(spark):
    assert times.time_ms("2024-06-05T00:00:00Z") == 1_717_545_600_000 == times.time_ms("1717545600000") == times.time_ms("2024-06-05T02:00:00+02:00")
    assert times.duration_ms("15M") == 900_000
    assert times.size_bytes("4MiB") == 4 << 20 and times.size_bytes("3k") == 3000 and times.size_bytes("7") == 7
    for bad in ("10", "5 weeks"):
        with pytest.raises(ValueError):
            times.duration_ms(bad)
    with pytest.raises(ValueError):
        times.valid_range(5, 5)
    assert one(spark, times.fmt_ts(F.lit(1_717_545_600_001).cast("long"))) == "2024-06-05T00:00:00.001Z"
    assert one(spark, times.fmt_ts(F.lit(10**17).cast("long"))) == "100000000000000000ms"
    assert one(spark, times.format_bytes(F.lit(1536).cast("long"))) == "1.5 KiB"


@pytest.mark.parametrize("low, high, hit", [(0, 99, False), (50, 100, True), (200, 300, False), (199, 250, True)])
def test_overlap(spark, low, high, hit):
    assert one(spark, times.overlaps(F.lit(low), F.lit(high), 100, 200)) is hit


def test_globs():
    match = lambda glob, name: re.search(patterns.glob_regex(glob).replace(r"\z", r"\Z"), name) is not None
    assert match("*", "/aws/lambda/foo") and match("/a/{b,c}/?", "/a/c/x") and match("[!x]y", "ay") and match(r"\*", "*")
    assert not match("/a/{b,c}/?", "/a/d/x") and not match("[!x]y", "xy") and not match("a.c", "abc")
    assert patterns.literal_prefix("/a/b*") == "/a/b"
    for bad in ("[a", "{a", "a}", "a\\"):
        with pytest.raises(ValueError):
            patterns.glob_regex(bad)


@given(st.text(alphabet="ab/*?.", max_size=8), st.text(alphabet="ab/.", max_size=8))
def test_globs_like_fnmatch(glob, name):
    import fnmatch

    assert (re.search(patterns.glob_regex(glob).replace(r"\z", r"\Z"), name) is not None) == fnmatch.fnmatchcase(name, glob)


def test_search_regex(spark):
    assert one(spark, F.lit("abc\n").rlike(patterns.search_regex("abc$"))) is False
    assert one(spark, F.lit("a\rb").rlike(patterns.search_regex("a.b"))) is True
    assert one(spark, F.lit("a$").rlike(patterns.search_regex("[$]$"))) is True
    for bad in ("(?=a)", r"(a)\1", "("):
        with pytest.raises((ValueError, re.error)):
            patterns.search_regex(bad)


PATTERNS = [
    (r"(?m)end$", "first line end\n at Foo.bar", True), (r"end$", "first line end\n at Foo.bar", False), (r"(?m)^ at", "x\n at", True), (r"(?m:b$)c|z$", "z\n", False),
    (r"n=\d", "n=\u0665", True), (r"^\w+$", "\u00fcn\u00ef", True), (r"\p{Lu}x", "\u00c4x", True), (r"\pL{2}", "\u00e4\u00e4", True), (r"\p{Greek}", "\u03b1", True),
    (r"^\x{41}\z", "A", True), (r"\u{1F600}", "\U0001f600", True), (r"(?<n>a)(?P<m_1>b)", "ab", True), (r"foo(?i)bar", "fooBAR", True), (r"foo(?i)bar", "FOObar", False),
    (r"^[[:alpha:]]+$", "aZ", True), (r"^[[:alpha:]]+$", "\u00e4", False), (r"[[:^digit:]]", "5", False), (r"^[]$]+$", "]$", True), (r"^[^]]$", "]", False), (r"^[a-z--[aeiou]]+$", "bcd", True),
    (r"^[a-z--[aeiou]]+$", "bad", False), (r"a{2, 3}$", "aaa", True), (r"\vx", "\x0bx", True), (r"\<ab\>", "x ab y", True), (r"\<ab\>", "xab", False), (r"(?-u)\w", "\u00e4", False), (r"a\$", "a$", True), (r"", "x", True),
]


@pytest.mark.parametrize("pattern, text, hit", PATTERNS)
def test_patterns_of_linear_time_engines(spark, pattern, text, hit):
    assert one(spark, F.lit(text).rlike(patterns.search_regex(pattern))) is hit


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?<!a)b", r"(a)\1", r"(", r")", r"[a", r"a++", r"a{2}{3}", r"(?U)a*", r"\Qa", r"[[:nope:]]", r"\p{Nope}", "a\\", r"[a~~b]", "*a"])
def test_patterns_that_are_refused(spark, pattern):
    with pytest.raises(ValueError):
        patterns.search_regex(pattern)


def test_costs(spark):
    assert one(spark, costs.price_per_gib_month(F.lit("GLACIER_IR"))) == 0.004
    assert one(spark, costs.price_per_gib_month(F.lit(None).cast("string"))) == 0.023
    assert one(spark, costs.retention_label(F.lit(None).cast("int"))) == "never!"


def test_options_that_exclude_each_other():
    assert times.one_of(group=None, pattern="/a*", every=None) == "pattern"
    for options in ({"group": None, "pattern": None}, {"group": "a", "pattern": "b"}):
        with pytest.raises(ValueError, match="exactly one of group, pattern"):
            times.one_of(**options)
