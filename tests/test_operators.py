import random

import pytest
from pyspark.sql import functions as F

from logtide.functions import patterns
from logtide.operators import drain, folds, frames, plan, reconcile, report, restore, retention, routing, search, windows
from logtide.sources import archive
from logtide.sources import manifests as sources

H, DAY, DAY0 = 3_600_000, 86_400_000, 1_717_545_600_000
GIB = 1 << 30


def starts(df):
    return [(r.window_start_ms, r.window_end_ms) for r in df.orderBy("window_start_ms").collect()]


def test_grids(spark):
    assert [s for s, _ in starts(windows.grid(spark, DAY0 + 22 * H + H // 2, DAY0 + 26 * H, H))] == [DAY0 + h * H for h in (22, 23, 24, 25)]
    assert len(starts(windows.grid(spark, DAY0, DAY0 + H + 1, H))) == 1
    assert [(s - DAY0) // H for s, _ in starts(windows.grid(spark, DAY0, DAY0 + 31 * H, 7 * H))] == [0, 7, 14, 21, 24]
    assert len(starts(windows.grid(spark, DAY0, DAY0 + H + H // 2, H, complete=False))) == 2
    assert starts(windows.grid(spark, DAY0, DAY0, H)) == []


def test_grid_tiles(spark):
    dice = random.Random(3)
    for _ in range(4):
        width, start = dice.randrange(1, 30) * 1_000_000, DAY0 + dice.randrange(DAY)
        end = start + dice.randrange(1, 3 * DAY)
        got = starts(windows.grid(spark, start, end, width, complete=False))
        assert got[0][0] <= start and got[-1][1] >= end
        assert all(a[1] == b[0] for a, b in zip(got, got[1:])) and all(s // DAY == (e - 1) // DAY for s, e in got)


RECORD = "log_group string, timestamp long, stream string, message string, arrival long"


def test_search(spark):
    rows = [("g", 99, "a", "ERROR"), ("g", 100, "a", "ERROR x"), ("g", 150, "ERROR", "ok"), ("g", 199, "b", "an ERROR"), ("g", 200, "b", "ERROR")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RECORD)
    assert [r.timestamp for r in search.grep(df, 100, 200, "ERROR").collect()] == [100, 199]
    with pytest.raises(ValueError):
        search.grep(df, 200, 200, None)


def test_merge_ties(spark):
    rows = [("g1", 5, "a", "z2", 1), ("g1", 5, "a", "z", 0), ("g2", 5, "a", "b", 2), ("g3", 4, "z", "c", 3)]
    assert [r.message for r in search.ordered(spark.createDataFrame(rows, RECORD)).collect()] == ["c", "z", "z2", "b"]


def test_tolerant_lines(spark):
    good = '{"timestamp": 1, "stream": "s", "message": "m", "unknown": 2}'
    lines = spark.createDataFrame([(good,), ("",), ("not json",), ('{"stream": "s", "message": "m"}',)], "value string")
    assert sorted(r.bad for r in search.split_lines(lines).collect()) == [False, True, True]


def clusters(spark, spans):
    df = spark.createDataFrame([("o", i, a, b) for i, (a, b) in enumerate(spans)], "object string, frame_idx int, min_ts long, max_ts long")
    return [r.n for r in frames.cluster(df, ["object"]).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()]


def test_clusters(spark):
    assert clusters(spark, [(0, 9), (10, 19), (20, 29)]) == [1, 1, 1]
    assert clusters(spark, [(0, 15), (10, 19), (30, 40)]) == [2, 1]
    assert clusters(spark, [(20, 29), (0, 21), (25, 40), (100, 110)]) == [3, 1]


@pytest.mark.parametrize("gap, runs", [(8, 1), (7, 2)])
def test_coalesce(spark, gap, runs):
    spans = spark.createDataFrame([("o", 0, 0, 10, 5), ("o", 1, 18, 30, 5)], "object string, frame_idx int, byte_start long, byte_end long, original_size long")
    assert frames.coalesce_spans(spans, ["object"], gap).count() == runs


def batch_spec(events, n, size, span):
    out, now = [], []
    for ts, cost in events:
        if now and (len(now) >= n or sum(c for _, c in now) + cost > size or ts - now[0][0] > span):
            out, now = [*out, now], []
        now.append((ts, cost))
    return [*out, now] if now else out


def sizes(spark, events, **limits):
    df = spark.createDataFrame([("k", i, ts, cost) for i, (ts, cost) in enumerate(events)], "k string, i long, timestamp long, cost long")
    rows = folds.batches(df, ["k"], ["timestamp", "i"], "cost", **limits).groupBy("batch").count().orderBy("batch").collect()
    return [r["count"] for r in rows]


def test_batches(spark):
    half = 1_048_576 // 2
    assert sizes(spark, [(0, half)] * 3) == [2, 1]
    assert sizes(spark, [(0, half + 1)] * 2) == [1, 1]
    assert sizes(spark, [(i, 1) for i in range(10_001)]) == [10_000, 1]
    assert sizes(spark, [(0, 1), (DAY, 1), (DAY + 1, 1)]) == [2, 1]
    dice = random.Random(5)
    events = sorted((dice.randrange(1000), dice.randrange(1, 60)) for _ in range(500))
    assert sizes(spark, events, max_events=7, max_bytes=150, max_span=40) == [len(b) for b in batch_spec(events, 7, 150, 40)]


def test_rotate_cuts_after(spark):
    df = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 6, 3, 20, 1])], "k string, i long, size long")
    assert [r.seq for r in folds.rotate(df, ["k"], ["i"], "size", 10).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_savings(spark):
    row = spark.createDataFrame([(False, 1, 0, 10 * GIB, GIB, 1), (True, 9, 9, 9, 9, 9)], "skipped boolean, records long, dropped long, raw_bytes long, compressed_bytes long, objects long")
    got = drain.outcome_report(row).first()
    assert (got.log_usd, got.archive_usd, round(got.savings_usd, 9), got.windows_skipped, got.records) == (0.075, 0.023, 0.052, 1, 1)


def made(spark, objects):
    columns = "account string, log_group string, window_start_ms long, window_end_ms long, data_key string, body_len long, raw_bytes long, storage_class string, record_count long, min_ts long, max_ts long"
    return drain.manifest_rows(spark.createDataFrame([("1", *o, 0, 0) for o in objects], columns))


def test_report(spark):
    rows = made(spark, [("g", 0, H, "a", GIB, 5 * GIB, None, 100), ("g", H, 2 * H, "b", GIB, 5 * GIB, "STANDARD", 200), ("g", 3 * H, 4 * H, None, None, None, None, 0)])
    got = report.groups(rows).first()
    assert (got.windows, got.objects, got.records, got.compression_ratio, got.coverage_gaps) == (3, 2, 300, 5.0, 1)
    assert (got.log_usd, got.archive_usd, round(got.savings_usd, 9), got.objects_assumed_standard) == (0.075, 0.046, 0.029, 1)
    mixed = report.groups(made(spark, [("g", 0, H, c or "x", GIB, None, c, 1) for c in ("STANDARD", "STANDARD_IA", "GLACIER_IR")])).first()
    assert round(mixed.archive_usd, 9) == 0.0395 and mixed.compression_ratio is None and mixed.is_lower_bound


def test_plan(spark):
    row = spark.createDataFrame([("g", None, 100 * GIB, 60.0 * GIB)], "log_group string, retention_days int, stored_bytes long, ingest_bytes_sampled double")
    got = plan.costs(row, 30).first()
    want = (3.0, 30.0, 33.0, 1.495, 0.26, 27.0, 28.505)
    assert tuple(round(got[c], 9) for c in ("log_storage_usd", "log_ingest_usd", "log_total_usd", "archive_standard_usd", "archive_cold_usd", "bypass_usd", "savings_usd")) == want
    assert round(plan.costs(row.withColumns({"stored_bytes": F.lit(0), "ingest_bytes_sampled": F.lit(7.0 * GIB)}), 7).first().savings_usd, 9) == 13.5


@pytest.mark.parametrize("n, wanted, want", [(10, 3, [4, 3, 3]), (250, 2, [84, 83, 83]), (2, 8, [1, 1])])
def test_shards(spark, n, wanted, want):
    df = spark.createDataFrame([("g", f"s{i:03d}") for i in range(n)], "log_group string, stream string")
    got = drain.shards(df, ["log_group"], wanted).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in got] == want


RULES = """
default_action = "s3"
[[rule]]
log_group = "/lambda/payments*"
stream = "audit*"
action = "both"
[[rule]]
log_group = "/lambda/payments*"
action = "cloudwatch"
[[rule]]
log_group = "/ecs/*"
action = "drop"
"""


def test_routing(spark):
    rules, default = routing.parse_rules(RULES)
    want = {("/lambda/payments", "audit-1"): "both", ("/lambda/payments", "x"): "cloudwatch", ("/lambda/other", "x"): "s3", ("/ecs/api", "x"): "drop"}
    rows = spark.createDataFrame(list(want), "log_group string, stream string")
    by_case = rows.withColumn("action", routing.route(F.col("log_group"), F.col("stream"), rules, default))
    for df in (by_case, routing.routed(rows, routing.rule_table(spark, rules), default)):
        assert {(r.log_group, r.stream): r.action for r in df.collect()} == want
    for bad in ('default_action = "x"', '[[rule]]\nlog_group = "[a"\naction = "s3"'):
        with pytest.raises(ValueError):
            routing.parse_rules(bad)


EVENT = "account string, log_group string, timestamp long, stream string, message string, event_id string, arrival long"


def test_reconcile(spark):
    make = lambda rows: spark.createDataFrame([("1", "g", t, "s", m, e, i) for i, (t, m, e) in enumerate(rows)], EVENT)
    ids = lambda df: sorted(r.event_id for r in df.collect())
    source = make([(1, "a", "e1"), (2, "b", "e2"), (3, "c", "e3"), (4, "d", "e4"), (4, "d", "e5"), (4, "d", "e5")])
    assert ids(reconcile.missing(source, make([(1, "a", "e1"), (2, "b", "e2"), (3, "c", "e3")]))) == ["e4", "e5"]
    assert ids(reconcile.missing(source, make([(1, "a", None), (2, "b", None), (4, "d", None)]))) == ["e3"]
    assert reconcile.missing(source, source).count() == 0
    names = spark.createDataFrame([("g", "1-r010000"), ("g", "1-000003"), ("h", "1-000001"), ("i", "1-r990000")], "log_group string, name string")
    assert {r.log_group: (r.attempt, r.allowed) for r in reconcile.next_attempt(names, ["log_group"]).collect()} == {"g": (2, True), "h": (1, True), "i": (100, False)}


def test_retention(spark):
    groups = spark.createDataFrame([("1", "g", DAY0), ("1", "new", DAY0 + 40 * DAY)], "account string, log_group string, creation_time_ms long")
    proof = made(spark, [("g", DAY0 + i * H, DAY0 + (i + 1) * H, None, None, None, None, 0) for i in range(24)])
    now = DAY0 + 8 * DAY
    gate = lambda m: {r.log_group: (r.required_windows, r.missing_windows, r.allowed) for r in retention.gate(groups, m, now, 7, H).collect()}
    assert gate(proof) == {"g": (24, 0, True), "new": (0, 0, True)}
    assert gate(proof.withColumn("version", F.when(F.col("window_start_ms") == DAY0, 2).otherwise(1)))["g"] == (24, 1, False)
    with pytest.raises(ValueError):
        retention.gate(groups, proof, now, 0, H)


def test_manifests(spark):
    texts = ['{"version":1,"account":"000000000000","log_group":"g","window_start_ms":0,"window_end_ms":1,"objects":[]}', "", "{", '{"version":2,"window_end_ms":1}']
    parsed = sources.parse(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert [r.valid for r in parsed.collect()] == [True, False, False, False]
    assert parsed.where(sources.covers("000000000000", "g", 0, 1)).count() == 1


def test_rejections(spark):
    df = spark.createDataFrame([(10, 8, 3, 1), (5, None, None, 9)], "batch_len int, too_new_start int, too_old_end int, expired_end int")
    assert [(r.too_old, r.too_new, r.expired, r.rejected) for r in restore.rejections(df).collect()] == [(3, 2, 1, 6), (0, 0, 5, 5)]


def test_wrap(spark):
    got = spark.range(1).select(restore.wrap(F.lit("m"), F.lit("s"), F.lit(5), F.lit("g")).alias("a"), restore.wrap(F.lit("m"), F.lit("s"), F.lit(5), None).alias("b")).first()
    assert got.a == '{"message":"m","original_log_group":"g","original_stream":"s","original_timestamp":5}'
    assert got.b == '{"message":"m","original_stream":"s","original_timestamp":5}'


def test_drain_and_reconcile(spark, tmp_path):
    """Two windows with records and one without; a second drain writes nothing; late events go to the next attempt, and a third pass appends none."""
    from pyspark.sql import functions as F

    from logtide.sources import archive, manifests

    schema = "account string, log_group string, timestamp long, stream string, message string, ingestion_time long, event_id string"
    rows = [("1", "/g", H * (i % 2) * 2 + i, "s", f"m{i}", i, f"e{i}") for i in range(10)]
    records, path, size = spark.createDataFrame(rows, schema), str(tmp_path), F.octet_length("message")
    groups = spark.createDataFrame([("1", "/g", 0)], "account string, log_group string, creation_time_ms long")
    due = drain.due(groups, 3 * H + windows.LAG_MS, H)
    assert due.count() == 3 and drain.due(groups, 3 * H, H).count() == 2
    order, limits = ["timestamp", "event_id"], (path, H, 4, size, ["timestamp", "event_id"])
    made = drain.run(records.where("event_id <> 'e4'"), due, manifests.none(spark), *limits, 99)
    objects = {r.window_start_ms: [(o.data_key.split("/")[-1], o.record_count, o.raw_bytes) for o in r.objects] for r in made.collect()}
    assert objects == {0: [("0-000000.jsonl.zst", 2, 4), ("0-000001.jsonl.zst", 2, 4)], H: [], 2 * H: [(f"{2 * H}-00000{i}.jsonl.zst", n, 2 * n) for i, n in enumerate((2, 2, 1))]}
    known = lambda: manifests.latest(manifests.read(spark, f"{path}/manifest"))
    assert drain.run(records, due, known(), *limits, 100).count() == 0 and archive.listing(spark, f"{path}/data").count() == 5
    got = [reconcile.run(records, known(), *limits, now).where("appended > 0").collect() for now in (200, 300)]
    assert [(r.window_start_ms, r.source_events, r.appended) for r in got[0]] == [(0, 5, 1)] and got[1] == []
    first = known().where("window_start_ms = 0").first()
    assert (first.reconciled_at_ms, first.reconciled_added, first.completed_at_ms, first.record_count) == (200, 1, 99, 5)
    assert first.objects[-1].data_key.endswith("/0-r010000.jsonl.zst") and known().count() == 3
    checked = archive.validate(known(), archive.listing(spark, f"{path}/data"), archive.decoded(archive.read_objects(spark, f"{path}/data"), size))
    assert checked.where("problem is not null").count() == 0 and checked.count() == 6
    assert order == limits[-1]


def test_registry_checks(spark):
    from logtide.operators import registry

    known = spark.createDataFrame([("/a", "s"), ("/a", None)], "log_group string, stream string")
    wanted = spark.createDataFrame([("/a", None), ("/b", None), ("/a", "s"), ("/a", "t"), ("/b", "s")], "log_group string, stream string")
    assert {(r.log_group, r.stream): r.outcome for r in registry.create_checks(wanted, known).collect()} == {
        ("/a", None): "exists", ("/b", None): "created", ("/a", "s"): "exists", ("/a", "t"): "created", ("/b", "s"): "no group",
    }
    assert registry.find(known, "stream", "s").count() == 1
    with pytest.raises(ValueError):
        registry.find(known, "stream", "x")


def test_observed_scan(spark):
    df = spark.createDataFrame([(i, "g", f"m{i}") for i in range(10)], "timestamp long, log_group string, message string")
    rows, seen = search.observed(df, 2, 8, None, "[35]$")
    assert rows.count() == 2 and seen.get == {"matched": 2}
    assert search.cleaned(spark.createDataFrame([(1, None, None), (None, "m", "s")], "timestamp long, message string, stream string")).collect()[0][1:] == ("", "")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_named_objects_prune_folders(spark, tmp_path):
    """Of an archive with orphans only named objects are opened, and only folders of their days are listed."""
    path = f"file://{tmp_path}/data"
    rows = spark.createDataFrame([("1", "/a b", f"s{i}", i * 43_200_000, "m", None, None, f"{i // 2 * 86_400_000}-000000") for i in range(8)], "account string, log_group string, stream string, timestamp long, message string, ingestion_time long, event_id string, object string")
    for run in ("lost", "kept"):
        archive.write_objects(rows, path, run)
    key = F.concat(F.lit("data/account=1/loggroup=%2Fa%20b/dt=1970-01-0"), F.expr("cast(id + 1 as string)"), F.lit("/"), (F.col("id") * 86_400_000).cast("string"), F.lit("-000000.jsonl.zst"))
    manifests = spark.range(1, 3).select(F.array(F.struct(key.alias("data_key"), F.lit("kept").alias("etag"), F.lit(2).alias("record_count"), F.lit(0).alias("raw_bytes"), F.lit(0).alias("body_len"))).alias("objects"))
    found = archive.read_named(spark, path, manifests)
    assert sorted(r.timestamp for r in found.collect()) == [i * 43_200_000 for i in range(2, 6)] and {r.run for r in found.collect()} == {"kept"}
    assert "dynamicpruning" in plan_of(found) and "dt=1970-01-04" not in "".join(archive.read_objects(spark, path, ("1970-01-02", "1970-01-03")).inputFiles())
    assert archive.read_named(spark, path, manifests.limit(0)).count() == 0
    (tmp_path / "data" / "note.txt").write_text("not an object")
    assert archive.strangers(spark, path).count() == 1 and archive.listing(spark, path).count() == 8
    unnamed = archive.listing(spark, path).join(archive.named(manifests), archive.OBJECT_KEYS, "left_anti")
    assert unnamed.where("run = 'lost'").count() == 4 and unnamed.count() == 6


def test_partition_folders_are_named_as_spark_does(spark, tmp_path):
    groups = ["/app/x", "a b", "a=b:c", "100%", "q?[x]{y}^#*\"'\\\\", "é"]
    rows = spark.createDataFrame([(1, g) for g in groups], "v int, loggroup string")
    rows.write.partitionBy("loggroup").json(f"file://{tmp_path}/t")
    assert {f"loggroup={archive.quote_path(g)}" for g in groups} == {f.name for f in (tmp_path / "t").iterdir() if f.is_dir()}


def test_table_reads_one_day(spark, tmp_path):
    rows = spark.createDataFrame([("1", "/g", "s", i * 86_400_000, "m", None, None) for i in range(5)], "account string, log_group string, stream string, timestamp long, message string, ingestion_time long, event_id string")
    archive.write(rows, f"file://{tmp_path}/a")
    table = archive.create_table(spark, "one_day", f"file://{tmp_path}/a")
    day = table.where("dt = '1970-01-03'")
    assert [r.timestamp for r in day.collect()] == [2 * 86_400_000]
    relation = day._jdf.queryExecution().optimizedPlan().toString()
    assert "dt=1970-01-03" in "".join(day.inputFiles()) and len(day.inputFiles()) == 1, relation
    archive.write(rows.withColumn("timestamp", F.col("timestamp") + 10 * 86_400_000), f"file://{tmp_path}/a")
    assert spark.table("one_day").count() == 5
    spark.sql(archive.add_partition("one_day", f"file://{tmp_path}/a", "1", "/g", "1970-01-11"))
    assert spark.table("one_day").count() == 6
    spark.sql("DROP TABLE one_day")


def test_many_ranges_and_frames(spark):
    dice = random.Random(6)
    frames_ = [(i, a, a + dice.choice([0, 1, 50, 1000, 10**9])) for i in range(300) for a in [dice.randrange(-5000, 5000)]]
    ranges = [(i, a, a + dice.choice([0, 1, 2, 64, 5000, 10**10])) for i in range(200) for a in [dice.randrange(-5000, 5000)]]
    found = frames.prune_many(spark.createDataFrame(frames_, "frame_idx int, min_ts long, max_ts long"), spark.createDataFrame(ranges, "range_id int, start long, end long"))
    want = sorted((r, f) for r, s, e in ranges for f, lo, hi in frames_ if s < e and lo < e and hi >= s)
    assert sorted((x.range_id, x.frame_idx) for x in found.collect()) == want
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert frames.prune_many(spark.createDataFrame(frames_[:0], "frame_idx int, min_ts long, max_ts long"), spark.createDataFrame(ranges, "range_id int, start long, end long")).count() == 0


def test_sums_of_met_frames_without_pairs(spark):
    """The same as sums over all pairs, also of keys with several ranges and of equal times; no join of frames and ranges is planned."""
    dice = random.Random(8)
    frames_ = [(i, a, a + dice.choice([0, 0, 1, 5, 400]), dice.choice([1, 7])) for i in range(400) for a in [dice.randrange(-60, 60)]] + [(400, 5, 4, 1), (401, None, 4, 1)]
    ranges = [(i % 150, a, a + dice.choice([-1, 0, 1, 2, 30, 500])) for i in range(200) for a in [dice.randrange(-600, 90)]] + [(None, 0, 9), (151, None, 3)]
    pairs = [(k, n, lo) for k, s, e in ranges if s is not None and s < e for _, lo, hi, n in frames_ if lo is not None and lo <= hi and lo < e and hi >= s]
    want = {k: (len(x), sum(n for _, n, _ in x), min(lo for _, _, lo in x)) for k in {p[0] for p in pairs} for x in [[p for p in pairs if p[0] == k]]}
    index = spark.createDataFrame(frames_, "frame_idx int, min_ts long, max_ts long, records long")
    found = frames.met_sums(index, spark.createDataFrame(ranges, "range_id int, start long, end long").repartition(6), "range_id")
    assert {r.range_id: (r.frames, r.records, r.first_ts) for r in found.collect()} == want
    assert "SortMergeJoin" not in plan_of(found) and "NestedLoop" not in plan_of(found)
    assert frames.met_sums(index.limit(0), spark.createDataFrame(ranges, "range_id int, start long, end long"), "range_id").count() == 0


def test_rules_of_a_table_stay_off_the_driver(spark):
    rules = [(i, "/a/*" if i % 2 else "*", f"s{i % 50}*", "drop" if i < 100 else "both") for i in range(5000)]
    table = spark.createDataFrame(rules[::-1], "rule_idx int, group_glob string, stream_glob string, action string")
    streams = spark.createDataFrame([("/a/b", f"s{i}") for i in range(60)] + [("q", "t")], "log_group string, stream string")
    made = routing.rule_rows(table)
    assert made.columns == routing.rule_table(spark, rules[:1]).columns and made.count() == 50
    got = {(r.log_group, r.stream): r.action for r in routing.routed(streams, made, "s3").collect()}
    assert got == {(r.log_group, r.stream): r.action for r in routing.routed(streams, routing.rule_table(spark, rules), "s3").collect()} and got["q", "t"] == "s3"


def test_rules_are_met_by_their_beginnings(spark):
    rules = [(0, "/a/b*", "x?", "both"), (1, "*", "y", "drop"), (2, "/a/{b,c}", "*", "s3"), (3, "/a/b1", "xx", "cloudwatch")]
    table, streams = routing.rule_table(spark, rules), spark.createDataFrame([("/a/b1", "xx"), ("/a/b", "y"), ("/a/c", "z"), ("/a/b1", "xxx"), ("", "y"), ("q", "")], "log_group string, stream string")
    got = {(r.log_group, r.stream): r.action for r in routing.routed(streams, table, "s3d").collect()}
    assert got == {("/a/b1", "xx"): "both", ("/a/b", "y"): "drop", ("/a/c", "z"): "s3", ("/a/b1", "xxx"): "s3d", ("", "y"): "drop", ("q", ""): "s3d"}
    assert "NestedLoop" not in plan_of(routing.routed(streams, table, "s3"))
    assert {r.action for r in routing.routed(streams, routing.rule_table(spark, []), "s3").collect()} == {"s3"}
    assert {r.log_group: r.reaches for r in routing.reaches_service(streams, table, "s3").collect()} == {"/a/b1": True, "/a/b": True, "/a/c": False, "": False, "q": False}


def test_numbers_in_order_without_one_task(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("log_group"), F.lit("x").alias("n"))
    got = plan.numbered(rows.repartition(7), ["log_group"])
    assert [r.place for r in got.orderBy("log_group").collect()] == list(range(5000)) and got.columns == ["log_group", "n", "place"]
    assert "SinglePartition" not in plan_of(plan.metric_batches(rows.select("log_group")))
    ids = spark.createDataFrame([("m0",), ("m12",), ("m01",), ("m",), ("12",), ("m99999999999999999999",), (None,)], "q string")
    assert [r[0] for r in ids.select(plan.place_of(F.col("q"))).collect()] == [0, 12, None, None, None, None, None]


def test_manifests_of_lines_and_of_files(spark, tmp_path):
    one = '{"version": 1, "account": "1", "log_group": "/g", "window_start_ms": 0, "window_end_ms": 10, "objects": [], "record_count": 0}'
    (tmp_path / "lines").mkdir()
    (tmp_path / "files").mkdir()
    (tmp_path / "lines" / "a.json").write_text(one + "\n" + one.replace("10", "20") + "\n")
    (tmp_path / "files" / "a.json").write_text(one.replace(", ", ",\n  ") + "\n")
    from logtide.sources import manifests as source  # noqa: F811

    assert source.read(spark, f"file://{tmp_path}/lines").where("valid").count() == 2
    assert source.read_files(spark, f"file://{tmp_path}/files").where("valid").count() == 1
    assert source.read(spark, f"file://{tmp_path}/files").where("valid").count() == 0


def test_dry_run_and_too_many_failures(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("1", "/g", "s", i * 3_600_000, "m", None, None) for i in range(4)], "account string, log_group string, stream string, timestamp long, message string, ingestion_time long, event_id string")
    grid = windows.with_grid(rows.select("account", "log_group").distinct(), F.lit(0).cast("long"), F.lit(6 * 3_600_000).cast("long"), 3_600_000, True)
    from logtide.sources import manifests as source  # noqa: F811

    args = (grid, source.none(spark), f"file://{tmp_path}", 3_600_000, 100, F.octet_length("message"), ["timestamp"], 1)
    planned = drain.run(rows, *args, dry_run=True)
    assert sorted((r.window_start_ms, r.records) for r in planned.collect()) == [(i * 3_600_000, int(i < 4)) for i in range(6)] and not list(tmp_path.iterdir())
    monkeypatch.setattr(drain, "MOST_FAILURES", 1)
    spoilt = rows.withColumn("message", F.raise_error(F.lit("unread")).cast("string"))
    with pytest.raises(Exception, match="unread"):
        drain.isolated(spoilt, *args)


def test_unreadable_windows_cost_passes_and_not_runs(spark, tmp_path, monkeypatch):
    """Two of 40 windows cannot be read: all others are archived by one run after the one that failed; a window that only a run fails on stands alone too."""
    from logtide.sources import manifests as source  # noqa: F811

    hour, schema = 3_600_000, "account string, log_group string, stream string, timestamp long, message string, ingestion_time long, event_id string"
    rows = spark.createDataFrame([("1", "/g", "s", i * hour, "m", None, None) for i in range(40)], schema)
    grid = windows.with_grid(rows.select("account", "log_group").distinct(), F.lit(0).cast("long"), F.lit(41 * hour).cast("long"), hour, True)
    spoilt = rows.withColumn("message", F.when(F.expr(f"timestamp div {hour} in (7, 30)"), F.raise_error(F.lit("unread")).cast("string")).otherwise(F.col("message")))
    real, seen, fails = drain.run, [], lambda part: False

    def counted(records, part, *args):
        seen.append(part.count())
        if fails(part):
            raise RuntimeError("store")
        return real(records, part, *args)

    monkeypatch.setattr(drain, "run", counted)
    args = (grid, source.none(spark), f"file://{tmp_path}/a", hour, 100, F.octet_length("message"), ["timestamp"], 1)
    bad = lambda df: sorted(r.window_start_ms // hour for r in df.where("error is not null").collect())
    assert bad(drain.isolated(spoilt, *args)) == [7, 30] and seen == [41, 39]
    assert source.read(spark, f"file://{tmp_path}/a/manifest").where("valid").count() == 39
    fails = lambda part: part.where(f"window_start_ms = {3 * hour}").count() > 0
    small = (grid.where(f"window_start_ms < {5 * hour}"), source.none(spark), f"file://{tmp_path}/b", *args[3:])
    assert bad(drain.isolated(rows, *small)) == [3]
    assert source.read(spark, f"file://{tmp_path}/b/manifest").where("valid").count() == 4


@pytest.mark.parametrize(("pattern", "text", "hit"), [(r"(?m)^$", "a\n", True), (r"(?m)^$", "a", False), (r"^$", "a\n", False), (r"(?m)^b", "a\nb", True), (r"^b", "a\nb", False), (r"a{,2}b$", "aab", True), (r"^a{,2}b$", "aaab", False)])
def test_line_starts(spark, pattern, text, hit):
    assert bool(spark.createDataFrame([(text,)], "t string").where(F.col("t").rlike(patterns.search_regex(pattern))).count()) == hit


@pytest.mark.parametrize("chunk", [7, 64, 1000])
def test_a_hot_key_is_folded_by_many_tasks(spark, chunk):
    """Numbers are those of one pass, whatever chunks a key is dealt to."""
    dice = random.Random(chunk)
    rows = [("hot" if i % 10 else f"k{i % 70}", i // 3, i, dice.choice([0, 1, 5, 30, 30, 99, 100, 101, 250])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, timestamp long, i long, cost long").repartition(5)
    key = lambda r: (r.g, r.timestamp, r.i)
    one = {key(r): r.seq for r in folds.rotate(df, ["g"], ["timestamp", "i"], "cost", 100).collect()}
    got = folds.rotate(df, ["g"], ["timestamp", "i"], "cost", 100, chunk=chunk)
    assert {key(r): r.seq for r in got.collect()} == one and got.columns == [*df.columns, "seq"]
    limits = {"max_events": 6, "max_bytes": 300, "max_span": 3}
    one = {key(r): r.batch for r in folds.batches(df, ["g"], ["timestamp", "i"], "cost", **limits).collect()}
    got = {key(r): r.batch for r in folds.batches(df, ["g"], ["timestamp", "i"], "cost", **limits, chunk=chunk).collect()}
    assert got == one


def test_one_group_spreads_over_tasks(spark):
    df = spark.range(4000).selectExpr("'g' g", "id timestamp", "10L cost")
    got = folds.spread(df.repartition(8), ["g"], ["timestamp"], folds.Rotation(95, ("cost",)), "seq", 100)
    plan = plan_of(got)
    assert "hashpartitioning(_chunk" in plan and "hashpartitioning(g#" not in plan and "SinglePartition" not in plan
    assert {r.timestamp: r.seq for r in got.collect()} == {i: i // 10 for i in range(4000)}


LOGGED = "account string, log_group string, timestamp long, stream string, message string, ingestion_time long, event_id string"
SEEN_ORDER = ["timestamp", "stream", "ingestion_time", "event_id", "message"]


def counted(spark, column):
    """A column as it is, and how many of its values were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def one(value):
        seen.add(1)
        return value

    return F.udf(one, "string")(column), seen


def test_late_events_are_worked_out_once(spark, tmp_path):
    """Counts, objects and manifests of a reconciliation come from one comparison of source and archive."""
    path, size, n = f"file://{tmp_path}", F.octet_length("message"), 40
    source = spark.createDataFrame([("1", "/g", i * 10_000_000, "s", f"m{i}", None, f"e{i}") for i in range(n)], LOGGED)
    grid = windows.with_window(source, DAY).select("account", "log_group", *drain.WINDOW).distinct()
    drain.run(source.where("timestamp % 3 = 0"), grid, sources.none(spark), path, DAY, 5, size, SEEN_ORDER, 1)
    known = sources.latest(sources.read(spark, f"{path}/manifest"))
    message, seen = counted(spark, F.col("message"))
    out = reconcile.run(source.withColumn("message", message), known, path, DAY, 5, size, SEEN_ORDER, 2)
    assert out.agg(F.sum("source_events"), F.sum("appended")).first() == (n, n - source.where("timestamp % 3 = 0").count())
    assert seen.value == n
    after = sources.latest(sources.read(spark, f"{path}/manifest"))
    assert archive.read_named(spark, f"{path}/data", after).select("event_id").distinct().count() == after.agg(F.sum("record_count")).first()[0] == n


def test_identities_are_not_broadcast(spark):
    """An archive has as many identities as events, however small it is on disk."""
    fields = ["'1' AS account", "'/g' AS log_group", "id AS timestamp", "'s' AS stream", "'m' || id AS message", "CASE WHEN id % 3 > 0 THEN 'e' || id END AS event_id"]
    source = spark.range(9).selectExpr(*fields)
    there = source.where("timestamp < 6").withColumn("event_id", F.when(F.col("timestamp") % 2 == 0, F.col("event_id")))
    for rows, want in ((reconcile.missing(source, there), [6, 7, 8]), (reconcile.archived(source, there), [0, 1, 2, 3, 4, 5])):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.timestamp for r in rows.collect()) == want


def test_objects_are_opened_once_for_late_events(spark, tmp_path, monkeypatch):
    path, size = f"file://{tmp_path}", F.octet_length("message")
    source = spark.createDataFrame([("1", "/g", i * 1_000_000, "s", f"m{i}", None, f"e{i}" if i % 3 else None) for i in range(40)], LOGGED)
    kept = source.where("timestamp % 7 <> 0")
    grid = windows.with_window(source, DAY).select("account", "log_group", *drain.WINDOW).distinct()
    drain.run(kept, grid, sources.none(spark), path, DAY, 5, size, SEEN_ORDER, 1)
    opened, real = [], archive.read_named

    def read_named(*args):
        rows = real(*args)
        stream, seen = counted(spark, F.col("stream"))
        opened.append(seen)
        return rows.withColumn("event_id", F.when(stream.isNotNull(), F.col("event_id")))

    monkeypatch.setattr(archive, "read_named", read_named)
    out = reconcile.run(source, sources.latest(sources.read(spark, f"{path}/manifest")), path, DAY, 5, size, SEEN_ORDER, 2)
    assert out.agg(F.sum("appended")).first()[0] == 40 - kept.count()
    assert [seen.value for seen in opened] == [kept.count()]


def test_folders_are_listed_once_for_manifests(spark, tmp_path, monkeypatch):
    """Bytes of objects, some of several members, come with their records; a listing of the folders tells the same."""
    path, size, calls, real = f"file://{tmp_path}", F.octet_length("message"), [], archive._packs
    rows = spark.createDataFrame([("1", "/g", i * 10_000_000, "s", f"m{i:02}", None, f"e{i}") for i in range(40)], LOGGED)
    grid = windows.with_window(rows, DAY).select("account", "log_group", *drain.WINDOW).distinct()
    monkeypatch.setattr(archive, "_packs", lambda *args: calls.append(args) or real(*args))
    batch, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(batch, "2")
    try:
        made = drain.run(rows, grid, sources.none(spark), path, DAY, 15, size, SEEN_ORDER, 1)
    finally:
        spark.conf.set(batch, before)
    assert len(calls) == 1
    told = {(r.dt, r.object, r.run): (r.told_records, r.told_bytes) for r in archive.named(made).collect()}
    packs = real(spark, f"{path}/data", None)
    assert packs.count() > len(told) == archive.listing(spark, f"{path}/data").count()
    assert sum(n for n, _ in told.values()) == 40
    assert {k: b for k, (_, b) in told.items()} == {(r.dt, r.object, r.run): r.bytes for r in archive.listing(spark, f"{path}/data").collect()}


def test_pending_windows_are_worked_out_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "/g", i * 10_000_000, "s", f"m{i}", None, f"e{i}") for i in range(40)], LOGGED)
    days = [("1", "/g", i * DAY, (i + 1) * DAY) for i in range(6)]
    group, seen = counted(spark, F.col("log_group"))
    grid = spark.createDataFrame(days, "account string, log_group string, window_start_ms long, window_end_ms long").withColumn("log_group", group)
    made = drain.run(rows, grid, sources.none(spark), f"file://{tmp_path}", DAY, 5, F.octet_length("message"), SEEN_ORDER, 1)
    assert made.count() == len(days) and seen.value == len(days)


def test_objects_of_a_folder_stay_together(spark, tmp_path, monkeypatch):
    """Windows of a day are cut and packed by one task, without ordering them by range; a hot day is dealt out, with the same objects."""
    rows = spark.createDataFrame([("1", f"/g{i % 3}", i * 1_000_000, "s", f"m{i}", None, f"e{i}") for i in range(400)], LOGGED)
    own = windows.with_window(rows, H)
    name = lambda: F.format_string("%d-%06d", "window_start_ms", "seq")
    drain.write_windows(own, f"file://{tmp_path}/a", name(), SEEN_ORDER, F.octet_length("message"), 7, "r")
    monkeypatch.setattr(drain, "hot", lambda *_: True)
    drain.write_windows(own, f"file://{tmp_path}/b", name(), SEEN_ORDER, F.octet_length("message"), 7, "r")
    contents = [{tuple(r) for r in archive.decoded(archive.read_objects(spark, f"file://{tmp_path}/{x}/data"), F.octet_length("message")).collect()} for x in "ab"]
    assert contents[0] == contents[1] and sum(r[5] for r in contents[0]) == 400
    folders = {f.parent for f in (tmp_path / "a").rglob("*.parquet")}
    assert len(folders) == len(list((tmp_path / "a").rglob("*.parquet"))) == 15
