import json

from logtide.operators import routing
from logtide.streaming import gateway

RULES = '[[rule]]\nlog_group = "both*"\naction = "both"\n[[rule]]\nlog_group = "drop*"\naction = "drop"\n'


def test_restart_adds_nothing(spark, tmp_path):
    rules, default = routing.parse_rules(RULES)
    (tmp_path / "in").mkdir()

    def post(name, group, times):
        body = {"logGroupName": group, "logStreamName": "s", "logEvents": [{"timestamp": t, "message": "m"} for t in times], "ignored": 1}
        (tmp_path / "in" / name).write_text(json.dumps(body))

    def run():
        rows = gateway.records(gateway.requests(spark, str(tmp_path / "in"), 1), "1", rules, default)
        gateway.ingest(rows, str(tmp_path / "a"), str(tmp_path / "f"), str(tmp_path / "c")).awaitTermination()
        count = lambda p: spark.read.parquet(str(tmp_path / p)).count()
        return count("a"), count("f")

    post("1.json", "plain", [0, 86_400_000])
    post("2.json", "both-x", [1, 2, 3])
    post("3.json", "drop-x", [1])
    assert run() == (5, 3)
    assert run() == (5, 3)
    post("4.json", "plain", [5])
    assert run() == (6, 3)
    days = {(r.log_group, str(r.dt)) for r in spark.read.parquet(str(tmp_path / "a")).select("log_group", "dt").distinct().collect()}
    assert days == {("plain", "1970-01-01"), ("plain", "1970-01-02"), ("both-x", "1970-01-01")}


def test_late_filter_keeps_first(spark, tmp_path):
    rules, default = routing.parse_rules("")
    (tmp_path / "in").mkdir()
    body = {"logGroupName": "g", "logStreamName": "s", "logEvents": [{"timestamp": 5, "message": "m"}] * 3}
    (tmp_path / "in" / "1.json").write_text(json.dumps(body))
    rows = gateway.late_filter(gateway.records(gateway.requests(spark, str(tmp_path / "in")), "1", rules, default))
    rows.writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("late").count() == 1
