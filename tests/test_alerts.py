import time
from datetime import timedelta

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamlog.operators import alerts
from beamlog.operators.lifecycle import proposals, segment_statistics
from beamlog.operators.query import Result, answer_within, collect_within, run
from beamlog.operators.views import SavedQuery
from beamlog.plans.fields import Descriptor, Registry
from beamlog.plans.language import parse
from beamlog.plans.planner import Budget, BudgetError, plan
from beamlog.sources.otlp import logs as otlp_logs
from beamlog.streaming.projector import stream_incidents

from .test_engine import NOW, ORG, logs, request

RULE = "organization_id string, rule_id string, query_id string, minimum long, consecutive long, interval_seconds long, enabled boolean, next_at timestamp"
NONE = "organization_id string, rule_id string, number long, state string, count long, silenced_until timestamp, updated_at timestamp"


def utc(t):
    return t.isoformat() + "Z"


def rules(spark, rows):
    return spark.createDataFrame([(*r[:-1], utc(r[-1])) for r in rows], RULE.replace("next_at timestamp", "next_at string")).withColumn("next_at", F.col("next_at").cast("timestamp"))


def test_due_claim_error_and_silence(spark):
    data = logs(spark, [(m, "a", request("/x", 500)) for m in (1, 2, 3)])
    table = rules(spark, [("o", "many", "q", 2, 2, 60, True, NOW), ("o", "few", "q", 9, 1, 60, True, NOW - timedelta(minutes=1)), ("o", "gone", "none", 1, 1, 60, True, NOW),
                          ("o", "bad", "t", 1, 1, 60, True, NOW), ("o", "off", "q", 1, 1, 60, False, NOW), ("o", "later", "q", 1, 1, 60, True, NOW + timedelta(seconds=1))])
    saved = {("o", "q"): (SavedQuery.of("q", "logs | where status >= 500 | window 1h"), ORG), ("o", "t"): (SavedQuery.of("t", "logs | where status >= nope"), ORG)}
    due = alerts.due_rules(table, NOW).cache()
    assert [r["rule_id"] for r in due.collect()] == ["few", "bad", "gone", "many"] and alerts.due_rules(table, NOW, 1).count() == 1
    after = alerts.claimed(table, due, NOW)
    assert alerts.due_rules(after, NOW).count() == 0 and alerts.due_rules(after, NOW + timedelta(seconds=60)).count() == 5
    got = alerts.evaluated(due, saved, data, NOW).cache()
    assert {r["rule_id"]: (r["rows"], r["error"]) for r in got.collect()} == {"many": (3, None), "few": (3, None), "gone": (None, "query_unavailable"), "bad": (None, "query_unavailable")}

    none = spark.createDataFrame([], NONE)
    one = alerts.advanced(none, got)
    assert [(r["rule_id"], r["number"], r["state"], r["count"], r["event"]) for r in one.collect()] == [("many", 1, "pending", 1, "opened")]
    at = lambda minutes: got.withColumn("at", F.lit(utc(NOW + timedelta(minutes=minutes))).cast("timestamp"))
    two = alerts.advanced(one, at(1))
    assert [(r["state"], r["count"], r["event"]) for r in two.collect()] == [("firing", 2, "promoted")]
    act = lambda kind, minutes, until=None: spark.createDataFrame([("o", "many", kind, utc(NOW + timedelta(minutes=minutes)), until and utc(NOW + timedelta(minutes=until)))], "organization_id string, rule_id string, action string, at string, until string").withColumns({c: F.col(c).cast("timestamp") for c in ("at", "until")})
    quiet = alerts.acted(two, act("silence", 2, 5))
    assert [(r["state"], r["event"], r["problem"]) for r in quiet.collect()] == [("silenced", "silenced", None)]
    assert [r["problem"] for r in alerts.acted(two, act("silence", 2, 60 * 24 * 31)).collect()] == ["silence"]
    assert [r["event"] for r in alerts.advanced(quiet, at(3)).collect()] == [None] and [r["event"] for r in alerts.advanced(quiet, at(5)).collect()] == ["unsilenced"]
    calm = at(6).withColumn("rows", F.lit(0).cast("long"))
    over = alerts.advanced(quiet, calm)
    assert [(r["state"], r["event"], r["silenced_until"]) for r in over.collect()] == [("resolved", "resolved", None)]
    assert [r["problem"] for r in alerts.acted(over, act("acknowledge", 7)).collect()] == ["resolved"]
    assert [(r["number"], r["event"]) for r in alerts.advanced(over, at(8)).collect()] == [(2, "opened")]


def test_streaming_actions_and_silence(spark, tmp_path):
    schema = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("rows", T.LongType()), T.StructField("action", T.StringType()), T.StructField("until", T.TimestampType())])
    m = lambda k: NOW + timedelta(minutes=k)
    parts = [[("r", m(0), 3, None, None), ("r", m(1), None, "silence", m(4)), ("r", m(2), 3, None, None)], [("r", m(3), 3, None, None), ("r", m(4), 3, None, None), ("r", m(5), 0, None, None), ("r", m(6), None, "acknowledge", None)]]
    for part in parts:  # the silence's end lives in the state from one run to the next
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream_incidents(spark.readStream.schema(schema).json(str(tmp_path / "in")), 2, 1).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = [(r["event"], r["state"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == [("opened", "firing"), ("silenced", "silenced"), ("unsilenced", "firing"), ("resolved", "resolved"), ("refused", "resolved")]


def test_transition_evidence_without_listing_the_range(spark):
    told = spark.createDataFrame([("r", "s", "x", 1, 1, 3), ("r", "s", "x", 2, 4, 6), ("r", "s", "x", 4, 1, 2), ("q", "s", "x", 1, 1, 10**12), ("q", "s", "x", 2, 3, 1)], "rule_id string, source_id string, stream_id string, sequence long, from_sequence long, to_sequence long")
    have = spark.createDataFrame([("s", "x", n) for n in (1, 2, 3, 4, 6)], "source_id string, stream_id string, sequence long")
    got = {(r["rule_id"], r["sequence"]): r["problem"] for r in alerts.transition_problems(told, have).collect()}
    assert got == {("r", 1): None, ("r", 2): "evidence", ("r", 4): "gap", ("q", 1): "evidence", ("q", 2): "evidence"}


def test_budgets_act(spark):
    data = logs(spark, [(m, "a", request("/x", 500)) for m in range(1, 6)])
    result = run(data, parse("logs | window 1h | limit 3"), ORG, NOW)
    rows, cut = collect_within(result)
    assert len(rows) == 3 and cut
    narrow = lambda df, **b: Result(df, df, result.columns, result.order, plan(parse("logs | window 1h | limit 3"), ORG, budget=Budget(**b)))
    with pytest.raises(BudgetError, match="bytes"):
        collect_within(narrow(result.full, memory_bytes=10))
    wait = F.udf(lambda s: time.sleep(5) or s)
    slow = result.full.withColumn("name", wait("name"))
    begin = time.time()
    with pytest.raises(BudgetError, match="longer"):
        collect_within(narrow(slow, seconds=1))
    assert time.time() - begin < 20


def test_bytes_are_watched_while_a_query_runs(spark, tmp_path):
    """A scan of many files is stopped once its tasks have read what the budget allows; a run tells what it read, without a scan of its own."""
    data = logs(spark, [(m / 10, "a", request(f"/{m % 7}", 500 + m % 3)) for m in range(1, 401)])
    for k in range(24):
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    query = parse("logs | where status == 501 | window 1h | sort duration desc | limit 5")
    seen = Observation("seen")
    got = answer_within(run(stored, query, ORG, NOW, seen=seen))
    assert len(got.rows) == 5 and got.truncated and got.matched_rows == 24 * 134 and got.scanned_rows == 24 * 400 and got.scanned_bytes > 0
    none = answer_within(run(stored.limit(0), query, ORG, NOW, seen=Observation("none")))
    assert none.rows == [] and not none.truncated and none.matched_rows == 0
    wait = F.udf(lambda s: time.sleep(0.01) or s)  # 4 s a file, one file a task
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        whole = parse("logs | limit 5")
        few = plan(whole, ORG, budget=Budget(seconds=300, scanned_bytes=got.scanned_bytes // 12))
        begin = time.time()
        with pytest.raises(BudgetError, match="scanned bytes"):
            answer_within(run(stored.withColumn("name", wait("name")), whole, ORG, NOW, planned=few))
        assert time.time() - begin < 16  # 24 files over 4 cores take 24 s
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    small = plan(query, ORG, budget=Budget(scanned_bytes=10))
    with pytest.raises(BudgetError, match="scanned bytes"):
        answer_within(run(stored, query, ORG, NOW, planned=small))


def test_rejected_fields_and_one_proposal_a_segment(spark):
    data = logs(spark, [(1, "a", {"x": "1", "y": "a"}), (2, "a", {"x": "2.5"})])
    none = data.limit(0)
    told = segment_statistics(data, none).cache()
    assert segment_statistics(data, told).count() == 0
    names = lambda reg=None: {(r["field"], r["rows"], r["inferred"]) for r in proposals(told.unionByName(told), reg).collect()}
    assert names() == {("x", 2, "float"), ("y", 1, "string")}
    turned = Registry().reject("logs", ["y"])
    assert names(turned) == {("x", 2, "float")} and turned.activate("logs", [Descriptor("y", "string", "internal", "low")]).rejected == frozenset()
    with pytest.raises(ValueError):
        Registry().reject("logs", ["body"])


def test_otlp_severity_names_and_bounds(spark):
    import json
    record = lambda n, body: {"timeUnixNano": "1700000000000000000", "severityNumber": n, "body": body}
    nest = lambda k: {"stringValue": "x[[["} if k == 0 else {"arrayValue": {"values": [nest(k - 1)]}}
    bodies = [record(9, {"stringValue": "a"}), record(11, {"stringValue": "b"}), record(30, {"stringValue": "c"}), record(1, nest(8)), record(1, nest(9)), record(1, {"arrayValue": {"values": [{"stringValue": "x"}] * 65}})]
    payload = json.dumps({"resourceLogs": [{"resource": {}, "scopeLogs": [{"scope": {}, "logRecords": bodies}]}]})
    got = [r["severity"] for r in otlp_logs(spark.createDataFrame([(payload,)], "payload string")).collect()]
    assert sorted(got) == sorted(["SEVERITY_NUMBER_INFO", "SEVERITY_NUMBER_INFO3", "30", "SEVERITY_NUMBER_TRACE"])


def test_one_rule_that_fails_or_hangs_leaves_the_others_alone(spark):
    data = logs(spark, [(m, "a", request("/x", 500)) for m in (1, 2, 3)])
    broken = data.withColumn("name", F.when(F.col("name") == "request", F.raise_error(F.lit("unreadable"))).otherwise(F.col("name")))
    table = rules(spark, [("o", r, q, 1, 1, 60, True, NOW) for r, q in (("good", "q"), ("failing", "f"), ("gone", "none"))])
    saved = {("o", "q"): (SavedQuery.of("q", "logs | where status >= 500 | summarize count() by status"), ORG), ("o", "f"): (SavedQuery.of("f", 'logs | where name == "request"'), ORG)}
    got = {r["rule_id"]: (r["rows"], r["error"]) for r in alerts.evaluated(table, saved, broken, NOW).collect()}
    assert got == {"good": (1, None), "failing": (None, "query_failed"), "gone": (None, "query_unavailable")}
    wait = F.udf(lambda name: (time.sleep(20), name)[1])
    slow = data.withColumn("name", wait("name"))
    got = {r["rule_id"]: (r["rows"], r["error"]) for r in alerts.evaluated(table, saved, slow, NOW, seconds=4).collect()}
    assert got == {"good": (1, None), "failing": (None, "query_timeout"), "gone": (None, "query_unavailable")}


def test_rules_are_claimed_by_one_run_only(spark, tmp_path):
    folder = str(tmp_path / "rules")
    alerts.store_rules(rules(spark, [("o", "a", "q", 1, 1, 60, True, NOW), ("o", "b", "q", 1, 1, 60, True, NOW + timedelta(minutes=5))]), folder)
    (tmp_path / "rules" / "mark-1").touch()  # another run has just taken version 0 and is about to write version 1
    assert alerts.claim(spark, folder, NOW).count() == 0
    assert [r["rule_id"] for r in alerts.claim(spark, folder, NOW, stale_seconds=-1).collect()] == ["a"]  # that run broke
    assert alerts.claim(spark, folder, NOW).count() == 0 and alerts.claim(spark, folder, NOW + timedelta(seconds=60)).count() == 1
    assert sorted(r["rule_id"] for r in alerts.claim(spark, folder, NOW + timedelta(minutes=6)).collect()) == ["a", "b"]
