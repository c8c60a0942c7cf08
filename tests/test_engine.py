import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from beamlog.model import OBSERVATION
from beamlog.operators import alerts, rollups
from beamlog.operators.alerts import Incident, act, evaluate
from beamlog.operators.query import run, within_budget
from beamlog.operators.views import Dashboard, Panel, SavedQuery, export_bundle, import_bundle
from beamlog.plans.fields import Registry
from beamlog.plans.language import parse
from beamlog.plans.planner import Budget, BudgetError, Scope, plan
from beamlog.sources.ingest import admissible, admit, flatten
from beamlog.streaming.projector import Projection, stream_incidents

NOW = datetime(2026, 8, 17, 12, 7, 30)
ORG, A = Scope("o"), Scope("o", service="a")


def logs(spark, rows):
    """rows: (minutes before NOW, service, attributes)."""
    out = [("o", "p", "e", service, "src", "st", i + 1, 0, "logs", NOW - timedelta(minutes=m), "request", "information", None, None, None, None, None, attributes) for i, (m, service, attributes) in enumerate(rows)]
    return spark.createDataFrame(out, OBSERVATION)


def request(route, status, duration=None):
    return {k: str(v) for k, v in (("http.route", route), ("http.status_code", status), ("duration_ns", duration)) if v is not None}


@pytest.fixture(scope="module")
def sample(spark):
    return logs(spark, [(5, "a", request("/ok", 200, 50)), (4, "a", request("/broken", 503, 300)), (3, "a", request("/slow", 500, 200)), (2, "a", request("/odd", "not-a-number", "invalid")), (1, "b", request("/other", 599, 999))]).cache()


def test_filter_sort_limit(sample):
    got = run(sample, parse("logs | where status >= 500 | window 1h | sort duration desc | limit 1"), A, NOW)
    assert [r["duration_ns"] for r in got.rows.collect()] == [300.0] and got.truncated()
    every = run(sample, parse("logs | sort duration desc | limit 10"), A, NOW)
    assert [r["duration_ns"] for r in every.rows.collect()] == [300.0, 200.0, 50.0, None] and not every.truncated()


def test_missing_fields_never_match_and_empty_attributes_are_present(spark):
    rows = logs(spark, [(1, "a", {}), (2, "a", {"http.route": ""}), (3, "a", {"http.route": "/x"})])
    count = lambda text: run(rows, parse(text), ORG, NOW).rows.count()
    assert count('logs | where route != "/x"') == 1 and count('logs | where route == ""') == 1 and count('logs | where severity == ""') == 0
    assert run(rows, parse("logs | where route == nope | summarize count()"), ORG, NOW).rows.count() == 0


def test_log_rollup_with_cut_bucket_matches_rows(spark):
    rows = logs(spark, [(1, "a", request("/partial", 503)), (5, "a", request("/partial", 500)), (5.5, "a", request("/partial", 500)), (6.5, "a", request("/gone", 500)), (2, "a", {"http.status_code": "500"}), (2, "a", request("", 502)), (2, "a", request("/ok", 200)), (2, "a", request("/x", "500suffix"))])
    text = "logs | where status >= 500 | window 6m | summarize count() by route, window(5m) | sort count desc | limit 10"
    whole = rollups.log_rollup(rows)
    by_rollup, by_rows = rollups.answer(rows, parse(text), ORG, NOW, logs=whole), run(rows, parse(text), ORG, NOW)
    assert by_rollup.plan.path == "log_rollup"
    assert by_rollup.rows.collect() == by_rows.rows.collect()
    assert {(r["http.route"], r["count"]) for r in by_rollup.rows.collect()} >= {("", 1), (None, 1)}
    assert sorted(rollups.merge_log_rollups(whole).collect(), key=str) == sorted(whole.collect(), key=str)


def test_metric_rollup(spark):
    values = [(-2.0, 9), (0.0, 8), (3.0, 7), (100.0, 6)]
    rows = spark.createDataFrame([("o", "p", "e", "s", "src", "st", i + 1, 0, "metrics", NOW - timedelta(minutes=m), "latency", None, None, v, None, None, None, {"http.route": "/items", "private": "x"}) for i, (v, m) in enumerate(values)], OBSERVATION)
    roll = rollups.metric_rollup(rows)
    assert {tuple(r["attributes"].items()) for r in roll.collect()} == {(("http.route", "/items"),)}
    q = parse('metrics | where route == "/items" | window 1h | summarize count(), sum(value), min(value), max(value), avg(value), p95(value) by name, window(24h)')
    got = rollups.answer(rows, q, ORG, NOW, metrics=roll)
    assert got.plan.path == "metric_rollup" and got.plan.approximate
    r = got.rows.first()
    assert (r["count"], r["sum_value"], r["min_value"], r["max_value"], r["avg_value"]) == (4, 101.0, -2.0, 100.0, 25.25) and abs(r["p95_value"] - 100) < 2
    exact = rollups.answer(rows, parse("metrics | where value >= 2 | window 1h | summarize count()"), ORG, NOW, metrics=roll)
    assert exact.plan.path == "rows" and exact.rows.first()["count"] == 2
    two = rollups.merge_metric_rollups(roll.unionByName(roll)).agg(F.sum("sample_count")).first()[0]
    assert two == 8


def test_cold_rows_join_hot_ones(sample, spark):
    old = logs(spark, [(60 * 24 * 31, "a", request("/old", 200))])
    got = rollups.answer(sample, parse("logs | window 960h | limit 10"), A, NOW, cold=old)
    assert got.rows.count() == 5 and got.plan.sources[1].endswith("/cold:raw")


def test_budget(sample):
    query = parse("logs | window 1h")
    with pytest.raises(BudgetError):
        within_budget(sample, plan(query, ORG, budget=Budget(scanned_bytes=10)), NOW)
    assert within_budget(sample, plan(query, ORG), NOW)["scanned_rows"] == 5


def test_filters_reach_the_files(sample, tmp_path, spark):
    path = str(tmp_path / "o")
    sample.withColumn("date", F.to_date("timestamp")).write.partitionBy("signal", "date").parquet(path)
    got = run(spark.read.parquet(path), parse("logs | where severity == information | window 1h | summarize count()"), ORG, NOW)
    text = got.rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "isnotnull(date" in text and "organization_id" in text.split("PushedFilters")[1] and "body" not in text.split("ReadSchema")[1].split("\n")[0]


def test_incident_state_machine():
    at = NOW
    i, e = evaluate(None, True, at, 2)
    assert (i.state, e) == ("pending", "opened")
    i, e = evaluate(i, True, at, 2)
    assert (i.state, e) == ("firing", "promoted")
    assert evaluate(i, True, at, 2)[0].count == 3
    i, _ = act(i, "acknowledge", at)
    i, e = act(i, "silence", at, at + timedelta(hours=1))
    assert (i.state, e) == ("silenced", "silenced")
    assert evaluate(i, True, at + timedelta(minutes=59), 2)[0].state == "silenced"
    assert evaluate(i, True, at + timedelta(hours=1), 2) == (Incident(1, "firing", 3), "unsilenced")
    assert evaluate(i, False, at, 2)[1] == "resolved" and evaluate(None, False, at, 1) == (None, None) and evaluate(None, True, at, 1)[0].state == "firing"
    with pytest.raises(ValueError):
        act(act(i, "resolve", at)[0], "acknowledge", at)
    with pytest.raises(ValueError):
        act(i, "silence", at, at + timedelta(days=31))


def test_batch_rule_states(sample):
    got = alerts.batch_rule(sample, parse("logs | where status >= 500"), 1)
    assert sorted(r["state"] for r in got.collect()) == ["clear", "clear", "matched", "matched", "matched"]
    assert {r["state"] for r in alerts.batch_rule(sample, parse("logs | where status >= nope"), 1).collect()} == {"error"}


def batch(stream, sequence, times, signal="logs", **record):
    return {"version": 1, "source_id": "src", "stream_id": stream, "sequence": sequence, "observed_at": NOW.isoformat() + "Z", "signal": signal,
            "records": [{"timestamp": t.isoformat() + "Z", "name": "request", "attributes": {"http.status_code": "500", "http.route": "/x"}, **record} for t in times]}


def test_bad_records_reject_their_batch(spark, tmp_path):
    good, bad = batch("a", 1, [NOW, NOW]), batch("a", 2, [NOW, NOW - timedelta(days=401)])
    nameless, empty = batch("b", 1, [NOW], name=""), batch("b", 2, [])
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, (good, bad, nameless, empty, batch("c", 1, [NOW], signal="metrics")))))
    from beamlog.sources.ingest import read_batches
    got = {(r["stream_id"], r["sequence"]): r["problem"] for r in admissible(read_batches(spark, str(tmp_path)), NOW).collect()}
    assert got == {("a", 1): None, ("a", 2): "time", ("b", 1): "name", ("b", 2): "records", ("c", 1): "value"}
    assert flatten(read_batches(spark, str(tmp_path)).where("stream_id = 'a'")).count() == 4


def test_admission(spark):
    marks = spark.createDataFrame([("s", "x", 3, "d3")], "source_id string, stream_id string, sequence long, digest string")
    rows = [("x", 2, "d2"), ("x", 3, "d3"), ("x", 3, "other"), ("x", 4, "d4"), ("x", 4, "d4"), ("x", 6, "d6"), ("y", 1, "d1"), ("y", 2, "d2"), ("z", 2, "d2")]
    df = spark.createDataFrame([("s", s, n, d, i) for i, (s, n, d) in enumerate(rows)], "source_id string, stream_id string, sequence long, digest string, arrived int")
    got = [r["outcome"] for r in admit(df, marks).orderBy("arrived").collect()]
    assert got == ["older_replay", "duplicate", "conflict", "accepted", "duplicate", "gap", "accepted", "accepted", "gap"]


def test_projector_is_idempotent_and_takes_late_data(spark, tmp_path):
    scopes = spark.createDataFrame([("src", "o", "p", "e", "s")], "source_id string, organization_id string, project_id string, environment_id string, service_id string")
    incoming = tmp_path / "in"
    incoming.mkdir()
    p = Projection(spark, str(tmp_path / "out"), scopes, now=NOW)
    drain = lambda: p.start(str(incoming), str(tmp_path / "check")).awaitTermination(120)
    (incoming / "1.json").write_text(json.dumps(batch("a", 1, [NOW, NOW - timedelta(minutes=1)])))
    drain()
    assert p.observations().count() == 2
    # A replay, late data of an old bucket, and a bad batch beside good ones.
    (incoming / "2.json").write_text("\n".join(map(json.dumps, (batch("a", 1, [NOW, NOW - timedelta(minutes=1)]), batch("a", 2, [NOW - timedelta(days=90), NOW]), batch("b", 1, [NOW - timedelta(days=500)])))))
    drain()
    assert p.observations().count() == 4 and p.ledger().count() == 2
    fresh = rollups.log_rollup(p.observations())
    stored = p.rollup("log").drop("date")
    key = lambda df: sorted(map(str, df.select(sorted(fresh.columns)).collect()))
    assert key(stored) == key(fresh) and stored.agg(F.sum("observation_count")).first()[0] == 4


def test_streaming_incidents_agree_with_the_fold(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("rows", T.LongType())])
    pattern = [3, 0, 3, 3, 3, 0, 0, 3, 3]
    rows = [(f"r{k}", NOW + timedelta(minutes=i), n if k == 0 else 3 - n) for k in (0, 1) for i, n in enumerate(pattern)]
    df = spark.createDataFrame(rows, schema)
    for part, low, high in (("1", 0, 4), ("2", 4, 9)):
        cut = [r for r in rows if low <= (r[1] - NOW).seconds // 60 < high]
        spark.createDataFrame(cut, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = stream_incidents(spark.readStream.schema(schema).json(str(tmp_path / "in")), 2, 2)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r["rule_id"], r["number"], r["at"], r["event"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r["rule_id"], r["number"], r["at"], r["event"]) for r in alerts.fold(df, 2, 2).collect())
    assert got == want and want


def test_saved_queries_and_dashboards():
    saved = {"q": SavedQuery.of("q", "logs | summarize count() by window(5m)"), "t": SavedQuery.of("t", "logs | limit 5")}
    good = Dashboard("d", "D", (Panel("q", "timeseries"), Panel("t")))
    good.check(saved)
    with pytest.raises(ValueError):
        Dashboard("d", "D", (Panel("t", "stat"),)).check(saved)
    assert import_bundle(export_bundle([good], saved)) == ([good], saved)
    with pytest.raises(ValueError):
        saved["q"].changed("logs", 7)
    assert saved["q"].changed("logs", 1).revision == 2


def test_registry_versions():
    assert Registry().version == 1 and Registry().activate("logs", []).version == 2
