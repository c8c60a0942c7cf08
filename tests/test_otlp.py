"""Nested telemetry in JSON: large payloads, bounds of nested values, points of every kind."""

import json

from pyspark.sql import functions as F

from beamlog.sources.otlp import MAX_ELEMENTS, MAX_NESTING, logs, metrics


def _logs(records, resource=()):
    return json.dumps({"resourceLogs": [{"resource": {"attributes": list(resource)}, "scopeLogs": [{"scope": {"name": "lib"}, "logRecords": records}]}]})


def test_one_payload_of_many_records(spark):
    records = [{"timeUnixNano": str(10**18 + i * 1000), "body": {"stringValue": "b" * 50}, "attributes": [{"key": "k", "value": {"intValue": str(i)}}]} for i in range(20_000)]
    got = logs(spark.createDataFrame([(_logs(records, [{"key": "service.name", "value": {"stringValue": "shop"}}]),)], "payload string"))
    row = got.agg(F.count(F.lit(1)), F.countDistinct("timestamp"), F.sum(F.expr("attributes['k']").cast("long")), F.min(F.expr("attributes['service.name']"))).first()
    assert tuple(row) == (20_000, 20_000, sum(range(20_000)), "shop")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    exploded = [line for line in plan.split("\n") if "Generate explode(" in line]
    assert len(exploded) == 3 and all(", [" in line for line in exploded)  # no list outlives its own explode


def test_bounds_of_nested_values(spark):
    def nested(levels):
        value = {"stringValue": "a ] \\\" [ b"}
        for _ in range(levels):
            value = {"arrayValue": {"values": [value, {"arrayValue": {"values": []}}] if levels < MAX_NESTING else [value]}}
        return value

    wide = lambda n: {"arrayValue": {"values": [{"intValue": "1"}] * n}}
    values = [nested(2), nested(MAX_NESTING), nested(MAX_NESTING + 1), wide(MAX_ELEMENTS), wide(MAX_ELEMENTS + 1), {"stringValue": "plain"}]
    payload = _logs([{"timeUnixNano": "1000", "eventName": str(i), "attributes": [{"key": "v", "value": v}]} for i, v in enumerate(values)])
    assert sorted(r["name"] for r in logs(spark.createDataFrame([(payload,)], "payload string")).select("name").collect()) == ["0", "1", "3", "5"]


def test_points_of_every_kind(spark):
    at = {"timeUnixNano": "1000000"}
    made = [
        {"name": "g", "unit": "ms", "gauge": {"dataPoints": [{**at, "asDouble": 1.5}, {**at, "asInt": "7"}, {**at, "flags": 1}]}},
        {"name": "s", "sum": {"dataPoints": [{**at, "asInt": "3"}], "aggregationTemporality": 1, "isMonotonic": True}},
        {"name": "h", "histogram": {"dataPoints": [{**at, "count": "3", "sum": 4.5, "bucketCounts": ["1", "2"], "explicitBounds": [1.0]}, {**at, "count": "2", "bucketCounts": ["2"], "explicitBounds": [2.0]}], "aggregationTemporality": 2}},
        {"name": "e", "exponentialHistogram": {"dataPoints": [{**at, "count": "9", "scale": 3, "zeroCount": "1", "positive": {"offset": 1, "bucketCounts": ["4"]}}], "aggregationTemporality": 2}},
        {"name": "q", "summary": {"dataPoints": [{**at, "count": "5", "sum": 2.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}]}]}},
        {"name": "none", "gauge": {"dataPoints": []}},
    ]
    payload = json.dumps({"resourceMetrics": [{"resource": {}, "scopeMetrics": [{"scope": {}, "metrics": made}]}]})
    got = [(r["name"], r["value"], r["attributes"]) for r in metrics(spark.createDataFrame([(payload,), (None,), ("{}",)], "payload string")).collect()]
    assert sorted((n, v) for n, v, _ in got) == [("e", 9.0), ("g", 1.5), ("g", 7.0), ("h", 2.0), ("h", 4.5), ("q", 2.0), ("s", 3.0)]
    by = {(n, v): a for n, v, a in got}
    assert by["g", 7.0] == {"metric.unit": "ms", "metric.kind": "gauge", "metric.int64": "7"}
    assert by["s", 3.0]["metric.temporality"] == "delta" and by["h", 4.5]["metric.bucket_counts"] == "[1,2]" and "metric.bucket_counts" not in by["h", 2.0]
    assert json.loads(by["e", 9.0]["metric.positive"]) == {"offset": 1, "bucketCounts": ["4"]} and "metric.quantiles" in by["q", 2.0]
