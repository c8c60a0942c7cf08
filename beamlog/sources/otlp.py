"""Telemetry in the OTLP JSON encoding: nested resources, scopes and records as flat observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import without_denied

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_KEYS = f"array<struct<key:string,value:{_VALUE}>>"
_SCOPE = f"struct<name:string,version:string,attributes:{_KEYS}>"
_RESOURCE = f"struct<attributes:{_KEYS},droppedAttributesCount:int>"
_LOG = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,eventName:string,body:{_VALUE},attributes:{_KEYS},droppedAttributesCount:int,traceId:string,spanId:string>"
_POINT = f"struct<attributes:{_KEYS},startTimeUnixNano:string,timeUnixNano:string,asDouble:double,asInt:string,flags:int>"
_HISTOGRAM = f"struct<attributes:{_KEYS},startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>,flags:int>"
_EXPONENTIAL = f"struct<attributes:{_KEYS},startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,min:double,max:double,scale:int,zeroCount:string,positive:struct<offset:int,bucketCounts:array<string>>,negative:struct<offset:int,bucketCounts:array<string>>,flags:int>"
_SUMMARY = f"struct<attributes:{_KEYS},startTimeUnixNano:string,timeUnixNano:string,count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>,flags:int>"
_METRIC = (f"struct<name:string,unit:string,gauge:struct<dataPoints:array<{_POINT}>>,sum:struct<dataPoints:array<{_POINT}>,aggregationTemporality:int,isMonotonic:boolean>,"
           f"histogram:struct<dataPoints:array<{_HISTOGRAM}>,aggregationTemporality:int>,exponentialHistogram:struct<dataPoints:array<{_EXPONENTIAL}>,aggregationTemporality:int>,summary:struct<dataPoints:array<{_SUMMARY}>>>")
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KEYS},droppedAttributesCount:int,events:array<struct<name:string>>,links:array<struct<traceId:string>>,status:struct<code:int,message:string>>"


def _schema(top: str, inner: str, item: str, record: str) -> str:
    return f"struct<{top}:array<struct<resource:{_RESOURCE},{inner}:array<struct<scope:{_SCOPE},{item}:array<{record}>>>>>>"


LOGS = _schema("resourceLogs", "scopeLogs", "logRecords", _LOG)
METRICS = _schema("resourceMetrics", "scopeMetrics", "metrics", _METRIC)
TRACES = _schema("resourceSpans", "scopeSpans", "spans", _SPAN)
NO_RECORDED_VALUE = 1
# Severity levels, four numbers each (as SEVERITY_NUMBER_INFO, SEVERITY_NUMBER_INFO2 ...), and metric temporalities.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
# Bounds of nested values.
MAX_NESTING, MAX_ELEMENTS = 8, 64
TEMPORALITY = {1: "delta", 2: "cumulative"}


def any_value(v: Column) -> Column:
    """A value of any kind as text; lists and maps stay JSON text, bytes become hex."""
    return F.coalesce(v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), F.lower(F.hex(F.unbase64(v["bytesValue"]))), v["arrayValue"], v["kvlistValue"])


def fits(value: Column) -> Column:
    """Whether a list or map value nests MAX_NESTING levels at most and itself has MAX_ELEMENTS entries at most."""
    outer = F.coalesce(value["arrayValue"], value["kvlistValue"])
    entries = F.coalesce(F.json_array_length(F.get_json_object(outer, "$.values")), F.lit(0))
    # Outside of strings, each level of lists and maps opens one bracket; each pass takes the innermost level away.
    left = F.regexp_replace(F.regexp_replace(outer, r"\\.", ""), r'"[^"]*"|[^\[\]"]', "")
    for _ in range(MAX_NESTING):
        left = F.replace(left, F.lit("[]"), F.lit(""))
    return F.when(outer.isNull(), F.lit(True)).when(entries > MAX_ELEMENTS, F.lit(False)).otherwise(F.coalesce(left == "", F.lit(False)))


def all_fit(pairs: Column) -> Column:
    return F.forall(F.coalesce(pairs, F.array().cast(_KEYS)), lambda p: fits(p["value"]))


def keys_map(pairs: Column, prefix: str = "") -> Column:
    """Key-value pairs as a map; of equal keys the last one stays, empty keys are left out."""
    pairs = F.coalesce(pairs, F.array().cast(_KEYS))
    last = F.filter(pairs, lambda p, i: (p["key"] != "") & ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(F.concat(F.lit(prefix), p["key"]), F.coalesce(any_value(p["value"]), F.lit("")))))


def over(low: Column, high: Column) -> Column:
    """Two maps as one; the second one's values win."""
    return F.map_concat(F.map_filter(low, lambda k, _: ~F.map_contains_key(high, k)), high)


def present(values: dict[str, Column]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def _inherited(resource: Column, scope: Column) -> Column:
    """What every record of a scope has from its resource and scope."""
    named = present({"otel.scope.name": F.nullif(scope["name"], F.lit("")), "otel.scope.version": F.nullif(scope["version"], F.lit(""))})
    return over(keys_map(resource["attributes"]), over(named, keys_map(scope["attributes"], "otel.scope.attribute.")))


def _flat(payloads: DataFrame, schema: str, top: str, inner: str, item: str) -> DataFrame:
    """One row a record ``r`` with the map ``inherited``; records of a resource or scope whose values do not fit are left out.

    Before a list is exploded, all else that is needed stands in columns of its own: a list that is a part of a
    column still in use would be copied into each of its records.
    """
    groups = payloads.select(F.explode(F.from_json("payload", schema)[top]).alias("g"))
    scopes = groups.select(F.col("g.resource").alias("resource"), F.col(f"g.{inner}").alias("list")).where(all_fit(F.col("resource.attributes"))).select("resource", F.explode("list").alias("s"))
    lists = scopes.where(all_fit(F.col("s.scope.attributes"))).select(_inherited(F.col("resource"), F.col("s.scope")).alias("inherited"), F.col(f"s.{item}").alias("list"))
    rows = lists.select("inherited", F.explode("list").alias("r"))
    own = [x for x in ("attributes", "body") if x in rows.schema["r"].dataType.names]
    return rows.where(reduce(lambda a, b: a & b, [all_fit(F.col("r.attributes")) if x == "attributes" else fits(F.col("r.body")) for x in own], F.lit(True)))


def nanos(text: Column) -> Column:
    return F.timestamp_micros(F.floor(F.nullif(text.try_cast("decimal(20,0)"), F.lit(0)) / 1000).cast("bigint"))


def _ids(rows: Column | str, trace: str, span: str) -> list[Column]:
    return [F.nullif(F.lower(F.col(trace)), F.lit("")).alias("trace_id"), F.nullif(F.lower(F.col(span)), F.lit("")).alias("span_id")]


def logs(payloads: DataFrame) -> DataFrame:
    """Log records of JSON payloads (column payload)."""
    rows = _flat(payloads, LOGS, "resourceLogs", "scopeLogs", "logRecords")
    number = F.col("r.severityNumber")
    names = [f"SEVERITY_NUMBER_{s}{k if k > 1 else ''}" for s in SEVERITIES for k in range(1, 5)]
    named = F.when(number.between(1, len(names)), F.get(F.array(*[F.lit(n) for n in names]), number - 1)).when(number != 0, number.cast("string"))
    attributes = over(over(F.col("inherited"), keys_map(F.col("r.attributes"))), present({"otel.dropped_attributes": F.nullif("r.droppedAttributesCount", F.lit(0))}))
    return rows.select(
        F.coalesce(nanos(F.col("r.timeUnixNano")), nanos(F.col("r.observedTimeUnixNano"))).alias("timestamp"), F.coalesce(F.nullif("r.eventName", F.lit("")), F.lit("otlp.log")).alias("name"),
        F.coalesce(F.nullif("r.severityText", F.lit("")), named).alias("severity"), any_value(F.col("r.body")).alias("body"), F.lit(None).cast("double").alias("value"),
        *_ids(rows, "r.traceId", "r.spanId"), F.nullif(F.lower("r.traceId"), F.lit("")).alias("correlation_id"), without_denied(attributes).alias("attributes"))


def traces(payloads: DataFrame) -> DataFrame:
    """Spans; the value is the duration in nanoseconds. A span that ends before it starts is left out."""
    rows = _flat(payloads, TRACES, "resourceSpans", "scopeSpans", "spans")
    took = F.col("r.endTimeUnixNano").try_cast("decimal(20,0)") - F.col("r.startTimeUnixNano").try_cast("decimal(20,0)")
    own = present({"span.duration_ns": took.cast("bigint"), "span.kind": F.col("r.kind"), "span.status": F.coalesce("r.status.code", F.lit(0)), "span.parent_id": F.nullif(F.lower("r.parentSpanId"), F.lit("")),
                   "span.events_count": F.size(F.coalesce("r.events", F.array().cast("array<struct<name:string>>"))), "span.links_count": F.size(F.coalesce("r.links", F.array().cast("array<struct<traceId:string>>")))})
    attributes = over(over(F.col("inherited"), keys_map(F.col("r.attributes"))), own)
    return rows.where(took >= 0).select(
        nanos(F.col("r.startTimeUnixNano")).alias("timestamp"), F.col("r.name").alias("name"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("body"), took.cast("double").alias("value"),
        *_ids(rows, "r.traceId", "r.spanId"), F.nullif(F.lower("r.traceId"), F.lit("")).alias("correlation_id"), without_denied(attributes).alias("attributes"))


def _points(r: Column) -> Column:
    """All data points of one metric, of whatever kind, as one list of (time, flags, value, attributes, own)."""
    temporality = lambda c: F.when(c == 1, TEMPORALITY[1]).when(c == 2, TEMPORALITY[2])
    whole = lambda c: c.try_cast("bigint")
    unit = F.nullif(r["unit"], F.lit(""))

    def listed(kind: str, field: str, value, extra, temporal: bool) -> Column:
        def point(d: Column) -> Column:
            own = present({"metric.unit": unit, "metric.kind": F.lit(kind), "metric.temporality": temporality(r[field]["aggregationTemporality"]) if temporal else F.lit(None), "metric.start_unix_nano": F.nullif(d["startTimeUnixNano"], F.lit("0")), **extra(d)})
            return F.struct(d["timeUnixNano"].alias("time"), d["flags"].alias("flags"), value(d).cast("double").alias("value"), d["attributes"].alias("attributes"), own.alias("own"))

        points = F.transform(r[field]["dataPoints"], point)
        return F.coalesce(points, F.array().cast(f"array<struct<time:string,flags:int,value:double,attributes:{_KEYS},own:map<string,string>>>"))

    number = lambda d: F.coalesce(d["asDouble"], whole(d["asInt"]).cast("double"))
    total = lambda d: F.coalesce(d["sum"], whole(d["count"]).cast("double"))
    integer = lambda d: {"metric.int64": d["asInt"]}
    spread = lambda d: {"metric.count": d["count"], "metric.sum": d["sum"], "metric.min": d["min"], "metric.max": d["max"]}

    def buckets(d: Column) -> dict[str, Column]:
        bounds, counts = d["explicitBounds"], d["bucketCounts"]
        rising = F.forall(F.zip_with(bounds, F.slice(bounds, 2, F.greatest(F.size(bounds), F.lit(1))), lambda a, b: F.coalesce(a < b, F.lit(True))), lambda x: x)
        sound = F.coalesce((F.size(counts) == F.size(bounds) + 1) & rising, F.lit(False))
        return {**spread(d), "metric.bucket_counts": F.when(sound, F.to_json(F.transform(counts, whole))), "metric.explicit_bounds": F.when(sound, F.to_json(bounds))}

    exponential = lambda d: {**spread(d), "metric.scale": F.when(d["scale"].between(-10, 20), d["scale"]), "metric.zero_count": d["zeroCount"], "metric.positive": F.to_json(d["positive"]), "metric.negative": F.to_json(d["negative"])}
    quantiles = lambda d: {"metric.count": d["count"], "metric.sum": d["sum"], "metric.quantiles": F.when(F.forall(d["quantileValues"], lambda q: q["quantile"].between(0, 1)), F.to_json(d["quantileValues"]))}
    return F.concat(listed("gauge", "gauge", number, integer, False), listed("sum", "sum", number, integer, True), listed("histogram", "histogram", total, buckets, True),
                    listed("exponential_histogram", "exponentialHistogram", total, exponential, True), listed("summary", "summary", total, quantiles, False))


def metrics(payloads: DataFrame) -> DataFrame:
    """Data points of gauges, sums, histograms, exponential histograms and summaries; points without a recorded value are skipped."""
    rows = _flat(payloads, METRICS, "resourceMetrics", "scopeMetrics", "metrics").select("inherited", F.col("r.name").alias("name"), _points(F.col("r")).alias("list"))
    points = rows.select("inherited", "name", F.explode("list").alias("d")).where((F.coalesce("d.flags", F.lit(0)).bitwiseAND(NO_RECORDED_VALUE) == 0) & F.col("d.value").isNotNull() & all_fit(F.col("d.attributes")))
    return points.select(nanos(F.col("d.time")).alias("timestamp"), "name", *[F.lit(None).cast("string").alias(c) for c in ("severity", "body")], F.col("d.value").alias("value"),
                         *[F.lit(None).cast("string").alias(c) for c in ("trace_id", "span_id", "correlation_id")], without_denied(over(over(F.col("inherited"), keys_map(F.col("d.attributes"))), F.col("d.own"))).alias("attributes"))
