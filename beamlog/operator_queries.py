"""Queries for the operators beside the pipeline language: rollups, ingest, lifecycle, alerts, views."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.histogram import bucket, percentiles
from .operators import alerts, lifecycle, rollups, views
from .operators import query as rows
from .oracle import bucket_sql, observations_sql, query_sql
from .plans.fields import Descriptor, Registry
from .plans.language import build, parse, render
from .plans.planner import Scope, log_rollup_fits, metric_rollup_fits, plan
from .queries import ORG, comparable
from .sources import collectors, ingest, otlp, segments
from .sources.adapters import NOW, observations, utc
from .streaming.projector import Limits, Projection

FIVE = 300 * 10**9
LOGS, METRICS = observations_sql("logs"), observations_sql("metrics")
B1 = "logs | where status >= 500 | window 24h | summarize count() by route, window(5m) | sort count desc | limit 50"
PARTIAL = "logs | where status >= 400 | window 68h57m30s | summarize count() by route, window(5m) | limit 1000"
B3 = "metrics | window 240h | summarize count(), sum(value), min(value), max(value), avg(value) by name, window(10m) | sort count desc | limit 200"
HISTOGRAM = "CASE WHEN value = 0 THEN 0 ELSE CAST(sign(value) AS BIGINT) * (CAST(round(ln(1 + abs(value)) * 64) AS BIGINT) + 1) END"


def _logs(spark, d):
    return observations(spark, d, "logs")


def _metrics(spark, d):
    return observations(spark, d, "metrics")


def logroll_build(spark, d):
    return comparable(rollups.log_rollup(_logs(spark, d)))


def logroll_merge(spark, d):
    """Partial rollups of two halves merge into the whole."""
    logs = _logs(spark, d)
    halves = [rollups.log_rollup(logs.where(F.pmod("record_index", F.lit(2)) == k)) for k in (0, 1)]
    return comparable(rollups.merge_log_rollups(halves[0].unionByName(halves[1])))


_LOGROLL = f"""WITH o AS ({LOGS}), r AS (SELECT *, {bucket_sql(FIVE)} AS bucket_start, "http.status_code" AS st, "http.route" AS ro FROM o WHERE regexp_matches("http.status_code", '^[1-9][0-9]{{2}}$'))
SELECT organization_id, project_id, environment_id, service_id, bucket_start, CAST(st AS INTEGER) AS status, coalesce(ro, '') AS route, ro IS NOT NULL AS route_present, count(*) AS observation_count,
       sum(64 + strlen(name) + strlen(severity) + strlen(trace_id) + 16 + strlen(st) + 11 + strlen(duration_ns) + 7 + strlen("user.id") + 6 + strlen(cached) + CASE WHEN ro IS NULL THEN 0 ELSE 10 + strlen(ro) END)::BIGINT AS scanned_bytes
FROM r GROUP BY ALL"""


def _by_rollup(text: str, cold: bool = False):
    def run(spark, d) -> DataFrame:
        ast = parse(text)
        base = observations(spark, d, ast.signal)
        made = {"logs": rollups.log_rollup(base)} if ast.signal == "logs" else {"metrics": rollups.metric_rollup(base)}
        got = rollups.answer(base, ast, ORG, NOW, **made)
        assert got.plan.path != "rows"
        return comparable(rows.ranked(got))

    return run


ALIKE = ("logs | where status >= 500 | summarize count() by route", 'metrics | where state == "click" | summarize count(), max(value), sum(value) by name, state, window(30m) | limit 500',
         "metrics | window 100h2m | summarize count(), min(value), avg(value) by service, name | limit 500")


def rollup_vs_row_diff(spark, d):
    """Rows in which a rollup's answer and the row path's differ: none."""
    out = None
    for text in (B1, PARTIAL, B3, *ALIKE):
        ast = parse(text)
        base = observations(spark, d, ast.signal)
        made = {"logs": rollups.log_rollup(base)} if ast.signal == "logs" else {"metrics": rollups.metric_rollup(base)}
        a, b = (comparable(rows.ranked(x)).select(F.lit(text).alias("query"), F.to_json(F.struct("*")).alias("row")) for x in (rollups.answer(base, ast, ORG, NOW, **made), rows.run(base, ast, ORG, NOW)))
        diff = a.exceptAll(b).unionByName(b.exceptAll(a))
        out = diff if out is None else out.unionByName(diff)
    return out


def metroll_build(spark, d):
    got = rollups.metric_rollup(_metrics(spark, d))
    hist = F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return comparable(got.select("project_id", "service_id", "bucket_start", "name", F.try_element_at("attributes", F.lit("state")).alias("state"), "sample_count", F.col("value_sum").alias("sum_value"), "value_min", "value_max", "last_value", "last_timestamp", hist.alias("histogram")))


def metroll_merge(spark, d):
    metrics = _metrics(spark, d)
    halves = [rollups.metric_rollup(metrics.where(F.pmod("record_index", F.lit(2)) == k)) for k in (0, 1)]
    got = rollups.merge_metric_rollups(halves[0].unionByName(halves[1]))
    return comparable(got.groupBy("name").agg(F.sum("sample_count").alias("samples"), F.sum("value_sum").alias("sum_value"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"),
                                              F.sum(F.aggregate(F.map_values("histogram"), F.lit(0).cast("bigint"), lambda n, x: n + x)).alias("counted")))


_METROLL = f"""WITH o AS ({METRICS}), b AS (SELECT *, {bucket_sql(FIVE)} AS bucket_start, {HISTOGRAM} AS h FROM o),
c AS (SELECT project_id, service_id, bucket_start, name, state, h, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT project_id, service_id, bucket_start, name, state, string_agg(h || ':' || n, ',' ORDER BY h) AS histogram FROM c GROUP BY ALL),
v AS (SELECT project_id, service_id, bucket_start, name, state, count(*) AS sample_count, round(sum(value), 6) AS sum_value, min(value) AS value_min, max(value) AS value_max,
      arg_max(value, ("timestamp", source_id, stream_id, sequence, record_index)) AS last_value, max("timestamp") AS last_timestamp FROM b GROUP BY ALL)
SELECT v.*, histogram FROM v JOIN g USING (project_id, service_id, bucket_start, name, state)"""


def metroll_hist(spark, d):
    return _metrics(spark, d).select("name", bucket(F.col("value")).alias("bucket")).groupBy("name", "bucket").agg(F.count(F.lit(1)).alias("n"))


def metroll_pct(spark, d):
    got = percentiles(metroll_hist(spark, d), ["name"], [("p50", 0.5), ("p95", 0.95), ("p99", 0.99)])
    return got.select("name", *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")])


_METROLL_PCT = f"""WITH o AS ({METRICS}), c AS (SELECT name, {HISTOGRAM} AS h, count(*) AS n FROM o GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY h) AS upto, sum(n) OVER (PARTITION BY name) AS total FROM c),
p AS (SELECT name, {', '.join(f"min(CASE WHEN upto >= ceil({s} * total) THEN h END) AS {n}" for n, s in (('p50', 0.5), ('p95', 0.95), ('p99', 0.99)))} FROM u GROUP BY name)
SELECT name, {', '.join(f"round(CASE WHEN {n} = 0 THEN 0 ELSE sign({n}) * (exp((abs({n}) - 1) / 64.0) - 1) END, 6) AS {n}" for n in ('p50', 'p95', 'p99'))} FROM p"""


def metroll_last(spark, d):
    got = rollups.metric_rollup(_metrics(spark, d))
    return comparable(got.groupBy("name").agg(F.max_by("last_value", F.struct("last_timestamp", "project_id", "service_id", "last_value")).alias("last_value"), F.max("last_timestamp").alias("last_timestamp")))


_METROLL_LAST = f"""WITH o AS ({METRICS}), m AS (SELECT name, max("timestamp") AS t FROM o GROUP BY name)
SELECT o.name, arg_max(value, (project_id, service_id, value)) AS last_value, any_value(t) AS last_timestamp FROM o JOIN m ON o.name = m.name AND o."timestamp" = m.t GROUP BY o.name"""

ELIGIBLE = (
    B1, "logs | where status >= 500 | summarize count() by route", "logs | where status > 500 | summarize count() by route", "logs | where status >= 99 | summarize count() by route",
    "logs | where status >= 500 | summarize count() by route, window(7m)", "logs | where status >= 500 | summarize count() by service", "logs | where status >= 500 | summarize count(), max(status) by route",
    "logs | where status >= 500 | where name == x | summarize count() by route", "logs | summarize count() by route", "metrics | summarize count(), p95(value) by name, window(5m)",
    "metrics | where value >= 2 | summarize count()", 'metrics | where route == "/items" | summarize avg(value) by name, window(10m)', "metrics | summarize count() by severity", "metrics | limit 5",
)


def logroll_eligibility(spark, d):
    """Which path each query text takes."""
    out = []
    for text in ELIGIBLE:
        ast = parse(text)
        out.append((text, log_rollup_fits(ast), metric_rollup_fits(ast, Registry()), plan(ast, ORG, sensitive=True).path, plan(ast, ORG, sensitive=True, cold=True).path))
    return spark.createDataFrame(out, "query string, log_rollup boolean, metric_rollup boolean, path string, with_cold string")


_ELIGIBILITY = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t.replace(chr(39), chr(39) * 2)}', {str(a).lower()}, {str(b).lower()}, '{p}', 'rows')" for t, a, b, p in
    [(t, i < 2, i in (9, 11), "log_rollup" if i < 2 else "metric_rollup" if i in (9, 11) else "rows") for i, t in enumerate(ELIGIBLE)]) + ") v(query, log_rollup, metric_rollup, path, with_cold)"


def explain(spark, d):
    """Path, sources and permissions of the headline query."""
    got = plan(parse(B1), Scope("org-a", "project-1")).explain()
    return spark.createDataFrame([(got["path"], got["sources"][0], ",".join(got["permissions"]), got["cacheable"], ",".join(f["field"] for f in got["fields"]))], "path string, source string, permissions string, cacheable boolean, fields string")


_EXPLAIN = "SELECT 'log_rollup' AS path, 'organization:org-a/signal:logs/project:project-1/rollup:5m:status-route' AS source, 'telemetry:query' AS permissions, true AS cacheable, 'http.route,http.status_code' AS fields"


def builder(spark, d):
    text = build({"signal": "logs", "filters": [("route", "==", "/a|b"), ("status", ">=", "500")], "window": "24h", "aggregates": ["count()"], "groups": ["route"], "bucket": "5m", "sort": "count", "descending": True, "limit": "5000"}, 100)
    return spark.createDataFrame([(text, render(parse(text)))], "built string, rendered string")


_BUILDER = """SELECT 'logs | where route == "/a\\u007cb" | where status >= "500" | window 24h | summarize count() by route, window(5m) | sort count desc | limit 100' AS built,
 'logs | where route == "/a\\u007cb" | where status >= "500" | window 24h | summarize count() by route, window(5m) | sort count desc | limit 100' AS rendered"""


def _batches(spark, d, observed: DataFrame | None = None, signal: str = "metrics") -> DataFrame:
    """Rows of a signal (metrics, where none are given) as batches of records, one a source stream and number."""
    record, observed = F.struct(*[F.col(f.name) for f in ingest.m.RECORD]), _metrics(spark, d) if observed is None else observed
    return observed.groupBy("source_id", "stream_id", "sequence").agg(F.array_sort(F.collect_list(F.struct("record_index", record.alias("r"))), lambda a, b: a["record_index"] - b["record_index"]).alias("x")).select(
        F.lit(1).alias("version"), "source_id", "stream_id", "sequence", F.lit(f"{NOW}+00:00").cast("timestamp").alias("observed_at"), F.lit(signal).alias("signal"), F.transform("x", lambda e: e["r"]).alias("records"))


def flatten_batches(spark, d):
    scopes = spark.createDataFrame([("source-a", "org-a", "p", "e", "s")], "source_id string, organization_id string, project_id string, environment_id string, service_id string")
    got = ingest.flatten(_batches(spark, d), scopes)
    return comparable(got.select("organization_id", "stream_id", "sequence", "record_index", "timestamp", "name", "value", F.element_at("attributes", "state").alias("state")))


_FLATTEN = f"""WITH o AS ({METRICS}) SELECT organization_id, stream_id, sequence, CAST(row_number() OVER (PARTITION BY source_id, stream_id, sequence ORDER BY record_index) - 1 AS INTEGER) AS record_index, "timestamp", name, value, state FROM o"""

def validate_records(spark, d):
    logs = _logs(spark, d).withColumn("k", F.pmod("record_index", F.lit(9)))
    bad = logs.withColumns({
        "name": F.when(F.col("k") == 1, "").otherwise(F.col("name")), "severity": F.when(F.col("k") == 2, F.repeat(F.lit("é"), 33)).otherwise(F.col("severity")),
        "trace_id": F.when(F.col("k") == 3, F.upper(F.translate("trace_id", "0", "a"))).otherwise(F.col("trace_id")), "signal": F.when(F.col("k") == 4, "metrics").otherwise("logs"),
        "attributes": F.when(F.col("k") == 5, F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(65)), lambda i: i.cast("string")), F.array_repeat(F.lit("v"), 65))).otherwise(F.col("attributes"))})
    got = ingest.validate_records(bad, datetime(2024, 1, 20))
    return got.groupBy(F.array_join("broken", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


_VALIDATE = f"""WITH o AS ({LOGS}), b AS (SELECT array_to_string(list_filter([
 CASE WHEN "timestamp" > TIMESTAMP '2024-01-20 00:10:00' THEN 'time' END, CASE WHEN record_index % 9 = 1 THEN 'name' END, CASE WHEN record_index % 9 = 2 THEN 'sizes' END,
 CASE WHEN record_index % 9 = 3 THEN 'ids' END, CASE WHEN record_index % 9 = 4 THEN 'value' END, CASE WHEN record_index % 9 = 5 THEN 'attributes' END], lambda x: x IS NOT NULL), ',') AS broken FROM o)
SELECT broken, count(*) AS n FROM b GROUP BY broken"""


def distinct_keys(spark, d):
    return ingest.distinct_keys(_logs(spark, d))


_DISTINCT_KEYS = f"""WITH o AS ({LOGS}) SELECT source_id, stream_id, sequence, count(DISTINCT key) AS distinct_keys
FROM (SELECT source_id, stream_id, sequence, unnest(list_filter([CASE WHEN "http.route" IS NOT NULL THEN 'r' END, 's', 'd', 'u', 'c'], lambda x: x IS NOT NULL)) AS key FROM o) GROUP BY ALL"""


def _numbers(spark, d):
    return _logs(spark, d).select("source_id", "stream_id", "sequence").distinct().where((F.col("sequence") * 7 + F.length("stream_id")) % 5 != 0)


_NUMBERS = f"n AS (SELECT DISTINCT source_id, stream_id, sequence FROM ({LOGS}) WHERE (sequence * 7 + length(stream_id)) % 5 <> 0)"


def stream_gaps(spark, d):
    return ingest.stream_gaps(_numbers(spark, d))


_GAPS = f"WITH {_NUMBERS}, g AS (SELECT *, lead(sequence) OVER (PARTITION BY source_id, stream_id ORDER BY sequence) AS next_sequence FROM n) SELECT * FROM g WHERE next_sequence > sequence + 1"


def stream_admission(spark, d):
    """Arrivals with a hole in two streams, a repeat and a changed repeat, against a watermark of 2."""
    base = _logs(spark, d).select("source_id", "stream_id", "sequence").distinct()
    digest = F.concat(F.lit("d"), F.col("sequence").cast("string"))
    some = base.where(~(F.col("stream_id").isin("stream-1", "stream-2") & (F.col("sequence") == 5))).select("*", digest.alias("digest"), F.lit(1).alias("arrived"))
    again = base.where("sequence in (4, 2, 7)").select("*", F.when(F.col("sequence") == 7, "other").otherwise(digest).alias("digest"), F.lit(2).alias("arrived"))
    marks = base.select("source_id", "stream_id").distinct().select("*", F.lit(2).cast("long").alias("sequence"), F.lit("d2").alias("digest"))
    return ingest.admit(some.unionByName(again), marks).groupBy("stream_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


_ADMISSION = f"""WITH b AS (SELECT DISTINCT stream_id, sequence FROM ({LOGS})),
a AS (SELECT stream_id, sequence, 1 AS arrived FROM b WHERE NOT (stream_id IN ('stream-1', 'stream-2') AND sequence = 5) UNION ALL SELECT stream_id, sequence, 2 FROM b WHERE sequence IN (4, 2, 7)),
h AS (SELECT *, stream_id IN ('stream-1', 'stream-2') AS holed FROM a),
o AS (SELECT stream_id, CASE WHEN sequence < 2 THEN 'older_replay' WHEN sequence = 2 THEN 'duplicate' WHEN holed AND sequence >= 5 THEN 'gap'
  WHEN arrived = 1 THEN 'accepted' WHEN sequence = 7 THEN 'conflict' ELSE 'duplicate' END AS outcome FROM h)
SELECT stream_id, outcome, count(*) AS n FROM o GROUP BY ALL"""


def replay_dedup(spark, d):
    """A second delivery of half the rows adds none."""
    logs = _logs(spark, d)
    half = logs.where("record_index % 2 = 0")
    return ingest.new_rows(logs.unionByName(half), half).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))


_REPLAY = f"SELECT stream_id, count(*) AS n FROM ({LOGS}) WHERE record_index % 2 = 1 GROUP BY stream_id"


def field_stats(spark, d):
    return comparable(lifecycle.field_statistics(_logs(spark, d)))


_FIELD_STATS = f"""WITH o AS ({LOGS}) SELECT 'logs' AS signal, 'user.id' AS field, count(*) AS rows, sum(strlen("user.id"))::BIGINT AS bytes, 'integer' AS inferred, min("timestamp") AS first_seen, max("timestamp") AS last_seen FROM o
UNION ALL SELECT 'logs', 'cached', count(*), sum(strlen(cached))::BIGINT, 'string', min("timestamp"), max("timestamp") FROM o"""



def _attributes(spark, d) -> DataFrame:
    """Every attribute of every log and metric record: signal, field, text."""
    every = _logs(spark, d).select("signal", "attributes").unionByName(_metrics(spark, d).select("signal", "attributes"))
    return every.select("signal", F.explode("attributes").alias("field", "text"))


def infer_type(spark, d):
    """Inferred types of all attributes, with how many values have each."""
    return _attributes(spark, d).groupBy("signal", "field", lifecycle.inferred_type(F.col("text")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def widen_type(spark, d):
    """One type for each attribute of all records."""
    return _attributes(spark, d).groupBy("signal", "field").agg(lifecycle.widened(lifecycle.inferred_type(F.col("text"))).alias("kind"))


_KINDS = f"""a AS (SELECT 'logs' AS signal, x.field, x.text FROM (SELECT unnest([{{'field': 'http.route', 'text': "http.route"}}, {{'field': 'http.status_code', 'text': "http.status_code"}},
 {{'field': 'duration_ns', 'text': duration_ns}}, {{'field': 'user.id', 'text': "user.id"}}, {{'field': 'cached', 'text': cached}}]) AS x FROM ({LOGS}))
UNION ALL SELECT 'metrics', x.field, x.text FROM (SELECT unnest([{{'field': 'state', 'text': state}}, {{'field': 'user.id', 'text': "user.id"}}]) AS x FROM ({METRICS}))),
k AS (SELECT signal, field, CASE WHEN regexp_matches(text, '^[+-]?[0-9]+$') THEN 'integer' WHEN text IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind FROM a WHERE text IS NOT NULL)"""
_INFER = f"WITH {_KINDS} SELECT signal, field, kind, count(*) AS n FROM k GROUP BY ALL"
_WIDEN = f"WITH {_KINDS} SELECT signal, field, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'string' END AS kind FROM k GROUP BY ALL"


def typed_index(spark, d):
    reviewed = [Descriptor("http.status_code", "integer"), Descriptor("cached", "boolean"), Descriptor("user.id", "integer")]
    return lifecycle.typed_index(_logs(spark, d), "logs", reviewed).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("value_text").alias("texts"), F.sum("value_number").alias("sum_number"), F.max("value_text").alias("last_text"))


_TYPED_INDEX = f"""WITH o AS ({LOGS})
SELECT 'http.status_code' AS field, count(*) AS n, 0::BIGINT AS texts, sum(CAST("http.status_code" AS DOUBLE)) AS sum_number, NULL AS last_text FROM o WHERE regexp_matches("http.status_code", '^[0-9]+$')
UNION ALL SELECT 'user.id', count(*), 0, sum(CAST("user.id" AS DOUBLE)), NULL FROM o
UNION ALL SELECT 'cached', count(*), count(*), NULL, 'true' FROM o WHERE cached IN ('true', 'F')"""


def promoted_filter(spark, d):
    """A filter on a promoted column counts what the same filter on the map does."""
    wide = lifecycle.promote(_logs(spark, d), [Descriptor("http.status_code", "integer")])
    return wide.where(F.col("p_http_status_code") >= 500).groupBy(F.col("p_http_status_code").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_PROMOTED = f"""SELECT CAST("http.status_code" AS BIGINT) AS status, count(*) AS n FROM ({LOGS}) WHERE regexp_matches("http.status_code", '^[0-9]+$') AND CAST("http.status_code" AS BIGINT) >= 500 GROUP BY ALL"""


_NAMES = ("user.password", "API-KEY", "x.api.key", "route", "set-cookie", "access/token", "Authorization", "plain", "tokens")


def deny_keys(spark, d):
    """Which attribute names survive, when every log record brings one more of nine names."""
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.pmod(F.col("sequence") + F.col("record_index"), F.lit(len(_NAMES))).cast("int"))
    kept = ingest.without_denied(F.map_concat("attributes", F.create_map(name, F.lit("v"))))
    return _logs(spark, d).select(F.explode(F.map_keys(kept)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_DENY = f"""WITH o AS ({LOGS}), e AS (SELECT unnest(list_filter(['http.status_code', 'duration_ns', 'user.id', 'cached', CASE WHEN "http.route" IS NOT NULL THEN 'http.route' END,
 [{', '.join(f"'{n}'" for n in _NAMES)}][(sequence + record_index) % {len(_NAMES)} + 1]], lambda x: x IS NOT NULL)) AS name FROM o)
SELECT name, count(*) AS n FROM e WHERE name NOT IN ('user.password', 'API-KEY', 'x.api.key', 'set-cookie', 'access/token', 'Authorization') GROUP BY name"""


def auto_sequence(spark, d):
    """Batches without numbers get the next ones of their streams, after a watermark of 5."""
    batches = _batches(spark, d).drop("sequence", "observed_at")
    marks = batches.select("source_id", "stream_id").distinct().select("*", F.lit(5).cast("long").alias("sequence"), F.lit("x").alias("content_digest"))
    got = ingest.numbered(batches.withColumn("sequence", F.lit(0).cast("long")).withColumn("observed_at", F.lit(None).cast("timestamp")), marks)
    return comparable(got.select("stream_id", "sequence", "observed_at", F.size("records").cast("long").alias("records")))


_AUTO = f"""WITH b AS (SELECT stream_id, sequence AS old, count(*) AS records, max("timestamp") AS observed_at FROM ({METRICS}) GROUP BY ALL)
SELECT stream_id, 5 + row_number() OVER (PARTITION BY stream_id ORDER BY observed_at) AS sequence, observed_at, records FROM b"""


def raw_segments(spark, d):
    """Batches written as raw segments and read back: whole ones and their records by stream; one in seven is damaged."""
    stored = segments.raw_segments(_batches(spark, d))
    damaged = stored.withColumn("content", F.when(F.col("sequence") % 7 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    good, bad = segments.parsed_segments(damaged)
    whole = good.select("stream_id", F.size("records").alias("records"), F.lit(1).alias("good"), F.lit(0).alias("bad"))
    both = whole.unionByName(bad.select("stream_id", F.lit(0).alias("records"), F.lit(0).alias("good"), F.lit(1).alias("bad")))
    return both.groupBy("stream_id").agg(F.sum("good").alias("segments"), F.sum("records").alias("records"), F.sum("bad").alias("damaged"))


_RAW_SEGMENTS = f"""WITH b AS (SELECT stream_id, sequence, count(*) AS n FROM ({METRICS}) GROUP BY ALL)
SELECT stream_id, count(*) FILTER (sequence % 7 <> 0) AS segments, coalesce(sum(n) FILTER (sequence % 7 <> 0), 0)::BIGINT AS records, count(*) FILTER (sequence % 7 = 0) AS damaged FROM b GROUP BY stream_id"""


def cold_scan(spark, d):
    """A query over raw cold segments: the catalogue picks the segments that are cold and reach into the look-back."""
    stored = segments.raw_segments(_batches(spark, d))
    catalogue = stored.select("digest", "signal", "last_observed", F.lit("org-a").alias("organization_id"), F.when(F.col("sequence") % 3 == 0, "hot").otherwise("cold").alias("tier"))
    scopes = spark.createDataFrame([("source-a", "org-a", "p", "e", "s")], "source_id string, organization_id string, project_id string, environment_id string, service_id string")
    ast = parse(_COLD)
    cold = segments.cold_observations(stored, catalogue, scopes, "metrics", "org-a", rows.since(NOW, ast.window))
    none = _metrics(spark, d).limit(0)
    return comparable(rows.ranked(rollups.answer(none, ast, ORG, NOW, cold=cold)))


_COLD = "metrics | window 360h | summarize count(), max(value), sum(value) by name | limit 100"
_COLD_SQL = query_sql(parse(_COLD), ORG, source=f"SELECT * FROM ({METRICS}) WHERE sequence % 3 <> 0")
ALERTS = ("logs | where status >= 500 | window 24h | limit 100", "metrics | where value >= 100 | window 72h | limit 1000", "logs | where status >= nope", "metrics | window 1h | summarize count() by name")


def _alert(k: int) -> tuple[Scope, int, int]:
    """Scope, least matches and consecutive matches of rule k."""
    return Scope("org-a", f"project-{k % 3}"), 1 + 40 * (k % 2), 1 + k % 3


def alert_evaluations(spark, d):
    """Due rules, their saved queries' row counts, errors, and the incidents they open."""
    saved = {("org-a", f"q{k}"): (views.SavedQuery.of(f"q{k}", ALERTS[k % len(ALERTS)]), _alert(k)[0]) for k in range(12) if k != 9}
    listed = [("org-a", f"rule-{k}", f"q{k}", _alert(k)[1], _alert(k)[2], 60, k != 10, NOW.isoformat() + "Z" if k < 11 else "2024-01-31T00:00:01Z") for k in range(12)]
    table = spark.createDataFrame(listed, "organization_id string, rule_id string, query_id string, minimum long, consecutive long, interval_seconds long, enabled boolean, at string").withColumn("next_at", F.col("at").cast("timestamp")).drop("at")
    told = alerts.evaluated(alerts.due_rules(table, NOW), saved, _logs(spark, d).unionByName(_metrics(spark, d)), NOW)
    none = spark.createDataFrame([], "organization_id string, rule_id string, number long, state string, count long, silenced_until timestamp, updated_at timestamp")
    opened = alerts.advanced(none, told).select("rule_id", "state", "event")
    return told.join(opened, "rule_id", "left").select("rule_id", "rows", "error", "state", "event")


def _alert_sql() -> str:
    out = []
    for k in range(10):
        scope, least, consecutive = _alert(k)
        if k == 9 or k % len(ALERTS) == 2:
            out.append(f"SELECT 'rule-{k}' AS rule_id, NULL::BIGINT AS rows, 'query_unavailable' AS error, {least} AS least, {consecutive} AS consecutive")
        else:
            out.append(f"SELECT 'rule-{k}' AS rule_id, (SELECT count(*) FROM ({query_sql(parse(ALERTS[k % len(ALERTS)]), scope)})) AS rows, NULL::VARCHAR AS error, {least} AS least, {consecutive} AS consecutive")
    return f"WITH e AS ({' UNION ALL '.join(out)}) SELECT rule_id, rows, error, CASE WHEN rows >= least THEN CASE WHEN consecutive = 1 THEN 'firing' ELSE 'pending' END END AS state, CASE WHEN rows >= least THEN 'opened' END AS event FROM e"


def json_lines_web(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    line = F.to_json(F.struct((F.unix_micros(utc("ts")) / 1e6).alias("ts"), F.struct(F.lit("GET").alias("method"), F.concat(F.lit("/"), "event_type", F.lit("?a=1#f")).alias("uri"), F.lit("10.0.0.1").alias("remote_ip")).alias("request"),
                              (F.lit(200) + F.col("event_id") % 400).alias("status"), F.col("user_id").alias("size"), F.col("value").alias("duration"), F.lit("x").alias("password")))
    lines = events.select(F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 10 == 1, '{"status": 200}').otherwise(line).alias("line"))
    got = collectors.web_access(lines, frozenset({"query"}))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    return got.groupBy("name", "severity", get("http.path").alias("path"), get("http.query").alias("query"), get("http.method").alias("method")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(get("http.status_code").cast("bigint")).alias("total_status"), F.sum(get("http.response_bytes").cast("bigint")).alias("bytes"), F.max(F.size("attributes")).cast("bigint").alias("keys"))


_WEB = """SELECT 'web.http.request' AS name, CASE WHEN 200 + event_id % 400 >= 500 THEN 'error' ELSE 'information' END AS severity, '/' || event_type AS path, 'a=1' AS query, 'GET' AS method,
 count(*) AS n, sum(200 + event_id % 400)::BIGINT AS total_status, sum(user_id)::BIGINT AS bytes, 6::BIGINT AS keys FROM events WHERE event_id % 10 > 1 GROUP BY ALL"""


def json_lines_requestlog(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    which = F.col("event_id") % 4
    line = F.to_json(F.struct(F.when(which == 0, at).alias("observed_at"), F.when(which == 0, F.lit("2000-01-01T00:00:00Z")).when(which == 1, at).otherwise("bad").alias("timestamp"), F.when(which < 3, at).alias("time"),
                              F.concat(F.lit("/"), "event_type").alias("route"), (F.lit(200) + F.col("event_id") % 400).alias("status"), F.col("value").alias("duration_ms"), F.lit("s").alias("session_id")))
    got = collectors.request_log(events.select(line.alias("line")))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    return comparable(got.groupBy("severity", get("http.route").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"), F.count(get("session.id")).alias("sessions")))


_REQUESTS = """SELECT CASE WHEN 200 + event_id % 400 >= 500 THEN 'error' ELSE 'information' END AS severity, '/' || event_type AS route, count(*) AS n, date_trunc('second', min(ts)) AS first_at, date_trunc('second', max(ts)) AS last_at, 0::BIGINT AS sessions
 FROM events WHERE event_id % 4 < 3 GROUP BY ALL"""


def json_lines_deployments(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    extra = F.when(F.col("o_orderkey") % 5 == 0, "x")
    line = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("operation_id"), F.col("o_orderstatus").alias("outcome"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("api").alias("service"), extra.alias("unexpected")))
    got = collectors.deployment_events(orders.select(line.alias("line")))
    return got.groupBy(F.try_element_at("attributes", F.lit("deployment.outcome")).alias("outcome"), F.try_element_at("attributes", F.lit("service.name")).alias("service")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("correlation_id").cast("bigint")).alias("least_id"))


_DEPLOYS = "SELECT o_orderstatus AS outcome, 'api' AS service, count(*) AS n, min(o_orderkey) AS least_id FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY ALL"


def json_lines_problems(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return collectors.line_problems(events.select(F.when(F.col("event_id") % 10 == 0, "{broken").when(F.col("event_id") % 1000 == 1, F.repeat(F.lit("x"), (1 << 20) + 1)).otherwise("{}").alias("line")))


_PROBLEMS = "SELECT CASE WHEN event_id % 1000 = 1 THEN 'oversized' WHEN event_id % 10 = 0 THEN 'malformed' ELSE 'fine' END AS kind, count(*) AS lines FROM events GROUP BY ALL"


def _kv(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), F.struct(value.alias("stringValue")).alias("value"))


def _payload(events: DataFrame, top: str, inner: str, item: str, record) -> DataFrame:
    resource = F.struct(F.array(_kv("service.name", F.lit("shop")), _kv("level", F.lit("resource"))).alias("attributes"))
    scope = F.struct(F.lit("lib").alias("name"), F.lit("1").alias("version"))
    grouped = events.groupBy("event_type", F.floor(F.col("event_id") / 500).alias("part")).agg(F.collect_list(record).alias("rs"))
    body = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(scope.alias("scope"), F.col("rs").alias(item))).alias(inner))).alias(top))
    return grouped.select(F.to_json(body).alias("payload"))


def otlp_json_logs(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    record = F.struct((F.unix_micros(utc("ts")) * 1000).cast("string").alias("timeUnixNano"), F.lit(17).alias("severityNumber"), F.struct(F.col("event_type").alias("stringValue")).alias("body"),
                      F.array(_kv("level", F.lit("record")), _kv("access.token", F.lit("t"))).alias("attributes"), F.lpad(F.hex("event_id"), 32, "0").alias("traceId"))
    got = otlp.logs(_payload(events, "resourceLogs", "scopeLogs", "logRecords", record))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    return comparable(got.groupBy("name", "severity", "body", get("level").alias("level"), get("otel.scope.name").alias("scope"), get("access.token").alias("token")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.countDistinct("trace_id").alias("traces")))


_OTLP_LOGS = "SELECT 'otlp.log' AS name, 'SEVERITY_NUMBER_ERROR' AS severity, event_type AS body, 'record' AS level, 'lib' AS scope, CAST(NULL AS VARCHAR) AS token, count(*) AS n, min(ts) AS first_at, count(*) AS traces FROM events GROUP BY ALL"


def otlp_json_metrics(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    at = (F.unix_micros(utc("ts")) * 1000).cast("string").alias("timeUnixNano")
    which = F.col("event_id") % 3
    point = F.struct(at, F.when(which == 0, F.col("value")).alias("asDouble"), F.when(which == 1, F.col("user_id").cast("string")).alias("asInt"), F.when(F.col("event_id") % 7 == 0, 1).alias("flags"))
    histogram = F.struct(at, F.lit("3").alias("count"), F.col("value").alias("sum"), F.array(F.lit("1"), F.lit("2")).alias("bucketCounts"), F.array(F.lit(1.5)).alias("explicitBounds"))
    record = F.struct(F.concat(F.lit("m."), "event_type").alias("name"), F.lit("ms").alias("unit"), F.when(which < 2, F.struct(F.array(point).alias("dataPoints"))).alias("gauge"),
                      F.when(which == 2, F.struct(F.array(histogram).alias("dataPoints"), F.lit(2).alias("aggregationTemporality"))).alias("histogram"))
    got = otlp.metrics(_payload(events, "resourceMetrics", "scopeMetrics", "metrics", record))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    return got.groupBy("name", get("metric.kind").alias("kind"), get("metric.unit").alias("unit"), get("metric.temporality").alias("temporality"), get("metric.bucket_counts").alias("buckets")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("sum_value"), F.count(get("metric.int64")).alias("integers"))


_OTLP_METRICS = """SELECT 'm.' || event_type AS name, CASE WHEN event_id % 3 = 2 THEN 'histogram' ELSE 'gauge' END AS kind, 'ms' AS unit, CASE WHEN event_id % 3 = 2 THEN 'cumulative' END AS temporality, CASE WHEN event_id % 3 = 2 THEN '[1,2]' END AS buckets,
 count(*) AS n, round(sum(CASE WHEN event_id % 3 = 1 THEN user_id ELSE value END), 4) AS sum_value, count(*) FILTER (event_id % 3 = 1) AS integers FROM events WHERE event_id % 3 = 2 OR event_id % 7 <> 0 GROUP BY ALL"""


def otlp_json_traces(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    start = F.unix_micros(utc("ts")) * 1000
    took = F.when(F.col("event_id") % 10 == 0, -5).otherwise(F.col("user_id") * 1000)
    record = F.struct(F.col("event_type").alias("name"), F.lpad(F.hex("event_id"), 32, "0").alias("traceId"), F.lpad(F.hex("event_id"), 16, "0").alias("spanId"), start.cast("string").alias("startTimeUnixNano"), (start + took).cast("string").alias("endTimeUnixNano"), F.lit(2).alias("kind"))
    got = otlp.traces(_payload(events, "resourceSpans", "scopeSpans", "spans", record))
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    return got.groupBy("name", get("span.kind").alias("kind"), get("span.events_count").alias("span_events")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"), F.max("span_id").alias("last_span"))


_OTLP_TRACES = "SELECT event_type AS name, '2' AS kind, '0' AS span_events, count(*) AS n, sum(user_id * 1000)::DOUBLE AS sum_value, max(lpad(lower(to_hex(event_id)), 16, '0')) AS last_span FROM events WHERE event_id % 10 <> 0 GROUP BY ALL"

KEEP = lifecycle.Retention(logs=10, traces=10, metrics=5, cold=400, rollups=20, evidence=30)


def retention_survivors(spark, d):
    every = _logs(spark, d).unionByName(_metrics(spark, d))
    return comparable(lifecycle.survivors(every, KEEP, NOW).groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest")))


_RETENTION = f"""SELECT 'logs' AS signal, count(*) AS n, min("timestamp") AS oldest FROM ({LOGS}) WHERE "timestamp" >= TIMESTAMP '2024-01-21' UNION ALL
SELECT 'metrics', count(*), min("timestamp") FROM ({METRICS}) WHERE "timestamp" >= TIMESTAMP '2024-01-26'"""


def retention_rollups(spark, d):
    kept = lifecycle.surviving_rollups(rollups.log_rollup(_logs(spark, d)), KEEP, NOW)
    return comparable(kept.agg(F.sum("observation_count").alias("n"), F.min("bucket_start").alias("oldest")))


_RETENTION_ROLLUPS = f"""SELECT count(*) AS n, min({bucket_sql(FIVE)}) AS oldest FROM ({LOGS}) WHERE "timestamp" >= TIMESTAMP '2024-01-11' AND regexp_matches("http.status_code", '^[1-9][0-9]{{2}}$')"""


def segments_to_cold(spark, d):
    hot = lifecycle.segments_of(_logs(spark, d)).withColumns({"tier": F.lit("hot"), "projected": F.col("sequence") % 7 != 0})
    early = _logs(spark, d).where(F.col("timestamp") < F.lit("2024-01-20 00:00:00+00:00").cast("timestamp"))
    hot = hot.unionByName(lifecycle.segments_of(early.withColumn("stream_id", F.concat(F.lit("early-"), "stream_id"))).withColumns({"tier": F.lit("hot"), "projected": F.col("sequence") % 7 != 0}))
    return lifecycle.tiers(hot, KEEP, NOW).groupBy("next_tier").agg(F.count(F.lit(1)).alias("segments"), F.sum("records").alias("records"))


_TO_COLD = f"""WITH o AS ({LOGS}), s AS (SELECT stream_id, sequence, count(*) AS records, max("timestamp") AS last FROM o GROUP BY ALL
UNION ALL SELECT 'early-' || stream_id, sequence, count(*), max("timestamp") FROM o WHERE "timestamp" < TIMESTAMP '2024-01-20' GROUP BY ALL)
SELECT CASE WHEN last < TIMESTAMP '2024-01-21' AND sequence % 7 <> 0 THEN 'cold' ELSE 'hot' END AS next_tier, count(*) AS segments, sum(records)::BIGINT AS records FROM s GROUP BY ALL"""

_HOT_COLD = "logs | window 720h | summarize count(), max(duration) by route | limit 100"


def hot_cold_union(spark, d):
    """Rows split into tiers by age, read as one: the exact row path and every row once."""
    logs, cut = _logs(spark, d), F.lit("2024-01-21 00:00:00+00:00").cast("timestamp")
    got = rollups.answer(logs.where(F.col("timestamp") >= cut), parse(_HOT_COLD), ORG, NOW, cold=logs.where(F.col("timestamp") < cut))
    assert got.plan.path == "rows" and got.plan.sources[-1].endswith("/cold:raw")
    return comparable(rows.ranked(got))


def _scratch(spark, name: str) -> str:
    """A new folder for a projection: under the shared one that the session names, or a local session's own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="beamlog-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tiered_rows(spark, d):
    """Batches through the projector, then aged, retained and rebuilt: hot and cold reads have every row once, rollups those of their days."""
    scopes = spark.createDataFrame([("source-a", "org-a", "p", "e", "s")], "source_id string, organization_id string, project_id string, environment_id string, service_id string")
    projection = Projection(spark, _scratch(spark, "tiers"), scopes, now=NOW, limits=Limits(10_000, 1 << 40, 10_000))
    projection.settle(_batches(spark, d), 0)
    projection.age(KEEP)
    projection.retain(KEEP)
    projection.rebuild("v1")
    hot, cold = projection.observations().drop("date"), projection.cold("metrics", "org-a")
    both = hot.withColumn("tier", F.lit("hot")).unionByName(cold.withColumn("tier", F.lit("cold")))
    rolled = projection.rollup("metric").groupBy("name").agg(F.sum("sample_count").alias("rolled"))
    return both.groupBy("name").agg(F.count_if(F.col("tier") == "hot").alias("hot"), F.count_if(F.col("tier") == "cold").alias("cold"), F.round(F.sum("value"), 4).alias("sum_value")).join(rolled, "name")


_TIERED = f"""WITH o AS ({METRICS}), s AS (SELECT *, max("timestamp") OVER (PARTITION BY stream_id, sequence) AS latest FROM o),
t AS (SELECT *, latest >= TIMESTAMP '2024-01-26' AND "timestamp" >= TIMESTAMP '2024-01-26' AS is_hot FROM s)
SELECT name, count(*) FILTER (is_hot) AS hot, count(*) FILTER (NOT is_hot) AS cold, round(sum(value), 4) AS sum_value, count(*) FILTER ("timestamp" >= TIMESTAMP '2024-01-11') AS rolled FROM t GROUP BY name"""


def _segments(spark, d):
    size = F.octet_length("name") + F.coalesce(F.octet_length("trace_id"), F.lit(0))
    return _logs(spark, d).groupBy("project_id", "stream_id", "sequence").agg(F.sum(size).alias("bytes"), F.min("timestamp").alias("committed_at")).select(
        F.col("project_id").alias("organization_id"), F.concat_ws("-", "stream_id", "sequence").alias("digest"), "bytes", "committed_at", (F.col("sequence") % 3 == 0).alias("projected"))


_SEGMENTS = f"""s AS (SELECT project_id AS organization_id, stream_id || '-' || sequence AS digest, sum(strlen(name) + strlen(trace_id))::BIGINT AS bytes, min("timestamp") AS committed_at, sequence % 3 = 0 AS projected FROM ({LOGS}) GROUP BY project_id, stream_id, sequence)"""


def projection_lag(spark, d):
    return comparable(lifecycle.projection_lag(_segments(spark, d)))


_LAG = f"WITH {_SEGMENTS} SELECT organization_id, count(*) AS pending, sum(bytes)::BIGINT AS pending_bytes, min(committed_at) AS oldest FROM s WHERE NOT projected GROUP BY ALL"


def fair_pending(spark, d):
    got = lifecycle.fair_pending(_segments(spark, d), each=16, bytes_each=20_000)
    return comparable(got.select("organization_id", "digest", "bytes", "committed_at", F.col("turn").cast("bigint").alias("turn")))


_FAIR = f"""WITH {_SEGMENTS}, w AS (SELECT organization_id, digest, bytes, committed_at, row_number() OVER q AS turn, sum(bytes) OVER (q ROWS UNBOUNDED PRECEDING) AS upto FROM s WHERE NOT projected WINDOW q AS (PARTITION BY organization_id ORDER BY committed_at, digest))
SELECT organization_id, digest, bytes, committed_at, turn FROM w WHERE turn <= 16 AND (upto <= 20000 OR turn = 1)"""


def quota_check(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    usage = orders.select(F.col("o_orderkey").alias("organization_id"), (F.col("o_orderkey") * 10).alias("used"), F.lit(500).alias("compressed"), F.lit(1500).alias("uncompressed"), F.lit(50_000).alias("quota"))
    return lifecycle.quota_problems(usage).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


_QUOTA = "SELECT o_orderkey * 10 + 2000 > 50000 AS rejected, count(*) AS n FROM orders GROUP BY ALL"


def organizations_union(spark, d):
    names = [observations(spark, d, s).select(F.col("project_id").alias("organization_id")) for s in ("logs", "traces", "deployments")]
    return lifecycle.organizations(*names)


_ORGANIZATIONS = " UNION ".join(f"SELECT project_id AS organization_id FROM ({observations_sql(s)})" for s in ("logs", "traces", "deployments"))


def _evaluations(spark, d):
    """Rows per hour and event type: a rule a type, evaluated hourly."""
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.groupBy(F.col("event_type").alias("rule_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at")).agg(F.count_if(F.col("value") > 50).alias("rows"))


_EVALUATIONS = """e AS (SELECT event_type AS rule_id, date_trunc('hour', ts) AS "at", count(*) FILTER (value > 50) AS rows FROM events GROUP BY ALL)"""
_RUNS = f"""{_EVALUATIONS}, f AS (SELECT *, rows >= 2 AS matched, sum(CASE WHEN rows >= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY rule_id ORDER BY "at") AS island FROM e),
r AS (SELECT rule_id, "at", rows, matched, sum(CASE WHEN matched THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id, island ORDER BY "at")::BIGINT AS run, lead("at") OVER (PARTITION BY rule_id ORDER BY "at") AS next_at FROM f)"""


def incident_consecutive(spark, d):
    return comparable(alerts.consecutive_matches(_evaluations(spark, d), 2))


def incidents(spark, d):
    return comparable(alerts.incidents(_evaluations(spark, d), 2, 3))


_INCIDENTS = f"""WITH {_RUNS}, n AS (SELECT *, sum(CASE WHEN run = 1 AND matched THEN 1 ELSE 0 END) OVER (PARTITION BY rule_id ORDER BY "at")::BIGINT AS number FROM r),
g AS (SELECT rule_id, number, min("at") AS opened_at, min(CASE WHEN run = 3 THEN "at" END) AS fired_at, count(*) AS matches, max("at") AS last_at FROM n WHERE matched GROUP BY ALL),
w AS (SELECT g.*, (SELECT next_at FROM n WHERE n.rule_id = g.rule_id AND n."at" = g.last_at) AS resolved_at FROM g)
SELECT rule_id, number, opened_at, fired_at, matches, resolved_at, CASE WHEN resolved_at IS NOT NULL THEN 'resolved' WHEN fired_at IS NOT NULL THEN 'firing' ELSE 'pending' END AS state FROM w"""


def incident_fold(spark, d):
    """Events of the state machine, run over each rule's evaluations; agrees with incidents()."""
    got = alerts.fold(_evaluations(spark, d), 2, 3)
    return got.groupBy("rule_id", "event").agg(F.count(F.lit(1)).alias("n"))


_FOLD = f"""WITH {_RUNS} SELECT rule_id, event, count(*) AS n FROM (SELECT rule_id, 'opened' AS event FROM r WHERE run = 1 AND matched UNION ALL SELECT rule_id, 'promoted' FROM r WHERE run = 3 AND matched
UNION ALL SELECT rule_id, 'resolved' FROM (SELECT *, lag(matched) OVER (PARTITION BY rule_id ORDER BY "at") AS before FROM r) WHERE before AND NOT matched) GROUP BY ALL"""


def incident_order(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    state = F.get(F.array(*[F.lit(s) for s in alerts.STATES]), F.pmod("o_orderkey", F.lit(5)).cast("int"))
    listed = orders.select(F.col("o_orderkey").alias("id"), state.alias("state"), F.col("o_orderdate").alias("updated_at"))
    top = alerts.incident_order(listed).limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(alerts.state_rank(F.col("state")), F.col("updated_at").desc(), "id")).cast("bigint"))


_INCIDENT_ORDER = "SELECT o_orderkey AS id, ['firing', 'pending', 'acknowledged', 'silenced', 'resolved'][o_orderkey % 5 + 1] AS state, o_orderdate AS updated_at, row_number() OVER (ORDER BY o_orderkey % 5, o_orderdate DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 200"


def batch_rule(spark, d):
    return comparable(alerts.batch_rule(_logs(spark, d), parse("logs | where status >= 500"), 15))


_BATCH_RULE = f"""WITH o AS ({LOGS}) SELECT source_id, stream_id, sequence, count(*) FILTER (regexp_matches("http.status_code", '^[0-9]+$') AND try_cast("http.status_code" AS BIGINT) >= 500) AS matches,
 min("timestamp") AS first_at, max("timestamp") AS last_at, CASE WHEN matches >= 15 THEN 'matched' ELSE 'clear' END AS state FROM o GROUP BY source_id, stream_id, sequence"""


def batch_rule_error(spark, d):
    got = alerts.batch_rule(_logs(spark, d), parse("logs | where status >= nope"), 1)
    return got.groupBy("state").agg(F.sum("matches").alias("matches"))


def transition_gaps(spark, d):
    n = _numbers(spark, d)
    told = n.select(F.lit("r").alias("rule_id"), "source_id", "stream_id", "sequence", F.greatest(F.col("sequence") - 1, F.lit(1)).alias("from_sequence"), F.col("sequence").alias("to_sequence"))
    told = told.withColumn("rule_id", F.concat(F.lit("r-"), "stream_id"))
    return alerts.transition_problems(told, n).select("stream_id", "sequence", "problem")


_TRANSITIONS = f"""WITH {_NUMBERS}, t AS (SELECT *, coalesce(lag(sequence) OVER (PARTITION BY source_id, stream_id ORDER BY sequence), 0) AS before FROM n)
SELECT stream_id, sequence, CASE WHEN sequence <> before + 1 THEN 'gap' WHEN sequence > 1 AND before <> sequence - 1 THEN 'evidence' END AS problem FROM t"""

_CHART = "logs | summarize count() by route, severity | sort count desc | limit 60"


def _ranked(spark, d, text: str) -> DataFrame:
    return rows.ranked(rows.run(_logs(spark, d), parse(text), ORG, NOW))


def chart_points(spark, d):
    return views.chart_points(_ranked(spark, d, _CHART))


_CHART_SQL = f"SELECT rank AS point, concat_ws(' / ', coalesce(http_route, ''), coalesce(severity, '')) AS label, count::DOUBLE AS y FROM ({query_sql(parse(_CHART), ORG)}) WHERE rank <= 48"


def stat_cell(spark, d):
    return views.stat_cell(_ranked(spark, d, "logs | where status >= 500 | summarize count()"))


_STAT = f"SELECT count::VARCHAR AS cell FROM ({query_sql(parse('logs | where status >= 500 | summarize count()'), ORG)})"


def query_statistics(spark, d):
    ast = parse("logs | where status >= 500 | window 72h")
    return rows.statistics(_logs(spark, d), ast, ORG, NOW).select("scanned_rows", "matched_rows")


_STATISTICS = f"""SELECT count(*) AS scanned_rows, count(*) FILTER (regexp_matches("http.status_code", '^[0-9]+$') AND try_cast("http.status_code" AS BIGINT) >= 500) AS matched_rows FROM ({LOGS}) WHERE "timestamp" >= TIMESTAMP '2024-01-28'"""


def raw_candidate(spark, d):
    """The same query on records flattened from batches as on the projection."""
    scopes = spark.createDataFrame([("source-a", "org-a", "p", "e", "s")], "source_id string, organization_id string, project_id string, environment_id string, service_id string")
    raw = ingest.flatten(_batches(spark, d), scopes)
    return comparable(rows.ranked(rows.run(raw, parse(_RAW), ORG, NOW)))


_RAW = "metrics | where value >= 100 | window 480h | summarize count(), max(value) by name"


def _pairs() -> dict[str, tuple]:
    b = lambda text: query_sql(parse(text), ORG)
    return {
        "logroll_build": (logroll_build, _LOGROLL), "logroll_merge": (logroll_merge, _LOGROLL), "logroll_query": (_by_rollup(B1), b(B1)), "logroll_partial_boundary": (_by_rollup(PARTIAL), b(PARTIAL)),
        "logroll_eligibility": (logroll_eligibility, _ELIGIBILITY), "metroll_build": (metroll_build, _METROLL),
        "metroll_merge": (metroll_merge, f"SELECT name, count(*) AS samples, round(sum(value), 6) AS sum_value, min(value) AS value_min, max(value) AS value_max, count(*) AS counted FROM ({METRICS}) GROUP BY name"),
        "metroll_query": (_by_rollup(B3), b(B3)), "metroll_hist": (metroll_hist, f"SELECT name, {HISTOGRAM} AS bucket, count(*) AS n FROM ({METRICS}) GROUP BY ALL"), "metroll_pct": (metroll_pct, _METROLL_PCT),
        "metroll_last": (metroll_last, _METROLL_LAST), "rollup_vs_row_diff": (rollup_vs_row_diff, "SELECT '' AS query, '' AS row WHERE false"),
        "explain": (explain, _EXPLAIN), "builder": (builder, _BUILDER), "flatten_batches": (flatten_batches, _FLATTEN), "validate_records": (validate_records, _VALIDATE), "distinct_keys": (distinct_keys, _DISTINCT_KEYS),
        "stream_gaps": (stream_gaps, _GAPS), "stream_admission": (stream_admission, _ADMISSION), "replay_dedup": (replay_dedup, _REPLAY), "field_stats": (field_stats, _FIELD_STATS), "infer_type": (infer_type, _INFER),
        "widen_type": (widen_type, _WIDEN), "typed_index": (typed_index, _TYPED_INDEX), "promoted_filter": (promoted_filter, _PROMOTED), "deny_keys": (deny_keys, _DENY), "auto_sequence": (auto_sequence, _AUTO),
        "raw_segments": (raw_segments, _RAW_SEGMENTS), "cold_scan": (cold_scan, _COLD_SQL), "alert_evaluations": (alert_evaluations, _alert_sql()),
        "json_lines_web": (json_lines_web, _WEB), "json_lines_requestlog": (json_lines_requestlog, _REQUESTS), "json_lines_deployments": (json_lines_deployments, _DEPLOYS), "json_lines_problems": (json_lines_problems, _PROBLEMS),
        "otlp_json_logs": (otlp_json_logs, _OTLP_LOGS), "otlp_json_metrics": (otlp_json_metrics, _OTLP_METRICS), "otlp_json_traces": (otlp_json_traces, _OTLP_TRACES),
        "retention_survivors": (retention_survivors, _RETENTION), "retention_rollups": (retention_rollups, _RETENTION_ROLLUPS), "segments_to_cold": (segments_to_cold, _TO_COLD), "hot_cold_union": (hot_cold_union, b(_HOT_COLD)),
        "tiered_rows": (tiered_rows, _TIERED), "projection_lag": (projection_lag, _LAG), "fair_pending": (fair_pending, _FAIR), "quota_check": (quota_check, _QUOTA), "organizations_union": (organizations_union, _ORGANIZATIONS),
        "incident_consecutive": (incident_consecutive, f'WITH {_RUNS} SELECT rule_id, "at", rows, matched, run FROM r'), "incidents": (incidents, _INCIDENTS), "incident_fold": (incident_fold, _FOLD), "incident_order": (incident_order, _INCIDENT_ORDER),
        "batch_rule": (batch_rule, _BATCH_RULE), "batch_rule_error": (batch_rule_error, "SELECT 'error' AS state, 0::BIGINT AS matches"), "transition_gaps": (transition_gaps, _TRANSITIONS),
        "chart_points": (chart_points, _CHART_SQL), "stat_cell": (stat_cell, _STAT), "query_statistics": (query_statistics, _STATISTICS), "raw_candidate": (raw_candidate, b(_RAW)),
    }


def queries() -> dict:
    return {name: q for name, (q, _) in _pairs().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _pairs().items()}
