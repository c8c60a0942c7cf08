"""Queries for what runs as a stream: the projector, its rollups, rebuilds and recovery; tailed files, incidents, tumbling counts; and budgets that act while a query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .operator_queries import _INCIDENTS, _LOGROLL, FIVE, LOGS, METRICS, _batches, _evaluations, _logs, _metrics, _scratch
from .operators import query as rows
from .oracle import bucket_sql
from .plans.language import parse
from .plans.planner import Budget, BudgetError, plan
from .queries import ORG, comparable
from .sources import collectors
from .sources.adapters import NOW, observations
from .sources.segments import raw_segments
from .sources.tail import TailSource
from .streaming.projector import PARTITIONS, Limits, Projection, stream_incidents, tumbling

SCOPES = "source_id string, organization_id string, project_id string, environment_id string, service_id string"
WIDE = Limits(10_000, 1 << 40, 10_000)


def _projection(spark, name: str) -> Projection:
    scopes = spark.createDataFrame([("source-a", "org-a", "project", "production", "service")], SCOPES)
    return Projection(spark, _scratch(spark, name), scopes, now=NOW, limits=WIDE)


def _deliveries(batches: DataFrame, count: int) -> list[DataFrame]:
    """Batches in so many deliveries, the numbers of every stream in order."""
    top = batches.agg(F.max("sequence")).first()[0] or 0
    cuts = [-(-k * top // count) for k in range(count + 1)]
    return [batches.where((F.col("sequence") > a) & (F.col("sequence") <= b)) for a, b in zip(cuts, cuts[1:])]


#: Batches are sent with times to the microsecond, which Spark's JSON writer cuts to the millisecond unless told.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _settled(spark, batches: DataFrame, name: str) -> Projection:
    """Two deliveries, of which the first comes again between them."""
    projection = _projection(spark, name)
    first, second = _deliveries(batches, 2)
    for epoch, part in enumerate((first, first, second)):
        projection.settle(part, epoch)
    return projection


def streamed_projection(spark, d) -> DataFrame:
    """Batches as files, a stream that stops and goes on, and one that delivers the first half again: every row once, no problem is told."""
    projection = _projection(spark, "streamed")
    incoming, again = f"{projection.root}-incoming", f"{projection.root}-again"
    parts = _deliveries(_batches(spark, d), 2)
    for part in parts:
        part.write.mode("append").option("timestampFormat", MICROS).json(incoming)
        projection.start(incoming, f"{projection.root}-check", files_per_trigger=1_000).awaitTermination()
    parts[0].write.option("timestampFormat", MICROS).json(again)
    projection.start(again, f"{projection.root}-check-again", files_per_trigger=1_000).awaitTermination()
    got = projection.observations().groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"), F.max("timestamp").alias("latest"))
    ledger = projection.ledger().groupBy("stream_id").agg(F.count(F.lit(1)).alias("segments"), F.max("sequence").alias("last_sequence"))
    problems = projection.problems().groupBy("stream_id").agg(F.count(F.lit(1)).alias("problems"))
    return comparable(got.join(ledger, "stream_id").join(problems, "stream_id", "left").na.fill(0, ["problems"]))


_STREAMED = f"""SELECT stream_id, count(*) AS n, round(sum(value), 6) AS sum_value, max("timestamp") AS latest, count(DISTINCT sequence) AS segments, max(sequence) AS last_sequence, 0::BIGINT AS problems
FROM ({METRICS}) GROUP BY stream_id"""


def streamed_log_rollup(spark, d) -> DataFrame:
    """Parts of the log rollup, one set a segment, merged as they are read: rows that came late are in their own buckets."""
    got = _settled(spark, _batches(spark, d, _logs(spark, d), "logs"), "log-rollup").rollup("log").drop("date")
    return comparable(got.groupBy("bucket_start", "status", "route", "route_present").agg(F.sum("observation_count").alias("observation_count"), F.sum("scanned_bytes").alias("scanned_bytes")))


_STREAMED_LOGROLL = f"""SELECT bucket_start, status, route, route_present, sum(observation_count)::BIGINT AS observation_count, sum(scanned_bytes)::BIGINT AS scanned_bytes FROM ({_LOGROLL}) GROUP BY ALL"""


def streamed_metric_rollup(spark, d) -> DataFrame:
    got = _settled(spark, _batches(spark, d), "metric-rollup").rollup("metric")
    return comparable(got.groupBy("bucket_start", "name").agg(F.sum("sample_count").alias("samples"), F.sum("value_sum").alias("sum_value"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.max("last_timestamp").alias("last_timestamp")))


_STREAMED_METROLL = f"""SELECT {bucket_sql(FIVE)} AS bucket_start, name, count(*) AS samples, round(sum(value), 6) AS sum_value, min(value) AS value_min, max(value) AS value_max, max("timestamp") AS last_timestamp FROM ({METRICS}) GROUP BY ALL"""


def rebuilt_and_recovered(spark, d) -> DataFrame:
    """A rebuild during which a delivery arrives, then a recovery of raw segments that a broken run has left: rows and rollups have all of them once."""
    projection = _projection(spark, "rebuilt")
    first, second, third = _deliveries(_batches(spark, d), 3)
    projection.settle(first, 0)
    started = projection.begin_rebuild("v1")
    projection.settle(second, 1)
    projection.finish_rebuild(started)
    raw_segments(third).write.mode("append").partitionBy(*PARTITIONS).parquet(f"{projection.root}/segments")  # and no ledger entry
    projection.recover(2)
    rolled = projection.rollup("metric").groupBy("name").agg(F.sum("sample_count").alias("rolled"))
    got = projection.observations().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum_value"))
    return comparable(got.join(rolled, "name").withColumn("version", F.lit(projection.version())))


_REBUILT = f"SELECT name, count(*) AS n, round(sum(value), 6) AS sum_value, count(*) AS rolled, 'v1' AS version FROM ({METRICS}) GROUP BY name"


def tailed_requests(spark, d) -> DataFrame:
    """Request lines appended to log files in two goes, tailed by a stream that stops in between, read as observations.

    A file that is tailed lies on the machine or on a mounted share; other file systems are refused.
    """
    root = _scratch(spark, "tailed")
    scheme, _, folder = root.rpartition("://")
    if scheme not in ("", "file"):
        raise ValueError("tailed files need a mounted folder")
    spark.dataSource.register(TailSource)
    logs = _logs(spark, d).select("timestamp", "record_index", F.to_json(F.struct(
        F.date_format(F.to_utc_timestamp("timestamp", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.try_element_at("attributes", F.lit("http.route")).alias("route"),
        (F.lit(200) + F.col("record_index")).alias("status"))).alias("value"))
    for half in (0, 1):
        logs.where(F.col("record_index") % 2 == half).select("value").write.mode("append").text(f"{root}/log")
        query = spark.readStream.format("tail").option("path", f"{folder}/log/*.txt").load().writeStream.format("parquet").option("checkpointLocation", f"{root}/check").option("path", f"{root}/lines").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    lines = spark.read.parquet(f"{root}/lines")
    got = collectors.request_log(lines.where("problem is null").select("line"))
    return comparable(got.groupBy("severity", F.try_element_at("attributes", F.lit("http.route")).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")))


_TAILED = f"""SELECT CASE WHEN record_index >= 300 THEN 'error' ELSE 'information' END AS severity, "http.route" AS route, count(*) AS n, date_trunc('second', min("timestamp")) AS first_at, date_trunc('second', max("timestamp")) AS last_at
FROM ({LOGS}) GROUP BY ALL"""


def streamed_incidents(spark, d) -> DataFrame:
    """Events of incidents whose states live from one run of a stream to the next."""
    root = _scratch(spark, "incidents")
    every = _evaluations(spark, d).select("rule_id", F.col("at").cast("timestamp").alias("at"), "rows")
    middle = F.lit("2024-01-16").cast("timestamp_ntz").cast("timestamp")
    for part in (every.where(F.col("at") < middle), every.where(F.col("at") >= middle)):
        part.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(every.schema).parquet(f"{root}/in")
        stream_incidents(stream, 2, 3).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{root}/out")
    return got.select("rule_id", "number", F.col("at").cast("timestamp_ntz").alias("at"), "event")


_STREAMED_INCIDENTS = f"""WITH i AS ({_INCIDENTS}) SELECT rule_id, number, opened_at AS "at", 'opened' AS event FROM i UNION ALL SELECT rule_id, number, fired_at, 'promoted' FROM i WHERE fired_at IS NOT NULL
UNION ALL SELECT rule_id, number, resolved_at, 'resolved' FROM i WHERE resolved_at IS NOT NULL"""


def streamed_counts(spark, d) -> DataFrame:
    """Five-minute counts of a stream of rows that is stopped once; rows of the second half fall into buckets of the first."""
    root = _scratch(spark, "counts")
    logs = _metrics(spark, d).select("timestamp", "name", "record_index")
    for half in (0, 1):
        logs.where(F.col("record_index") % 2 == half).write.mode("append").parquet(f"{root}/in")
        counts = tumbling(spark.readStream.schema(logs.schema).parquet(f"{root}/in"))
        counts.writeStream.outputMode("complete").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{root}/out")).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return comparable(spark.read.parquet(f"{root}/out"))


_COUNTS = f'SELECT {bucket_sql(FIVE)} AS bucket_start, name, count(*) AS rows FROM ({METRICS}) GROUP BY ALL'


#: Texts, and the bytes that a run of each may read.
ASKED = {"errors": ("logs | where status >= 500 | window 72h | limit 100", 1 << 40), "routes": ("logs | where status >= 500 | summarize count() by route | limit 3", 1 << 40),
         "all_fit": ("metrics | summarize count() by name | limit 1000", 1 << 40), "too_large": ("logs | sort duration desc | limit 10", 1 << 10)}


def budget_answers(spark, d) -> DataFrame:
    """What queries under a budget return: rows, whether the limit cut any, rows that passed the filters; or that they were stopped."""
    told = []
    for name, (text, most) in ASKED.items():
        ast = parse(text)
        planned = plan(ast, ORG, rollups=False, budget=Budget(seconds=3_600, scanned_bytes=most))
        try:
            got = rows.answer_within(rows.run(observations(spark, d, ast.signal), ast, ORG, NOW, planned=planned, seen=Observation(name)))
            told.append((name, "answered", len(got.rows), got.truncated, got.matched_rows))
        except BudgetError:
            told.append((name, "stopped", None, None, None))
    return spark.createDataFrame(told, "name string, outcome string, returned long, truncated boolean, matched_rows long")


_WRONG = """regexp_matches("http.status_code", '^[0-9]+$') AND try_cast("http.status_code" AS BIGINT) >= 500"""
_ANSWERS = f"""WITH o AS ({LOGS}), e AS (SELECT 'errors' AS name, count(*) AS matched_rows, count(*) AS rows, 100 AS most FROM o WHERE {_WRONG} AND "timestamp" >= TIMESTAMP '2024-01-28'
UNION ALL SELECT 'routes', count(*), count(DISTINCT coalesce('x' || "http.route", '')), 3 FROM o WHERE {_WRONG} UNION ALL SELECT 'all_fit', count(*), count(DISTINCT event_type), 1000 FROM events)
SELECT name, 'answered' AS outcome, least(rows, most)::BIGINT AS returned, rows > most AS truncated, matched_rows FROM e UNION ALL SELECT 'too_large', 'stopped', NULL, NULL, NULL"""


def _pairs() -> dict[str, tuple]:
    return {
        "streamed_projection": (streamed_projection, _STREAMED), "streamed_log_rollup": (streamed_log_rollup, _STREAMED_LOGROLL), "streamed_metric_rollup": (streamed_metric_rollup, _STREAMED_METROLL),
        "rebuilt_and_recovered": (rebuilt_and_recovered, _REBUILT), "tailed_requests": (tailed_requests, _TAILED), "streamed_incidents": (streamed_incidents, _STREAMED_INCIDENTS),
        "streamed_counts": (streamed_counts, _COUNTS), "budget_answers": (budget_answers, _ANSWERS),
    }


def queries() -> dict:
    return {name: q for name, (q, _) in _pairs().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _pairs().items()}
