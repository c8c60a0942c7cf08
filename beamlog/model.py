"""The observation contract: signals, schemas and the bounds a batch must keep."""

from __future__ import annotations

from pyspark.sql import types as T

SIGNALS = ("logs", "metrics", "traces", "deployments")

RECORD = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
    T.StructField("correlation_id", T.StringType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
])

BATCH = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("observed_at", T.TimestampType()),
    T.StructField("signal", T.StringType()),
    T.StructField("records", T.ArrayType(RECORD)),
])

SCOPE = ("organization_id", "project_id", "environment_id", "service_id")
IDENTITY = ("source_id", "stream_id", "sequence", "record_index")

OBSERVATION = T.StructType([
    *[T.StructField(c, T.StringType()) for c in SCOPE],
    T.StructField("source_id", T.StringType()),
    T.StructField("stream_id", T.StringType()),
    T.StructField("sequence", T.LongType()),
    T.StructField("record_index", T.IntegerType()),
    T.StructField("signal", T.StringType()),
    *RECORD.fields,
])

# Bounds of records and batches. Sizes are bytes.
MAX_RECORDS = 5_000
MAX_BATCH_KEYS = 1_024
MAX_ATTRIBUTES = 64
MAX_NAME, MAX_SEVERITY, MAX_BODY, MAX_CORRELATION = 256, 64, 16_384, 128
MAX_KEY, MAX_VALUE = 128, 4_096
OLDEST_RECORD_DAYS, OLDEST_BATCH_DAYS, FUTURE_MINUTES = 400, 7, 10
MAX_METRIC = 1e25
MAX_METRIC_GROUPS = 1_024
IDENTIFIER = "^[A-Za-z0-9._-]{1,128}$"
