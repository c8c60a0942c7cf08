"""The driver's tables as observations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import OBSERVATION

#: Queries over these tables look back from here.
NOW = datetime(2024, 1, 31)


def _identity(user: Column, row: Column) -> dict[str, Column]:
    return {
        "organization_id": F.lit("org-a"),
        "project_id": F.concat(F.lit("project-"), F.pmod(user, F.lit(4)).cast("string")),
        "environment_id": F.lit("production"),
        "service_id": F.concat(F.lit("service-"), F.pmod(user, F.lit(3)).cast("string")),
        "source_id": F.lit("source-a"),
        "stream_id": F.concat(F.lit("stream-"), F.pmod(user, F.lit(8)).cast("string")),
        "sequence": F.floor(row / 500) + 1,
        "record_index": F.pmod(row, F.lit(500)).cast("int"),
    }


def _observed(df: DataFrame, signal: str, identity: dict[str, Column], values: dict[str, Column], attributes, of: Column | None = None) -> DataFrame:
    """``attributes`` makes the attributes of ``of``, which is worked out once a row wherever the optimizer puts the map.

    A column of ``df`` that has the name of a field is given with the table's: in a function it would be the field.
    """
    entries = lambda x: F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in attributes(x).items()]), lambda e: e["v"].isNotNull())
    every = identity | {"signal": F.lit(signal), "attributes": F.element_at(F.transform(F.array(F.lit(None) if of is None else of), lambda x: F.map_from_entries(entries(x))), 1)} | values
    return df.select(*[every.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATION])


def utc(column: str) -> Column:
    """A zone-less timestamp, read as UTC whatever the session's zone."""
    whole = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))
    return F.timestamp_micros(whole * 1_000_000 + F.floor(F.extract(F.lit("SECOND"), F.col(column)) * 1_000_000).cast("bigint") % 1_000_000)


def _k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def event_logs(events: DataFrame) -> DataFrame:
    return _observed(events.alias("event"), "logs", _identity(F.col("user_id"), F.col("event_id")), {
        "timestamp": utc("ts"), "name": F.lit("http.server.request"),
        "severity": F.when(F.col("event_type") == "error", "error").otherwise("information"),
        "trace_id": F.lpad(F.lower(F.hex("event_id")), 32, "0"),
    }, lambda k: {
        # A few rows have no route, an empty one, or a status or duration that is not a number.
        "http.route": F.when(k % 10 == 7, None).when(k % 10 == 8, "").otherwise(F.concat(F.lit("/"), F.col("event_type"))),
        "http.status_code": F.when(k == 99, "not-a-number").when(k == 98, "500suffix").otherwise((F.lit(200) + 4 * k).cast("string")),
        "duration_ns": F.when(k == 97, "invalid").otherwise(F.round(F.col("event.value") * 1_000_000).cast("bigint").cast("string")),
        "user.id": F.col("user_id").cast("string"),
        "cached": F.when(k % 3 == 0, "true").when(k % 3 == 1, "F").otherwise("yes"),
    }, _k())


def event_metrics(events: DataFrame) -> DataFrame:
    return _observed(events, "metrics", _identity(F.col("user_id"), F.col("event_id")), {
        "timestamp": utc("ts"), "name": F.concat(F.lit("events."), F.col("event_type")), "value": F.col("value"),
    }, lambda _: {"state": F.col("event_type"), "user.id": F.col("user_id").cast("string")})


def lineitem_traces(lineitem: DataFrame) -> DataFrame:
    return _observed(lineitem, "traces", _identity(F.col("l_suppkey"), F.col("l_orderkey") * 8 + F.col("l_linenumber")), {
        "timestamp": utc("l_shipdate"), "name": F.lit("lineitem"), "value": F.col("l_quantity"),
        "trace_id": F.lpad(F.lower(F.hex("l_orderkey")), 32, "0"), "span_id": F.lpad(F.lower(F.hex(F.col("l_orderkey") * 8 + F.col("l_linenumber"))), 16, "0"),
    }, lambda _: {"returnflag": F.col("l_returnflag")})


def order_deployments(orders: DataFrame) -> DataFrame:
    return _observed(orders, "deployments", _identity(F.col("o_custkey"), F.col("o_orderkey")), {
        "timestamp": utc("o_orderdate"), "name": F.lit("deployment"), "correlation_id": F.col("o_orderkey").cast("string"),
    }, lambda _: {"deployment.outcome": F.col("o_orderstatus")})


def observations(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return {"logs": lambda: event_logs(read("events")), "metrics": lambda: event_metrics(read("events")),
            "traces": lambda: lineitem_traces(read("lineitem")), "deployments": lambda: order_deployments(read("orders"))}[signal]()
