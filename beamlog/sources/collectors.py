"""Line formats that agents collect: web-server access logs, application request logs, deployment events."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.typed import cut_bytes, moment, number, whole

MAX_LINE = 1 << 20
# Bytes that are kept of long texts.
MAX_URL, MAX_AGENT = 4_096, 1_024
# Keys a deployment event may have.
DEPLOYMENT_KEYS = ("operation_id", "artifact", "commit", "version", "phase", "duration_ms", "outcome", "slot", "service", "timestamp")


def _get(path: str) -> Column:
    return F.get_json_object("line", path)


def _attributes(values: dict[str, Column]) -> Column:
    """Present values only."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def _nanos(seconds: Column) -> Column:
    return (number(seconds) * 1_000_000_000).cast("bigint")


def _path(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def _plain_address(text: str | None) -> str | None:
    try:
        return None if text is None or "%" in text else ipaddress.ip_address(text).compressed
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def plain_address(texts: pd.Series) -> pd.Series:
    """IP addresses in their usual short form; null for what is none, or has a zone."""
    return texts.map(_plain_address, na_action="ignore")


def _status(text: Column) -> Column:
    return F.when(whole(text).between(100, 999), whole(text))


def web_access(lines: DataFrame, sensitive: frozenset[str] = frozenset()) -> DataFrame:
    """JSON access-log lines (column line) as log records with only listed fields; lines that do not parse are left out.

    Times are seconds since 1970. ``sensitive`` opts in to client_ip, query, referrer and user_agent.
    """
    uri = _get("$.request.uri")
    at = number(_get("$.ts"))
    extra = {"client_ip": ("client.address", plain_address(_get("$.request.remote_ip"))), "query": ("http.query", cut_bytes(F.nullif(F.regexp_extract(uri, "[?]([^#]*)", 1), F.lit("")), MAX_URL)),
             "referrer": ("http.referrer", cut_bytes(_get("$.request.headers.Referer[0]"), MAX_URL)), "user_agent": ("http.user_agent", cut_bytes(_get("$.request.headers.User-Agent[0]"), MAX_AGENT))}
    attributes = _attributes({
        "http.method": _get("$.request.method"), "http.path": cut_bytes(_path(uri), MAX_URL), "http.status_code": _status(_get("$.status")), "http.response_bytes": whole(_get("$.size")),
        "duration_ns": _nanos(_get("$.duration")), "request.id": _get("$.request.headers.X-Request-Id[0]"), **{name: value for k, (name, value) in extra.items() if k in sensitive}})
    rows = lines.where((F.octet_length("line") <= MAX_LINE) & at.isNotNull() & F.coalesce(_status(_get("$.status")).isNotNull(), F.lit(False)))
    return rows.select(F.timestamp_micros((at * 1_000_000).cast("bigint")).alias("timestamp"), F.lit("web.http.request").alias("name"),
                       F.when(_status(_get("$.status")) >= 500, "error").otherwise("information").alias("severity"), attributes.alias("attributes"))


def request_log(lines: DataFrame, sensitive: frozenset[str] = frozenset()) -> DataFrame:
    """Application request lines; the time is the first of observed_at, timestamp and time that parses."""
    at = F.coalesce(*[moment(_get(f"$.{k}")) for k in ("observed_at", "timestamp", "time")])
    status = _status(_get("$.status"))
    attributes = _attributes({
        "http.method": _get("$.method"), "http.route": _get("$.route"), "http.status_code": status, "http.response_bytes": whole(_get("$.response_bytes")),
        "duration_ns": F.coalesce(whole(_get("$.duration_ns")), (number(_get("$.duration_ms")) * 1_000_000).cast("bigint")), "auth.outcome": _get("$.auth_outcome"), "request.id": _get("$.request_id"),
        **({"session.id": _get("$.session_id")} if "session_id" in sensitive else {}), **({"client.address": plain_address(_get("$.client_ip"))} if "client_ip" in sensitive else {})})
    return lines.where((F.octet_length("line") <= MAX_LINE) & at.isNotNull()).select(
        at.alias("timestamp"), F.lit("application.http.request").alias("name"), F.when(status >= 500, "error").otherwise("information").alias("severity"), attributes.alias("attributes"))


def deployment_events(lines: DataFrame) -> DataFrame:
    """Deployment lines; a line with a key that is not listed is left out."""
    keys = F.json_object_keys("line")
    strict = F.size(F.array_except(keys, F.array(*[F.lit(k) for k in DEPLOYMENT_KEYS]))) == 0
    at = moment(_get("$.timestamp"))
    names = {f"deployment.{k}": _get(f"$.{k}") for k in DEPLOYMENT_KEYS if k not in ("service", "timestamp")}
    attributes = _attributes({**names, "service.name": _get("$.service")})
    return lines.where(F.coalesce(strict, F.lit(False)) & at.isNotNull() & _get("$.operation_id").isNotNull()).select(
        at.alias("timestamp"), F.lit("deployment").alias("name"), _get("$.operation_id").alias("correlation_id"), attributes.alias("attributes"))


def line_problems(lines: DataFrame) -> DataFrame:
    """Counts of lines that are too long, not JSON objects, or fine."""
    kind = F.when(F.octet_length("line") > MAX_LINE, "oversized").when(F.json_object_keys("line").isNull(), "malformed").otherwise("fine")
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("lines"))
