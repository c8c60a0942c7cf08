"""Registered queries over the driver's tables, each with SQL where SQL can say it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import query as rows
from .oracle import query_sql
from .plans.fields import BOOLEAN, Descriptor, Registry
from .plans.language import parse
from .plans.planner import Scope
from .sources.adapters import NOW, observations

ORG = Scope("org-a")
PROJECT = Scope("org-a", "project-1", service="service-1")
REVIEWED = Registry({("logs", "cached"): Descriptor("cached", BOOLEAN, "internal", "low", "exact"), ("logs", "user.id"): Descriptor("user.id", "integer", "internal", "high", "range")}, 2)

TEXTS: dict[str, tuple[str, Scope, Registry]] = {
    "scan_logs": ("logs | limit 1000", ORG, Registry()),
    "scan_metrics": ("metrics | limit 500", ORG, Registry()),
    "scan_traces": ("traces | limit 500", ORG, Registry()),
    "scan_deployments": ("deployments | limit 500", ORG, Registry()),
    "scope_project": ("logs | summarize count() by project, service", PROJECT, Registry()),
    "window_lookback": ("logs | window 72h | limit 1000", ORG, Registry()),
    "where_eq": ('logs | where route == "/click" | sort duration desc | limit 200', ORG, Registry()),
    "where_ne_missing": ('logs | where route != "/click" | summarize count() by route', ORG, Registry()),
    "where_empty_attribute": ('logs | where route == "" | summarize count() by route', ORG, Registry()),
    "where_gt": ("logs | where status > 400 | summarize count() by status | limit 500", ORG, Registry()),
    "where_ge": ("logs | where status >= 500 | summarize count() by status | limit 500", ORG, Registry()),
    "where_lt": ("metrics | where value < 10.5 | sort value asc | limit 300", ORG, Registry()),
    "where_le": ("logs | where duration <= 1000000 | sort duration asc | limit 300", ORG, Registry()),
    "where_regex": ('logs | where route =~ "^/(c\\u007cs)[a-z]+" | summarize count() by route', ORG, Registry()),
    "where_regex_severity": ("logs | where severity =~ err | summarize count() by severity", ORG, Registry()),
    "where_time": ("logs | where timestamp >= 2024-01-15T12:00:00Z | where timestamp < 2024-01-16T00:00:00.5+00:00 | limit 500", ORG, Registry()),
    "where_two_filters": ('logs | where status >= 300 | where severity == error | summarize count(), max(status) by route', ORG, Registry()),
    "where_boolean": ("logs | where cached == true | summarize count() by cached", ORG, REVIEWED),
    "where_reviewed_integer": ("logs | where user.id <= 25 | summarize count() by user.id | limit 200", ORG, REVIEWED),
    "invalid_values_ignored": ("logs | summarize count(), min(status), max(status), min(duration), max(duration)", ORG, Registry()),
    "default_order_rank": ("traces | limit 1000", ORG, Registry()),
    "sort_desc_nulls_last": ("logs | sort status desc | limit 1000", ORG, Registry()),
    "sort_asc_ties": ("logs | sort severity asc | limit 400", ORG, Registry()),
    "sort_last_wins": ("logs | limit 5 | sort status asc | sort duration desc | limit 50", ORG, Registry()),
    "sort_boolean": ("logs | sort cached asc | limit 400", ORG, REVIEWED),
    "match_trace_id": ('logs | where trace_id == "000000000000000000000000000000ff" | limit 10', ORG, Registry()),
    "sum_count": ("logs | summarize count() by severity", ORG, Registry()),
    "sum_min": ("metrics | summarize min(value) by name", ORG, Registry()),
    "sum_max": ("metrics | summarize max(value) by name", ORG, Registry()),
    "sum_sum": ("metrics | summarize sum(value) by name", ORG, Registry()),
    "sum_avg": ("metrics | summarize avg(value) by name", ORG, Registry()),
    "sum_p50": ("metrics | summarize p50(value) by name", ORG, Registry()),
    "sum_p95": ("logs | summarize p95(duration) by route", ORG, Registry()),
    "sum_p99": ("traces | summarize p99(value) by returnflag", ORG, Registry({("traces", "returnflag"): Descriptor("returnflag", "string", "internal", "low")})),
    "sum_multi_agg": ("metrics | summarize count(), min(value), max(value), sum(value), avg(value), p50(value), p95(value), p99(value) by name, state", ORG, Registry()),
    "sum_group_two": ("logs | summarize count() by route, status | sort count desc | limit 1000", ORG, Registry()),
    "sum_null_group": ("logs | summarize count() by status | sort status asc | limit 1000", ORG, Registry()),
    "sum_bucket_5m": ("logs | window 48h | summarize count() by route, window(5m) | limit 1000", ORG, Registry()),
    "sum_bucket_168h": ("metrics | summarize count(), p95(value) by name, window(168h)", ORG, Registry()),
    "sum_bucket_35m": ("metrics | summarize count() by window(35m) | sort window_start asc | limit 1000", ORG, Registry()),
    "sum_empty": ("logs | where status == 999 | summarize count(), sum(status)", ORG, Registry()),
    "sum_no_group": ("logs | where status >= 200 | summarize count(), avg(status), p50(status)", ORG, Registry()),
    "sum_no_usable_value": ("logs | summarize count(), sum(status), min(status), avg(status), p95(status) by status | sort status asc | limit 1000", ORG, Registry()),
    "sum_sort_limit": ("logs | where status >= 500 | summarize count() by route, window(1h) | sort count desc | limit 50", ORG, Registry()),
    "sum_group_order": ("logs | summarize count() by service, route, severity", ORG, Registry()),
    "min_slice": ("logs | where status >= 500 | window 720h | summarize count(), p95(duration) by route, window(1h) | sort count desc | limit 50", ORG, Registry()),
    "overview_logs": ("logs | window 1h | limit 20", ORG, Registry()),
    "overview_metrics": ("metrics | window 1h | limit 20", ORG, Registry()),
    "overview_traces": ("traces | window 1h | limit 20", ORG, Registry()),
    "overview_deployments": ("deployments | window 1h | limit 20", ORG, Registry()),
}

#: Traces and deployments of the tables are older: their overviews look back from here.
OLD = datetime(1996, 3, 1)
NOWS = {"overview_traces": OLD, "overview_deployments": OLD}


def comparable(df: DataFrame) -> DataFrame:
    """Timestamps without zone, sums and averages to 6 places, percentile and extreme values as doubles."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() == "timestamp":
            c = F.to_timestamp_ntz(F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        elif f.name.split("_")[0] in ("sum", "avg"):
            c = F.round(c, 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def run_text(name: str):
    def query(spark, sf_dir: str) -> DataFrame:
        text, scope, registry = TEXTS[name]
        ast = parse(text)
        return comparable(rows.ranked(rows.run(observations(spark, sf_dir, ast.signal), ast, scope, NOWS.get(name, NOW), registry, sensitive=True)))

    return query


def queries() -> dict:
    return {name: run_text(name) for name in TEXTS}


def oracle_sql() -> dict[str, str]:
    return {name: query_sql(parse(text), scope, str(NOWS.get(name, NOW)), registry) for name, (text, scope, registry) in TEXTS.items()}
