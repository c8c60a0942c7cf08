"""Queries as DuckDB SQL, written apart from the Spark path so that the two can be held against each other."""

from __future__ import annotations

from .functions.typed import FALSE, MOMENT, NUMBER, TRUE, WHOLE, YEAR_ONE
from .model import SIGNALS
from .plans.fields import BOOLEAN, CORE, INTEGER, NUMERIC, STRING, TIME, Registry, canonical
from .plans.language import Query
from .plans.planner import Scope, literal, result_columns

_PROPS = "CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS INTEGER)"
_TABLES = {
    "logs": (f"(SELECT *, {_PROPS} AS k, user_id AS who, event_id AS line FROM events)", {
        "timestamp": "ts", "name": "'http.server.request'", "severity": "CASE WHEN event_type = 'error' THEN 'error' ELSE 'information' END", "trace_id": "lpad(lower(to_hex(event_id)), 32, '0')",
        "http.route": "CASE WHEN k % 10 = 7 THEN NULL WHEN k % 10 = 8 THEN '' ELSE '/' || event_type END",
        "http.status_code": "CASE WHEN k = 99 THEN 'not-a-number' WHEN k = 98 THEN '500suffix' ELSE CAST(200 + 4 * k AS VARCHAR) END",
        "duration_ns": "CASE WHEN k = 97 THEN 'invalid' ELSE CAST(CAST(round(value * 1000000) AS BIGINT) AS VARCHAR) END",
        "user.id": "CAST(user_id AS VARCHAR)", "cached": "CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'F' ELSE 'yes' END"}),
    "metrics": ("(SELECT *, user_id AS who, event_id AS line FROM events)", {
        "timestamp": "ts", "name": "'events.' || event_type", "value": "value", "state": "event_type", "user.id": "CAST(user_id AS VARCHAR)"}),
    "traces": ("(SELECT *, l_suppkey AS who, l_orderkey * 8 + l_linenumber AS line FROM lineitem)", {
        "timestamp": "l_shipdate", "name": "'lineitem'", "value": "l_quantity", "trace_id": "lpad(lower(to_hex(l_orderkey)), 32, '0')", "span_id": "lpad(lower(to_hex(line)), 16, '0')", "returnflag": "l_returnflag"}),
    "deployments": ("(SELECT *, o_custkey AS who, o_orderkey AS line FROM orders)", {
        "timestamp": "o_orderdate", "name": "'deployment'", "correlation_id": "CAST(o_orderkey AS VARCHAR)", "deployment.outcome": "o_orderstatus"}),
}


def observations_sql(signal: str) -> str:
    """The adapter's rows with one text column per field, named by the field."""
    table, fields = _TABLES[signal]
    columns = ", ".join(f"{e} AS \"{f}\"" for f, e in fields.items())
    return (f"SELECT 'org-a' AS organization_id, 'project-' || (who % 4) AS project_id, 'production' AS environment_id, 'service-' || (who % 3) AS service_id, "
            f"'source-a' AS source_id, 'stream-' || (who % 8) AS stream_id, line // 500 + 1 AS sequence, CAST(line % 500 AS INTEGER) AS record_index, {columns} FROM {table}")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def field_sql(signal: str, name: str, registry: Registry) -> str:
    name = canonical(name)
    d = registry.describe(signal, name)
    if name in CORE and CORE[name] not in _TABLES[signal][1] and CORE[name].endswith("_id") and name not in ("trace_id", "span_id", "correlation_id"):
        raw = f"nullif({CORE[name]}, '')"
    elif name not in _TABLES[signal][1]:
        return "CAST(NULL AS DOUBLE)" if d.type in NUMERIC else "CAST(NULL AS VARCHAR)"
    elif name in ("timestamp", "value"):
        return f'"{name}"'
    else:
        raw = f'nullif("{name}", \'\')' if name in CORE else f'"{name}"'
    if d.type == STRING:
        return raw
    if d.type == INTEGER:
        return f"CASE WHEN regexp_matches({raw}, '{WHOLE}') THEN try_cast({raw} AS BIGINT) END"
    if d.type == BOOLEAN:
        inside = lambda xs: ", ".join(_quote(x) for x in xs)
        return f"CASE WHEN {raw} IN ({inside(TRUE)}) THEN true WHEN {raw} IN ({inside(FALSE)}) THEN false END"
    if d.type == TIME:
        return f"CASE WHEN regexp_matches({raw}, '{MOMENT}') THEN try_cast({raw} AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END"
    return f"CASE WHEN regexp_matches({raw}, '{NUMBER}') AND isfinite(try_cast({raw} AS DOUBLE)) THEN try_cast({raw} AS DOUBLE) END"


def filter_sql(query: Query, registry: Registry) -> list[str]:
    out = []
    for f in query.filters:
        d, value = registry.describe(query.signal, f.field), field_sql(query.signal, f.field, registry)
        wanted = literal(d, f.op, f.value)
        if f.op == "=~":
            out.append(f"regexp_matches({value}, {_quote(wanted)})")
            continue
        shown = _quote(wanted) if isinstance(wanted, str) else f"TIMESTAMP '{wanted:%Y-%m-%d %H:%M:%S.%f}'" if d.type == TIME else f"CAST({wanted!r} AS DOUBLE)" if isinstance(wanted, float) else str(wanted).lower()
        out.append(f"{value} {'=' if f.op == '==' else f.op} {shown}")
    return out


def bucket_sql(nanos: int, column: str = '"timestamp"') -> str:
    width = nanos // 1_000
    return f"make_timestamp(epoch_us({column}) - ((epoch_us({column}) + {YEAR_ONE * 1_000_000 % width}) % {width} + {width}) % {width})"


def query_sql(query: Query, scope: Scope, now: str = "2024-01-31 00:00:00", registry: Registry | None = None, source: str | None = None) -> str:
    """Result rows with a rank column, dots in names as underscores; doubles of sums and averages to 6 places."""
    registry = registry or Registry()
    assert query.signal in SIGNALS
    where = [f"{c} = {_quote(v)}" for c, v in scope.parts()] + filter_sql(query, registry)
    if query.window:
        where.append(f"\"timestamp\" >= TIMESTAMP '{now}' - INTERVAL {query.window // 1_000} MICROSECONDS")
    head = f"WITH o AS ({source or observations_sql(query.signal)}), f AS (SELECT * FROM o WHERE {' AND '.join(where)})"
    columns = result_columns(query)
    flat = {c: c.replace(".", "_") for c in columns}
    if s := query.summary:
        keys = {**({"window_start": bucket_sql(s.bucket)} if s.bucket else {}), **{canonical(g): field_sql(query.signal, g, registry) for g in s.groups}}
        made = {}
        for a in s.aggregates:
            v = field_sql(query.signal, a.field, registry) if a.field else ""
            made[a.alias] = {"count": "count(*)", "min": f"min({v})", "max": f"max({v})", "sum": f"round(CAST(sum({v}) AS DOUBLE), 6)", "avg": f"round(avg({v}), 6)",
                             "p50": f"quantile_disc({v}, 0.5)", "p95": f"quantile_disc({v}, 0.95)", "p99": f"quantile_disc({v}, 0.99)"}[a.function]
            if a.function not in ("count", "sum", "avg"):
                made[a.alias] = f"CAST({made[a.alias]} AS DOUBLE)"
        body = "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in {**keys, **made}.items()) + " FROM f" + (f" GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}" if keys else " HAVING count(*) > 0")
        sized = lambda c: f"CASE WHEN \"{c}\" IS NULL THEN '-1:' ELSE octet_length(encode(CAST(\"{c}\" AS VARCHAR))) || ':' || CAST(\"{c}\" AS VARCHAR) END"
        ties = " || ".join(sized(c) for c in keys) or "''"
    else:
        body = "SELECT " + ", ".join(f'{field_sql(query.signal, c, registry)} AS "{c}"' for c in columns) + ', "timestamp" AS _t, source_id, stream_id, sequence, record_index FROM f'
        ties = "_t DESC, source_id, stream_id, sequence DESC, record_index"
    order = ties
    if query.sort:
        name = query.sort.field if query.sort.field in columns else canonical(query.sort.field)
        order = f'"{name}" {"DESC" if query.sort.descending else "ASC"} NULLS LAST, {ties}'
    shown = ", ".join(f'"{c}" AS "{flat[c]}"' for c in columns)
    return f"{head}, r AS ({body}), n AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM r) SELECT rank, {shown} FROM n WHERE rank <= {query.limit}"
