import random

import pytest

from beamlog import operator_queries, queries, streaming_queries
from beamlog.operators.query import ranked, run
from beamlog.oracle import query_sql
from beamlog.plans.language import Aggregate, Filter, Query, Sort, Summary, validate
from beamlog.queries import REVIEWED, comparable
from beamlog.plans.planner import Scope
from beamlog.sources.adapters import NOW, observations

from .oracle_tools import SF_DIR, database, rows_of, rows_of_sql

KNOWN = queries.queries() | operator_queries.queries() | streaming_queries.queries()
SQL = queries.oracle_sql() | operator_queries.oracle_sql() | streaming_queries.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database()


def test_every_query_has_sql():
    assert set(KNOWN) == set(SQL)


@pytest.mark.parametrize("name", sorted(KNOWN))
def test_query_equals_sql(spark, con, name):
    assert rows_of(KNOWN[name](spark, SF_DIR)) == rows_of_sql(con, SQL[name])


FIELDS = {"logs": ["route", "status", "duration", "severity", "name", "user.id", "cached", "project", "trace_id", "nowhere"], "metrics": ["value", "name", "state", "service"]}
NUMBERS = {"logs": ["status", "duration", "user.id"], "metrics": ["value"]}


def random_query(rng: random.Random) -> Query:
    signal = rng.choice(["logs", "metrics"])
    value = {"status": lambda: str(rng.randint(190, 610)), "duration": lambda: f"{rng.random() * 5e8:.3f}", "user.id": lambda: str(rng.randint(0, 120)), "cached": lambda: rng.choice(["true", "F"]),
             "value": lambda: f"{rng.random() * 300:.2f}", "route": lambda: rng.choice(["/click", "", "/view"]), "state": lambda: "error", "severity": lambda: "error"}
    filters = []
    for _ in range(rng.randint(0, 3)):
        f = rng.choice(FIELDS[signal])
        filters.append(Filter(f, rng.choice(["==", "!="] if f == "cached" else ["!=", ">=", "<=", "==", ">", "<"]), value.get(f, lambda: "x1")()))
    summary = sort = None
    if rng.random() < 0.6:
        made = {a.alias: a for a in [Aggregate("count") if rng.random() < 0.4 else Aggregate(rng.choice(["min", "max", "sum", "avg", "p50", "p95", "p99"]), rng.choice(NUMBERS[signal])) for _ in range(rng.randint(1, 3))]}
        groups = tuple(rng.sample([f for f in FIELDS[signal] if f not in ("duration", "value", "trace_id")], rng.randint(0, 2)))
        summary = Summary(tuple(made.values()), groups, rng.choice([0, 0, 3600, 7 * 86400, 2100]) * 10**9)
        columns = [*made, *groups, *(["window_start"] if summary.bucket else [])]
        sort = Sort(rng.choice(columns), rng.random() < 0.5) if rng.random() < 0.5 else None
    elif rng.random() < 0.6:
        sort = Sort(rng.choice(FIELDS[signal]), rng.random() < 0.5)
    query = Query(signal, tuple(filters), sort, summary, rng.randint(1, 1000), rng.choice([0, 0, 3600 * 200]) * 10**9)
    validate(query)
    return query


@pytest.mark.parametrize("seed", range(25))
def test_random_query_equals_sql(spark, con, seed):
    rng = random.Random(seed)
    query, scope = random_query(rng), rng.choice([Scope("org-a"), Scope("org-a", "project-2")])
    got = comparable(ranked(run(observations(spark, SF_DIR, query.signal), query, scope, NOW, REVIEWED, sensitive=True)))
    assert rows_of(got) == rows_of_sql(con, query_sql(query, scope, registry=REVIEWED))
