"""Exact percentiles with and without the split of a group's values, against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from beamlog.operators import query as q

PLAIN = {0: ("count", None), 1: ("avg", "v"), 2: ("min", "v"), 3: ("max", "w"), 4: ("sum", "w")}
SHARES = {5: ("v", 0.5), 6: ("v", 0.99), 7: ("w", 0.95)}


def nearest(values, share):
    values = sorted(v for v in values if v is not None)
    return values[math.ceil(share * len(values)) - 1] if values else None


@pytest.mark.parametrize("split", [False, True])
def test_equals_sorted_lists(spark, split):
    rng = random.Random(6)
    value = lambda: rng.choice([None, 0.0, -0.0, rng.gauss(0, 1e-9), rng.gauss(0, 1e12), float(rng.randint(-3, 3)), 1.7e18 + rng.randint(0, 10**6), rng.random()])
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 1), value(), value()) for _ in range(3_000)] + [("none", 0, None, None), ("one", 1, 5.0, None)] + [("same", 0, 2.5, -2.5)] * 9
    df = spark.createDataFrame(rows, "g string, k int, v double, w double").repartition(5)
    got = q.with_percentiles(df, ["g", "k"], PLAIN, SHARES, split)
    groups = {}
    for g, k, v, w in rows:
        groups.setdefault((g, k), []).append((v, w))
    assert got.count() == len(groups)
    for r in got.collect():
        v, w = zip(*groups[r.g, r.k])
        some = [x for x in v if x is not None]
        assert r._a0 == len(v) and r._a2 == min(some, default=None) and r._a3 == max((x for x in w if x is not None), default=None)
        assert (r._a1 is None) == (not some) and (not some or math.isclose(r._a1, sum(some) / len(some), rel_tol=1e-9, abs_tol=1e-3))
        assert (r._a5, r._a6, r._a7) == (nearest(v, 0.5), nearest(v, 0.99), nearest(w, 0.95))


def test_a_hot_group_is_dealt_to_many_tasks(spark):
    """One group of 1,000,000 distinct values: no task of the ordered parts sees more than a small share of them."""
    rows = spark.range(1_000_000, numPartitions=8).select(F.lit("hot").alias("g"), (F.pmod(F.col("id") * 7_919, F.lit(1_000_003)) + F.lit(0.5)).alias("v"))
    got = q.with_percentiles(rows, ["g"], {0: ("count", None)}, {1: ("v", 0.5), 2: ("v", 0.95), 3: ("v", 0.99)}, True)
    values = sorted((i * 7_919 % 1_000_003) + 0.5 for i in range(1_000_000))
    r = got.first()
    assert (r._a0, r._a1, r._a2, r._a3) == (1_000_000, *(values[math.ceil(s * 10**6) - 1] for s in (0.5, 0.95, 0.99)))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") >= 3  # over magnitudes, slices, and the values of one slice
    near = rows.select((F.floor((F.col("v") - 0.5) / 1_000_002 * q.SLICES)).alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert near < 1_000


def test_the_plan_splits_large_inputs_only(spark, monkeypatch):
    from beamlog.plans.language import parse
    from beamlog.queries import ORG
    from beamlog.sources.adapters import NOW, observations

    from .oracle_tools import SF_DIR
    logs = observations(spark, SF_DIR, "logs")
    text = "logs | summarize count(), avg(duration), p50(duration), p95(duration), p99(status) by route | limit 100"
    small = sorted(map(str, q.run(logs, parse(text), ORG, NOW).rows.collect()))
    monkeypatch.setattr(q, "SPLIT_BYTES", 0)
    large = q.run(logs, parse(text), ORG, NOW).rows
    assert sorted(map(str, large.collect())) == small and "_slice" in large._jdf.queryExecution().optimizedPlan().toString()


def test_large_inputs_are_read_twice_at_most(spark, monkeypatch):
    """Once for the percentiles, whose steps share one shuffle, and once for the plain aggregates."""
    from beamlog.plans.language import parse
    from beamlog.queries import ORG
    from beamlog.sources.adapters import NOW, observations

    from .oracle_tools import SF_DIR
    monkeypatch.setattr(q, "SPLIT_BYTES", 0)
    context, logs = spark.sparkContext, observations(spark, SF_DIR, "logs")
    for text, times in (("logs | summarize p95(duration), p50(duration) by route", 1), ("logs | summarize count(), avg(status), p50(status)", 2)):
        tag = f"reads-{times}"
        context.addJobTag(tag)
        try:
            q.run(logs, parse(text), ORG, NOW).rows.collect()
        finally:
            context.removeJobTag(tag)
        context._jsc.sc().listenerBus().waitUntilEmpty()
        assert q.read_so_far(context, tag)[0] <= times * spark.read.parquet(f"{SF_DIR}/events.parquet").count()
