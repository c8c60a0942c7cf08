"""Rows counted once through moves, retention and rebuilds; bounded micro-batches; fair passes; policies and quotas."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from beamlog.operators import rollups
from beamlog.operators.lifecycle import Retention
from beamlog.operators.query import run
from beamlog.plans.fields import Descriptor
from beamlog.plans.language import parse
from beamlog.sources.ingest import read_batches
from beamlog.streaming.projector import Limits, Projection

from .test_engine import NOW, ORG, batch

SCOPES = "source_id string, organization_id string, project_id string, environment_id string, service_id string"
KEEP = Retention(logs=10, traces=10, metrics=5, cold=400, rollups=300, evidence=30)


def made(spark, folder, organizations=("o",), **more):
    scopes = spark.createDataFrame([("src" if o == "o" else f"src-{o}", o, "p", "e", "s") for o in organizations], SCOPES)
    return Projection(spark, str(folder / "out"), scopes, now=NOW, **more)


def settled(spark, p, folder, epoch, *batches, passes=None):
    (folder / f"e{epoch}").mkdir()
    (folder / f"e{epoch}" / "x.json").write_text("\n".join(map(json.dumps, batches)))
    p.settle(read_batches(spark, str(folder / f"e{epoch}")), epoch, passes=passes)


def times(p, organization="o"):
    """Every row that hot and cold reads give together, by its time."""
    hot = p.observations().where(F.col("organization_id") == organization).select("timestamp", F.lit("hot").alias("tier"))
    both = hot.unionByName(p.cold("logs", organization).select("timestamp", F.lit("cold").alias("tier")))
    return sorted((str(NOW - r["timestamp"].replace(tzinfo=None)), r["tier"]) for r in both.collect())


def test_each_row_once_between_moves_retention_and_rebuild(spark, tmp_path):
    p = made(spark, tmp_path)
    old, edge, young = timedelta(days=12), timedelta(days=10, minutes=5), timedelta(hours=1)
    settled(spark, p, tmp_path, 0, batch("a", 1, [NOW - old, NOW - edge]), batch("a", 2, [NOW - old, NOW - young]), batch("a", 3, [NOW - young]))
    ages = sorted(map(str, (old, edge, old, young, young)))
    assert [t for t, _ in times(p)] == ages and {k for _, k in times(p)} == {"hot"}
    assert p.age(KEEP) == 1
    assert [t for t, _ in times(p)] == ages and sum(k == "cold" for _, k in times(p)) == 2  # the edge's day is hot still, its segment is not
    p.retain(KEEP)
    assert [t for t, _ in times(p)] == ages and sum(k == "cold" for _, k in times(p)) == 3  # with the expired row of a hot segment
    counts = lambda: p.rollup("log").agg(F.sum("observation_count")).first()[0]
    assert counts() == 5
    p.rebuild("v1")
    assert [t for t, _ in times(p)] == ages and sum(k == "cold" for _, k in times(p)) == 3 and counts() == 5 and p.version() == "v1"
    p.retain(KEEP)
    assert [t for t, _ in times(p)] == ages and counts() == 5
    with pytest.raises(ValueError):
        p.rebuild("v1")


def test_a_move_that_is_cut_off(spark, tmp_path):
    p = made(spark, tmp_path)
    settled(spark, p, tmp_path, 0, batch("a", 1, [NOW - timedelta(days=12)]), batch("a", 2, [NOW]))
    first = p.catalogue().where("sequence = 1").select("source_id", "stream_id", "sequence", "digest")
    p._mark(first.withColumn("tier", F.lit("archiving")))
    assert [k for _, k in times(p)] == ["hot", "hot"] and p.segments().count() == 2
    assert p.age(KEEP) == 0 and sorted(k for _, k in times(p)) == ["cold", "hot"]  # finished by the next run
    assert p.segments().count() == 2 and p.finish_archiving() == 0
    p.purge()
    assert p.segments().count() == 2 and len(times(p)) == 2
    gone = made(spark, tmp_path, policies=spark.createDataFrame([("o", 11, True)], "organization_id string, cold int, delete_cold_raw boolean"))
    before = gone.usage().first()["bytes"]
    assert gone.age(KEEP) == 1 and [k for _, k in times(gone)] == ["hot"] and gone.segments().count() == 1 and gone.usage().first()["bytes"] < before


def test_a_batch_in_the_middle_of_a_rebuild_is_not_lost(spark, tmp_path):
    p = made(spark, tmp_path, ("o", "q"))
    other = batch("a", 1, [NOW]) | {"source_id": "src-q"}
    settled(spark, p, tmp_path, 0, batch("a", 1, [NOW - timedelta(days=12)]), batch("a", 2, [NOW, NOW]), other)
    p.age(KEEP)
    started = p.begin_rebuild("v1", "o")
    settled(spark, p, tmp_path, 1, batch("a", 3, [NOW]), batch("a", 2, [NOW]) | {"source_id": "src-q"})
    assert p.version("o") == "v0" and p.observations().count() == 5
    p.finish_rebuild(started)
    assert (p.version("o"), p.version("q"), p.version()) == ("v1", "v0", "v0")
    assert len(times(p)) == 4 and sum(k == "cold" for _, k in times(p)) == 1 and len(times(p, "q")) == 2
    assert p.rollup("log").groupBy("organization_id").agg(F.sum("observation_count").alias("n")).orderBy("organization_id").collect() == [("o", 4), ("q", 2)]
    settled(spark, p, tmp_path, 2, batch("a", 4, [NOW]))
    assert len(times(p)) == 5 and p.rollup("log").agg(F.sum("observation_count")).first()[0] == 7
    late = p.begin_rebuild("v2", "o")
    p.rebuild("v3")
    with pytest.raises(RuntimeError):
        p.finish_rebuild(late)
    assert p.version("o") == "v3" and len(times(p)) == 5


def test_a_micro_batch_reads_no_file_of_earlier_ones(spark, tmp_path):
    p = made(spark, tmp_path)
    settled(spark, p, tmp_path, 0, batch("a", 1, [NOW - timedelta(hours=2)]), batch("m", 1, [NOW], signal="metrics", value=1.0))
    spoiled = {}
    for f in (tmp_path / "out").rglob("*.parquet"):
        if f.is_file() and "state" not in f.parts:
            spoiled[f] = f.read_bytes()
            f.write_bytes(b"not a file that can be read")
    settled(spark, p, tmp_path, 1, batch("a", 2, [NOW - timedelta(hours=2)]), batch("m", 2, [NOW], signal="metrics", value=4.0))
    for f, content in spoiled.items():
        assert f.read_bytes() == b"not a file that can be read"  # nothing was written anew either
        f.write_bytes(content)
    assert not list((tmp_path / "out" / "queue").iterdir())
    assert p.observations().count() == 4 and p.ledger().count() == 4
    assert [r["observation_count"] for r in p.rollup("log").collect()] == [2]
    assert [(r["value_sum"], r["last_value"], sum(r["histogram"].values())) for r in p.rollup("metric").collect()] == [(5.0, 4.0, 2)]
    fresh = rollups.metric_rollup(p.observations())
    assert sorted(map(str, p.rollup("metric").select(sorted(fresh.columns)).collect())) == sorted(map(str, fresh.select(sorted(fresh.columns)).collect()))


def test_a_step_that_broke_is_taken_again_without_doubles(spark, tmp_path, monkeypatch):
    p = made(spark, tmp_path)
    broken = batch("a", 1, [NOW]), batch("a", 2, [NOW])
    for where in ("_commit", "_append"):
        with monkeypatch.context() as m:
            m.setattr(Projection, where, lambda *a: (_ for _ in ()).throw(OSError("lost")))
            (tmp_path / "e0").mkdir(exist_ok=True)
            (tmp_path / "e0" / "x.json").write_text("\n".join(map(json.dumps, broken)))
            with pytest.raises(OSError):
                p.settle(read_batches(spark, str(tmp_path / "e0")), 0)
        if where == "_commit":
            assert p.ledger().count() == 0 and p._read("segments", p.segments().schema).count() == 2
    p.settle(read_batches(spark, str(tmp_path / "e0")), 0)
    assert p.observations().count() == 2 and p.ledger().count() == 2 and p.segments().count() == 2 and p.rollup("log").agg(F.sum("observation_count")).first()[0] == 2


def test_a_flooding_organization_does_not_delay_another(spark, tmp_path):
    p = made(spark, tmp_path, ("o", "q"), limits=Limits(segments=3, all_segments=5))
    settled(spark, p, tmp_path, 0, *[batch("a", i, [NOW]) for i in range(1, 11)], passes=0)
    settled(spark, p, tmp_path, 1, batch("a", 1, [NOW]) | {"source_id": "src-q"}, passes=1)
    by = lambda: {r["organization_id"]: r["count"] for r in p.observations().groupBy("organization_id").count().collect()}
    assert by() == {"o": 3, "q": 1} and p.backlog().count() == 7
    assert p.drain(1) == 3 and by() == {"o": 6, "q": 1} and p.drain() == 4 and p.backlog().count() == 0 and p.drain() == 0


def test_policies_and_quotas_of_organizations(spark, tmp_path):
    policies = spark.createDataFrame([("o", 20, None), ("q", None, 700)], "organization_id string, logs int, quota_bytes long")
    p = made(spark, tmp_path, ("o", "q"), policies=policies)
    other = lambda i, n=1: batch("a", i, [NOW - timedelta(days=12)] * n) | {"source_id": "src-q"}
    settled(spark, p, tmp_path, 0, batch("a", 1, [NOW - timedelta(days=12)]), other(1), other(2, 40))
    assert [(r["source_id"], r["sequence"], r["problem"]) for r in p.problems().collect()] == [("src-q", 2, "quota")]
    assert p.age(KEEP) == 1 and [k for _, k in times(p)] == ["hot"] and [k for _, k in times(p, "q")] == ["cold"]
    p.retain(KEEP)
    assert [k for _, k in times(p)] == ["hot"] and [k for _, k in times(p, "q")] == ["cold"]
    settled(spark, p, tmp_path, 1, other(1), other(2))  # the head again needs no room; a small batch fits
    assert p.problems().where("epoch = 1").count() == 0 and len(times(p, "q")) == 2


def test_activated_fields_are_stored_and_reach_the_files(spark, tmp_path):
    p = made(spark, tmp_path)
    item = lambda i, v, days=0: batch("a", i, [NOW - timedelta(days=days)], attributes={"items.count": v, "http.status_code": "500"})
    settled(spark, p, tmp_path, 0, item(1, "7", 12), item(2, "5"), item(3, "x"), item(4, "12"))
    p.activate("logs", [Descriptor("items.count", "integer", "internal", "high", "range"), Descriptor("label", "string", "internal", "low")], "v1")
    settled(spark, p, tmp_path, 1, item(5, "9"), item(6, ""))
    text = "logs | where items.count >= 6 | summarize count(), sum(items.count), max(items.count)"
    by_map = run(p.observations(), parse(text), ORG, NOW, p.registry)
    by_column = run(p.observations(), parse(text), ORG, NOW, p.registry_of("o"))
    assert by_map.rows.collect() == by_column.rows.collect() == [(3, 28.0, 12.0)]
    plan = by_column.rows._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = [line for line in plan.split("\n") if "PushedFilters" in line and "p_items_count" in line]
    assert pushed and "GreaterThanOrEqual(p_items_count" in pushed[0] and "attributes" not in plan.split("ReadSchema")[1].split("\n")[0]
    p.age(KEEP)
    p.retain(KEEP)
    cold = lambda: p.cold("logs", "o")
    both = [run(p.observations(), parse(text), ORG, NOW, r, cold=cold()).rows.collect() for r in (p.registry, p.registry_of("o"))]
    assert both[0] == both[1] == [(3, 28.0, 12.0)] and run(p.observations(), parse(text), ORG, NOW, p.registry_of("o")).rows.collect() == [(2, 21.0, 12.0)]
    p.activate("logs", [Descriptor("items.count", "float", "internal", "high", "range")], "v2")
    assert run(p.observations(), parse(text), ORG, NOW, p.registry_of("o"), cold=cold()).rows.collect() == [(3, 28.0, 12.0)]
    assert len([c for c in p.observations().columns if c.startswith("p_")]) == 2
