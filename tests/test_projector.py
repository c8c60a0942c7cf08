import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from beamlog.operators import rollups
from beamlog.operators.query import run
from beamlog.plans.language import parse
from beamlog.sources.ingest import content_digest, flatten, numbered, read_batches
from beamlog.sources.segments import cold_observations, parsed_segments, raw_segments
from beamlog.streaming.projector import Projection, tailed_lines, tumbling

from .test_engine import NOW, ORG, batch

SCOPE_ROW = ("src", "o", "p", "e", "s")
SCOPES = "source_id string, organization_id string, project_id string, environment_id string, service_id string"


class Feed:
    """Batches as files, drained into a projection."""

    def __init__(self, spark, folder, automatic=False, scopes=(SCOPE_ROW,)):
        self.spark, self.folder, self.automatic, self.n = spark, folder, automatic, 0
        (folder / "in").mkdir()
        self.known(scopes)

    def known(self, scopes):
        self.projection = Projection(self.spark, str(self.folder / "out"), self.spark.createDataFrame(list(scopes), SCOPES), now=NOW)

    def take(self, *batches):
        self.n += 1
        (self.folder / "in" / f"{self.n}.json").write_text("\n".join(map(json.dumps, batches)))
        self.projection.start(str(self.folder / "in"), str(self.folder / "check"), automatic=self.automatic).awaitTermination(300)
        return self

    def problems(self):
        return sorted((r["stream_id"], r["sequence"], r["problem"]) for r in self.projection.problems().collect())


def test_gap_conflict_and_older_replay_are_told_and_not_taken(spark, tmp_path):
    feed = Feed(spark, tmp_path).take(batch("a", 1, [NOW]), batch("a", 2, [NOW]), batch("a", 9, [NOW]), batch("b", 2, [NOW]))
    assert feed.problems() == [("a", 9, "gap"), ("b", 2, "gap")] and feed.projection.ledger().count() == 2
    feed.take(batch("a", 2, [NOW], name="other"), batch("a", 1, [NOW], name="other"), batch("a", 1, [NOW]), batch("a", 3, [NOW]))
    assert feed.problems()[:2] == [("a", 1, "older_replay"), ("a", 2, "conflict")] and feed.projection.ledger().count() == 3
    assert {r["name"] for r in feed.projection.observations().collect()} == {"request"} and feed.projection.observations().count() == 3


def test_unknown_source_may_come_again(spark, tmp_path):
    feed = Feed(spark, tmp_path, scopes=[("other", "o", "p", "e", "s")]).take(batch("a", 1, [NOW]))
    assert feed.problems() == [("a", 1, "unknown_source")] and feed.projection.ledger().count() == 0
    feed.known([SCOPE_ROW])
    assert feed.take(batch("a", 1, [NOW])).projection.observations().count() == 1


def test_dates_are_utc_days_whatever_the_session_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        feed = Feed(spark, tmp_path).take(batch("a", 1, [NOW - timedelta(hours=h) for h in (0, 7, 11, 13)]))
        count = lambda: run(feed.projection.observations(), parse("logs | window 8h | summarize count()"), ORG, NOW).rows.first()["count"]
        assert count() == 2
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        assert count() == 2 and {str(r["date"]) for r in feed.projection.observations().select("date").collect()} == {"2026-08-16", "2026-08-17"}
        assert feed.take(batch("a", 1, [NOW - timedelta(hours=h) for h in (0, 7, 11, 13)])).problems() == []  # the same digest in any zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_settling_twice_and_late_data_refresh_only_their_buckets(spark, tmp_path):
    feed = Feed(spark, tmp_path).take(batch("a", 1, [NOW, NOW - timedelta(hours=1)]))
    p = feed.projection
    again = read_batches(spark, str(tmp_path / "in"))
    p.settle(again, 0)
    assert p.observations().count() == 2 and p.ledger().count() == 1 and p.segments().count() == 1
    feed.take(batch("a", 2, [NOW - timedelta(hours=1)]), batch("m", 1, [NOW], signal="metrics", value=2.5))
    fresh, kept = rollups.log_rollup(p.observations()), p.rollup("log").drop("date")
    rows = lambda df: sorted(map(str, df.select(sorted(fresh.columns)).collect()))
    assert rows(kept) == rows(fresh) and sorted(r["observation_count"] for r in kept.collect()) == [1, 2]
    assert [r["value_sum"] for r in p.rollup("metric").collect()] == [2.5]


def test_automatic_numbers(spark, tmp_path):
    plain = lambda n, *times: {k: v for k, v in batch("a", 0, times, name=f"n{n}").items() if k != "sequence"}
    feed = Feed(spark, tmp_path, automatic=True).take(plain(1, NOW - timedelta(minutes=5)), plain(2, NOW))
    assert sorted(r["sequence"] for r in feed.projection.ledger().collect()) == [1, 2]
    feed.take(plain(2, NOW), plain(3, NOW + timedelta(minutes=1)))  # the last one again, and one more
    assert sorted(r["sequence"] for r in feed.projection.ledger().collect()) == [1, 2, 3] and feed.problems() == []
    marks = spark.createDataFrame([], "source_id string, stream_id string, sequence long, content_digest string")
    assert numbered(read_batches(spark, str(tmp_path / "in")).limit(0), marks).count() == 0


def test_rebuild_and_recovery_from_raw_segments(spark, tmp_path):
    feed = Feed(spark, tmp_path).take(batch("a", 1, [NOW, NOW]), batch("a", 2, [NOW]))
    p = feed.projection
    p.rebuild("v1")
    assert p.version() == "v1" and p.observations().count() == 3 and p.rollup("log").agg(F.sum("observation_count")).first()[0] == 3
    # A run that broke after its raw segments: the ledger does not know them.
    lost = tmp_path / "lost.json"
    lost.write_text(json.dumps(batch("a", 3, [NOW])))
    p._write(raw_segments(read_batches(spark, str(lost))), str(tmp_path / "out" / "segments"))
    assert p.recover(7) == 1 and p.observations().count() == 4 and p.ledger().count() == 3 and p.recover(8) == 0 and p.segments().count() == 3


def test_retention_deletes_whole_days_only(spark, tmp_path):
    from beamlog.operators.lifecycle import Retention
    p = Feed(spark, tmp_path).take(batch("a", 1, [NOW, NOW - timedelta(days=10), NOW - timedelta(days=11)])).projection
    gone = p.retain(Retention(logs=10, traces=10, metrics=5, cold=400, rollups=300, evidence=30))
    assert [g.split("/")[-1] for g in gone] == ["date=2026-08-06"] and p.observations().count() == 2 and p.rollup("log").count() == 3
    with pytest.raises(ValueError):
        Retention(logs=10).changed(Retention(logs=11))
    assert Retention(logs=10).changed(Retention(logs=11), approved=True).logs == 11 and Retention(logs=10).changed(Retention(logs=9)).logs == 9


def test_segments_go_cold_and_are_read_beside_hot_rows(spark, tmp_path):
    from beamlog.operators.lifecycle import Retention
    from beamlog.operators.query import since
    p = Feed(spark, tmp_path).take(batch("a", 1, [NOW - timedelta(days=12), NOW - timedelta(days=11)]), batch("a", 2, [NOW])).projection
    policy = Retention(logs=10, traces=10, metrics=5, cold=400, rollups=300, evidence=30)
    assert p.age(policy) == 1 and p.age(policy) == 0 and len(p.retain(policy)) == 2
    count = lambda text, cold: rollups.answer(p.observations(), parse(text), ORG, NOW, cold=cold).rows.collect()[0]["count"]
    whole = "logs | window 720h | summarize count()"
    assert count(whole, None) == 1 and count(whole, p.cold("logs", "o", since(NOW, 720 * 3600 * 10**9))) == 3
    assert p.cold("logs", "o", since(NOW, 3600 * 10**9)).count() == 0 and p.cold("logs", "x").count() == 0


def test_addresses_and_alias_collisions(spark):
    from beamlog.sources.collectors import plain_address
    from beamlog.sources.ingest import admissible
    texts = ["10.0.0.1", "010.0.0.1", "2001:0DB8::0:1", "fe80::1%eth0", "x", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(plain_address("t")).collect()]
    assert got == ["10.0.0.1", None, "2001:db8::1", None, None, None]
    both = {"route": "/a", "http.route": "/b"}
    df = spark.read.schema(batch_schema()).json(spark.sparkContext.parallelize([json.dumps(batch("a", 1, [NOW], signal="metrics", value=1.0, attributes=both)), json.dumps(batch("b", 1, [NOW], attributes=both)), json.dumps(batch("c", 1, [NOW], signal="metrics", value=1.0, attributes={"route": "/a"}))]))
    assert {r["stream_id"]: r["problem"] for r in admissible(df, NOW).collect()} == {"a": "aliases", "b": None, "c": None}
    rows = flatten(df.where("stream_id = 'c'"))
    assert [r["attributes"] for r in rollups.metric_rollup(rows).collect()] == [{"http.route": "/a"}]


def batch_schema():
    from beamlog.model import BATCH
    return BATCH


def test_segments_are_checked_and_cold_ones_are_read_by_catalogue(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, (batch("a", 1, [NOW.replace(microsecond=123456)]), batch("a", 2, [NOW - timedelta(days=40)])))))
    batches = read_batches(spark, str(tmp_path))
    segments = raw_segments(batches).cache()
    good, bad = parsed_segments(segments)
    assert sorted(map(str, good.collect())) == sorted(map(str, batches.collect())) and bad.count() == 0
    broken = segments.withColumn("content", F.when(F.col("sequence") == 1, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    good, bad = parsed_segments(broken)
    assert [r["sequence"] for r in good.collect()] == [2] and [r["sequence"] for r in bad.collect()] == [1]
    catalogue = segments.select("digest", "signal", "last_observed", F.lit("cold").alias("tier"), F.lit("o").alias("organization_id"))
    scopes = spark.createDataFrame([SCOPE_ROW], SCOPES)
    read = lambda since: cold_observations(segments, catalogue, scopes, "logs", "o", since).count()
    assert read(None) == 2 and read(F.lit((NOW - timedelta(days=30)).isoformat() + "Z").cast("timestamp")) == 1
    assert batches.select(content_digest()).distinct().count() == 2


def test_streams_of_lines_and_tumbling_counts(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    lines = tailed_lines(spark, str(tmp_path / "lines"))
    sink = lambda df, mode: df.writeStream.format("memory").queryName("tailed" if mode == "append" else "tumbled").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{mode}")).trigger(availableNow=True).start()
    (tmp_path / "lines" / "1.log").write_text("a\n{broken\n")
    sink(lines, "append").awaitTermination(120)
    assert sorted(r["line"] for r in spark.table("tailed").collect()) == ["a", "{broken"]
    events = lines.select(F.lit(NOW.isoformat() + "Z").cast("timestamp").alias("timestamp"), F.col("line").alias("name"))
    sink(tumbling(events), "complete").awaitTermination(120)
    assert {(r["name"], r["rows"]) for r in spark.table("tumbled").collect()} == {("a", 1), ("{broken", 1)}


@pytest.mark.parametrize("text,kept", [("é" * 10, "éé"), ("abcde", "abcd" + "e"), ("", "")])
def test_byte_cut_is_whole_characters(spark, text, kept):
    from beamlog.functions.typed import cut_bytes
    assert spark.createDataFrame([(text,)], "t string").select(cut_bytes(F.col("t"), 5)).first()[0] == kept


def test_rows_of_one_source_do_not_meet_in_a_task(spark):
    """The scope is looked up without a shuffle by source, of which there may be one alone."""
    from beamlog import model as m
    scopes = spark.createDataFrame([("s", "org", "p", "e", "v")], "source_id string, organization_id string, project_id string, environment_id string, service_id string")
    text = F.concat(F.lit('{"source_id": "s", "records": [{"name": "n"}], "sequence": '), F.col("id").cast("string"), F.lit("}"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with batches and scopes of unknown size
    try:
        rows = flatten(spark.range(4).select(F.from_json(text, m.BATCH).alias("b")).select("b.*"), scopes)
        assert "hashpartitioning(source_id" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((r.sequence, r.organization_id) for r in rows.collect()) == [(k, "org") for k in range(4)]


def test_a_pass_reads_only_slices_that_it_takes_from(spark, tmp_path, monkeypatch):
    from beamlog.streaming import projector
    monkeypatch.setattr(projector, "SLICE", 4)
    (tmp_path / "in.json").write_text("\n".join(json.dumps(batch("a", k + 1, [NOW], name=f"n{k}")) for k in range(40)))
    p = Projection(spark, str(tmp_path / "out"), spark.createDataFrame([SCOPE_ROW], SCOPES), now=NOW, limits=projector.Limits(20, 1 << 40, 20))
    p.settle(read_batches(spark, str(tmp_path / "in.json")), 0, passes=0)
    seen, parsed = [], projector.parsed_segments
    monkeypatch.setattr(projector, "parsed_segments", lambda segments: seen.append(len(segments.inputFiles())) or parsed(segments))
    while p.drain(1):
        pass
    assert len(seen) == 2 and max(seen) <= 8 and p.observations().count() == 40 and p.ledger().count() == 40 and not p._there("queue/n-1")


def test_rollup_parts_of_segments_equal_those_of_rows(spark, tmp_path):
    from beamlog.sources.adapters import observations
    key = ["source_id", "stream_id", "sequence"]
    some = observations(spark, "/root/testdata/sf0.001", "metrics").withColumns({
        "timestamp": F.date_trunc("minute", F.col("timestamp")), "attributes": F.when(F.pmod("record_index", F.lit(3)) == 0, F.create_map(F.lit("route"), F.lit("/a"), F.lit("status"), F.lit("2x"))).otherwise(F.col("attributes")),
        "value": F.when(F.pmod("record_index", F.lit(7)) == 0, 0.0).otherwise(F.round("value")), "project_id": F.lit("p"), "service_id": F.lit("s"), "stream_id": F.lit("one")})
    many = some.withColumn("timestamp", F.date_trunc("day", F.col("timestamp")))  # groups of many rows at one time: the latest position is the last value
    for rows in (some, many):
        old, new = rollups.metric_rollup(rows, None, key), rollups.segment_metric_rollup(rows, None, key)
        assert old.columns == new.columns and old.dtypes == new.dtypes
        text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*df.columns))).collect())
        assert text(old) == text(new)
    assert many.count() > new.count()
    many.write.parquet(str(tmp_path / "rows"))
    plan = rollups.segment_metric_rollup(spark.read.parquet(str(tmp_path / "rows")).repartition(*key), None, key)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan


def test_a_deliverys_content_is_not_held_in_memory(spark, tmp_path, monkeypatch):
    """At the end of admission everything that a micro-batch keeps is there; a batch that comes twice in it is taken once."""
    held, sliced = [], Projection._sliced

    def seen(self, raw, number):
        got = sliced(self, raw, number)
        held.append(sum(i.memSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
        return got

    monkeypatch.setattr(Projection, "_sliced", seen)
    sent = [batch("a", n, [NOW] * 200, name=f"request-{n}") for n in range(1, 41)]
    feed = Feed(spark, tmp_path).take(*sent, sent[0])
    assert feed.projection.observations().count() == 8_000 and feed.projection.ledger().count() == 40 and not feed.problems()
    content = feed.projection.segments().agg(F.sum("bytes")).first()[0]
    assert len(held) == 1 and held[0] < content / 5
