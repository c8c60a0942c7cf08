"""The projector: raw batch files in, raw segments, an idempotent projection and rollups out, by micro-batches.

There is no watermark: data up to 400 days late belongs in its own bucket. A micro-batch admits the batches it
brings, keeps them as raw segments and queues them; passes then project the queue, a fair share of every
organization at a time. What is not admitted is told in ``problems`` and may come again.

A micro-batch reads the state (a row a stream, an organization and a queued segment) and what it brings, never
what earlier ones have written: rows and rollup parts are only added. Rows leave the hot tier by segment: first
their raw content is copied, then one small file says that the segment is cold, and from then on hot reads leave
it out and cold reads take it in. Files go later, when no row in them is read any more.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType, TimestampType

from .. import model as m
from ..functions.typed import bucket_start, utc_date
from ..operators.lifecycle import Retention, effective, fair_pending, promoted_column, promoted_values, tiers
from ..operators.rollups import LOG_KEYS, METRIC_KEYS, WIDTH, log_rollup, merge_log_rollups, merge_metric_rollups, metric_rollup, segment_metric_rollup
from ..plans.fields import Descriptor, Registry
from ..sources.ingest import admissible, admit, batch_digest, content_digest, flatten, numbered
from ..sources.segments import cold_observations, parsed_segments, raw_segments

PARTITIONS = ["signal", "date"]
KEY = ["source_id", "stream_id", "sequence"]
STREAM = KEY[:2]
_TEXT, _LONG = T.StringType(), T.LongType()
_schema = lambda *pairs: StructType([StructField(n, k) for n, k in pairs])
_NUMBER = [(f.name, f.dataType) for f in m.OBSERVATION.fields if f.name in KEY]
LEDGER = _schema(*_NUMBER, ("digest", _TEXT), ("content_digest", _TEXT), ("epoch", _LONG))
PROBLEMS = _schema(*_NUMBER, ("digest", _TEXT), ("problem", _TEXT), ("epoch", _LONG))
#: What the projector keeps between micro-batches: stream heads, used bytes of organizations, and queued segments.
STATE = _schema(("kind", _TEXT), *_NUMBER, ("digest", _TEXT), ("content_digest", _TEXT), ("organization_id", _TEXT), ("bytes", _LONG), ("signal", _TEXT), ("date", T.DateType()), ("committed_at", TimestampType()), ("queued", _LONG), ("slice", _LONG))
_TIERS = _schema(*_NUMBER, ("digest", _TEXT), ("tier", _TEXT), ("at", _LONG))
_EXPIRED = _schema(("organization_id", _TEXT), ("signal", _TEXT), ("day", T.DateType()), ("at", _LONG))
_CURRENT = _schema(("organization_id", _TEXT), ("version", _TEXT), ("at", _LONG))
_LOADED = _schema(*_NUMBER, ("version", _TEXT))
_PROMOTED = _schema(("version", _TEXT), ("signal", _TEXT), ("field", _TEXT), ("type", _TEXT))
#: Segments of a slice of the queue: a folder of its own, in the order in which passes take them, so that a pass reads only slices it takes from.
SLICE = 512
#: Tables that have a delivery's content are kept on disk alone: several copies of it fill an executor's heap.
CONTENT = StorageLevel.DISK_ONLY
ROLLUPS = "rollups"  # the name under which the days of both rollups expire


@dataclass(frozen=True)
class Limits:
    """Of one pass: segments and bytes of an organization, and segments in all."""

    segments: int = 16
    bytes: int = 32 << 20
    all_segments: int = 128


@dataclass(frozen=True)
class Rebuild:
    """A rebuild under way: the new version, whose it is (None: everybody's), and the version that readers took before."""

    version: str
    organization: str | None
    before: str


class Projection:
    """Tables of one projection under ``root``; one driver at a time writes them.

    segments and cold: admitted batches as they came, by signal and UTC day of sending; observations by version,
    signal and UTC day; rollup parts, one set a segment, by version and day; a ledger of projected segments;
    problems by epoch; state snapshots. ``current`` names the version that readers take, for all or for one
    organization. ``policies`` (organization_id, and any of Retention's fields and quota_bytes) overrides defaults.
    """

    def __init__(self, spark: SparkSession, root: str, scopes: DataFrame, registry: Registry | None = None, now: datetime | None = None, policies: DataFrame | None = None, limits: Limits = Limits()):
        self.spark, self.root, self.scopes, self.registry, self.now, self.policies, self.limits = spark, root.rstrip("/"), scopes, registry or Registry(), now, policies, limits
        self._lock = threading.RLock()

    # Files

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def _read(self, name: str, schema: StructType) -> DataFrame:
        """A table as it is now; one that has not been written yet is empty."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if self._there(name) else self.spark.createDataFrame([], schema)

    def _append(self, rows: DataFrame, name: str) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    @staticmethod
    def _write(rows: DataFrame, path: str, by: list[str] = PARTITIONS) -> None:
        """Appends by partition; Spark splits a large one into several tasks and files."""
        rows.hint("rebalance", *[F.col(c) for c in by]).write.mode("append").partitionBy(*by).parquet(path)

    def _next(self, name: str, schema: StructType) -> int:
        return (self._read(name, schema).agg(F.max("at")).first()[0] or 0) + 1

    # State

    def _snapshot(self) -> int:
        """Number of the newest whole snapshot, 0 if there is none."""
        path, files = self._path("state")
        if not files.exists(path):
            return 0
        numbers = [int(f.getPath().getName().split("-")[1]) for f in files.listStatus(path) if f.getPath().getName().startswith("n-")]
        return max((n for n in numbers if self._there(f"state/n-{n}/_SUCCESS")), default=0)

    def state(self) -> DataFrame:
        n = self._snapshot()
        return self._read(f"state/n-{n}", STATE) if n else self.spark.createDataFrame([], STATE)

    def _commit(self, state: DataFrame) -> None:
        """The next snapshot, whole or not at all; older ones but the last go."""
        n = self._snapshot()
        state.select(*STATE.fieldNames()).hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/state/n-{n + 1}")
        for old in (f"state/n-{n - 1}", f"begun/admission-{n - 1}", f"begun/pass-{n - 1}"):
            path, files = self._path(old)
            files.delete(path, True)

    def _first_time(self, what: str) -> bool:
        """Whether this step begins for the first time; a step that a crash has cut off begins again."""
        path, files = self._path(f"begun/{what}")
        return bool(files.createNewFile(path))

    def watermarks(self) -> DataFrame:
        """Each stream's last number, with its digests."""
        return self.state().where("kind = 'head'").select(*KEY, "digest", "content_digest")

    def backlog(self) -> DataFrame:
        """Admitted segments that are not projected yet."""
        return self.state().where("kind = 'pending'").select(*KEY, "digest", "content_digest", "organization_id", "bytes", "signal", "date", "committed_at", "queued", "slice")

    def usage(self) -> DataFrame:
        """Bytes of raw segments that each organization has."""
        return self.state().where("kind = 'usage'").select("organization_id", "bytes")

    # Versions and tiers

    def version(self, organization: str | None = None) -> str:
        """The version that readers take: the last one that a rebuild of all, or of this organization, has finished."""
        whose = F.col("organization_id").isNull() if organization is None else F.col("organization_id").isNull() | (F.col("organization_id") == organization)
        rows = self._read("current", _CURRENT).where(whose).orderBy(F.col("at").desc()).head(1)
        return rows[0]["version"] if rows else "v0"

    def _versioned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``_version`` of their organization."""
        every = self._read("current", _CURRENT)
        whole = every.where("organization_id is null").agg(F.max(F.struct("at", "version"))).first()[0]
        since, version = (whole["at"], whole["version"]) if whole else (0, "v0")
        own = every.where(F.col("organization_id").isNotNull() & (F.col("at") > since)).groupBy("organization_id").agg(F.max_by("version", "at").alias("_own"))
        if not own.head(1):
            return rows.withColumn("_version", F.lit(version))
        return rows.join(own, "organization_id", "left").withColumn("_version", F.coalesce("_own", F.lit(version))).drop("_own")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of the version that their organization's readers take."""
        return self._versioned(rows).where("version = _version").drop("version", "_version")

    def tiers(self) -> DataFrame:
        """The tier of each segment that has ever left the hot one."""
        return self._read("tiers", _TIERS).groupBy(*KEY, "digest").agg(F.max_by("tier", "at").alias("tier"))

    def expired(self) -> DataFrame:
        """By organization and signal: the first day whose rows are hot."""
        return self._read("expired", _EXPIRED).groupBy("organization_id", "signal").agg(F.max("day").alias("day"))

    def _gone(self) -> DataFrame:
        return self.tiers().where("tier in ('cold', 'deleted')").select(*KEY)

    def _unexpired(self, rows: DataFrame, signal: Column | None = None) -> DataFrame:
        if not self._there("expired"):
            return rows
        days = self.expired().withColumnsRenamed({"signal": "_signal", "organization_id": "_organization"})
        on = (F.col("organization_id") == F.col("_organization")) & ((F.col("signal") if signal is None else signal) == F.col("_signal"))
        return rows.join(days, on, "left").where(F.col("day").isNull() | (F.col("date") >= F.col("day"))).drop("day", "_signal", "_organization")

    # Reads

    def observations(self) -> DataFrame:
        """Hot rows: those of hot segments, from the first hot day of their organization and signal on."""
        rows = self._live(self._all_rows())
        if self._there("tiers"):
            rows = rows.join(self._gone(), KEY, "left_anti")
        return self._unexpired(rows).select(*m.OBSERVATION.fieldNames(), *self._promoted(), "date")

    def _all_rows(self) -> DataFrame:
        plain = self.spark.createDataFrame([], m.OBSERVATION)
        return self._read("observations", StructType([*plain.withColumns(self._promoted()).schema.fields, StructField("version", _TEXT), StructField("date", T.DateType())]))

    def _promoted(self, version: str | None = None) -> dict[str, Column]:
        """Columns of promoted fields that any version, or this one, stores."""
        rows = self._read("promoted", _PROMOTED)
        rows = rows if version is None else rows.where(F.col("version") == version)
        return promoted_values([(r["signal"], r["field"], r["type"]) for r in rows.select("signal", "field", "type").distinct().collect()]) if self._there("promoted") else {}

    def registry_of(self, organization: str) -> Registry:
        """The registry with the columns that the organization's version stores whole: older versions' rows lack them."""
        rows = self._read("promoted", _PROMOTED).where(F.col("version") == self.version(organization)).collect()
        stored = {(r["signal"], r["field"]): promoted_column(r["field"], r["type"]) for r in rows}
        return replace(self.registry, columns={k: c for k, c in stored.items() if c == promoted_column(k[1], self.registry.describe(*k).type)})

    def activate(self, signal: str, descriptors: Iterable[Descriptor], version: str, organization: str | None = None) -> None:
        """Reviewed fields from now on; those with an index get typed columns in a new version of the rows."""
        self.registry = self.registry.activate(signal, list(descriptors))
        self.rebuild(version, organization)

    def segments(self) -> DataFrame:
        """Raw content of all segments that are kept: each where its tier says."""
        schema = raw_segments(self.spark.createDataFrame([], m.BATCH)).schema
        hot, moved = self._read("segments", schema), self.tiers()
        if not self._there("tiers"):
            return hot
        cold = self._read("cold", schema).join(moved.where("tier = 'cold'"), "digest", "left_semi")
        return hot.join(moved.where("tier in ('cold', 'deleted')"), "digest", "left_anti").unionByName(cold)

    def ledger(self) -> DataFrame:
        return self._read("ledger", LEDGER)

    def problems(self) -> DataFrame:
        return self._read("problems", PROBLEMS)

    def _parts(self, kind: str) -> DataFrame:
        empty = self.spark.createDataFrame([], m.OBSERVATION)
        made = log_rollup(empty, KEY) if kind == "log" else metric_rollup(empty, self.registry, KEY)
        return self._read(f"{kind}_rollup", StructType([*made.schema.fields, StructField("version", _TEXT), StructField("date", T.DateType())]))

    def rollup(self, kind: str) -> DataFrame:
        """``log`` or ``metric``: the parts of all segments as one, with the day of each bucket."""
        parts = self._unexpired(self._live(self._parts(kind)), F.lit(ROLLUPS))
        merged = merge_log_rollups(parts, ["date"]) if kind == "log" else merge_metric_rollups(parts, ["date"])
        return merged

    def catalogue(self) -> DataFrame:
        """What is known of each raw segment without its content: scope, span of time, whether it is projected, and its tier."""
        done = self.ledger().select("digest", F.lit(True).alias("projected")).distinct()
        facts = self.segments().select(*KEY, "digest", "signal", "records", "bytes", "first_observed", "last_observed").join(F.broadcast(self.scopes.select("source_id", "organization_id")), "source_id")
        return facts.join(self.tiers().select("digest", "tier"), "digest", "left").join(done, "digest", "left").withColumns({"tier": F.coalesce("tier", F.lit("hot")), "projected": F.coalesce("projected", F.lit(False))})

    def cold(self, signal: str, organization: str, since: Column | None = None) -> DataFrame:
        """What ``observations`` leaves out, of segments that a look-back may reach: rows of cold segments, and expired rows of hot ones."""
        segments, catalogue = self.segments(), self.catalogue()
        rows = cold_observations(segments, catalogue, self.scopes, signal, organization, since)
        days = self.expired().where((F.col("organization_id") == organization) & (F.col("signal") == signal)).select("day")
        if not (day := days.first()):
            return rows
        part = catalogue.where((F.col("tier") != "cold") & F.col("projected") & (utc_date(F.col("first_observed")) < F.lit(day[0]))).withColumn("tier", F.lit("cold"))
        early = cold_observations(segments, part, self.scopes, signal, organization, since).where(utc_date(F.col("timestamp")) < F.lit(day[0]))
        return rows.unionByName(early)

    # Admission

    def settle(self, batches: DataFrame, epoch: int, automatic: bool = False, passes: int | None = None) -> None:
        """One micro-batch: admission, then passes over the backlog, ``passes`` at most or until it is empty.

        ``automatic``: senders keep no numbers, batches get the next ones of their stream. A batch is admitted if
        its source is known, its records are good, its organization's quota holds it, and its number follows on;
        an exact replay is taken silently. Once a quota is reached, what follows in the micro-batch is refused too.
        """
        with self._lock:
            self._admit(batches.select(*m.BATCH.fieldNames()).persist(CONTENT), epoch, automatic)
            self.drain(passes)

    def _admit(self, batches: DataFrame, epoch: int, automatic: bool, again: bool = False) -> None:
        held = [batches]
        try:
            known = F.broadcast(self.scopes.select("source_id", "organization_id"))
            heads = self.watermarks()
            ours = batches.join(known, "source_id", "left_semi")
            if automatic:
                ours = numbered(ours, heads).select(*m.BATCH.fieldNames())
            judged = admissible(ours.withColumns({"digest": batch_digest(), "content_digest": content_digest()}), self._clock())
            judged = self._without_old_replays(judged, heads).persist(CONTENT)
            # What follows is told from numbers and digests; an accepted batch's content is looked up by them.
            arrivals = self._within_quota(judged.where("problem is null").join(known, "source_id"), heads).withColumn("arrived", F.col("observed_at")).drop("records").persist()
            settled = admit(arrivals.where("not over"), heads).persist()
            held += [judged, arrivals, settled]
            told = [batches.join(known, "source_id", "left_anti").withColumns({"digest": batch_digest(), "problem": F.lit("unknown_source")}), judged.where("problem is not null"),
                    arrivals.where("over").withColumn("problem", F.lit("quota")), settled.where("outcome not in ('accepted', 'duplicate')").withColumn("problem", F.col("outcome"))]
            wrong = reduce(DataFrame.unionByName, [t.select(*KEY, "digest", "problem") for t in told]).withColumn("epoch", F.lit(epoch).cast("long"))
            wrong.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{self.root}/problems")
            fresh = settled.where("outcome = 'accepted'")
            if fresh.head(1):
                content = judged.where("problem is null").join(fresh.select(*KEY, "digest"), [*KEY, "digest"], "left_semi").dropDuplicates([*KEY, "digest"])
                self._queue(fresh, content, heads, again or not self._first_time(f"admission-{self._snapshot()}"))
        finally:
            for df in held:
                df.unpersist()

    def _clock(self) -> datetime:
        return self.now or datetime.now(timezone.utc).replace(tzinfo=None)

    def _without_old_replays(self, judged: DataFrame, heads: DataFrame) -> DataFrame:
        """Batches behind their stream's head are looked up in the ledger, should there be any: exact ones are dropped."""
        last = heads.select(*STREAM, F.col("sequence").alias("_last"))
        old = judged.join(last, STREAM).where(F.col("sequence") < F.col("_last")).select(*KEY, "digest").persist()
        try:
            if not old.head(1):
                return judged
            known = self.ledger().select(*KEY, "digest").unionByName(self.backlog().select(*KEY, "digest"))
            return judged.join(old.join(known, [*KEY, "digest"], "left_semi"), [*KEY, "digest"], "left_anti")
        finally:
            old.unpersist()

    def _within_quota(self, arrivals: DataFrame, heads: DataFrame) -> DataFrame:
        """Arrivals with ``over``: whether they go beyond their organization's quota. Replays of a head need no room."""
        if self.policies is None or "quota_bytes" not in self.policies.columns:
            return arrivals.withColumn("over", F.lit(False))
        size = F.octet_length(F.to_json(F.struct(*m.BATCH.fieldNames())))
        heads = heads.select(*STREAM, F.col("sequence").alias("_last"))
        rows = arrivals.join(heads, STREAM, "left").withColumn("_size", F.when(F.col("sequence") <= F.coalesce("_last", F.lit(0)), 0).otherwise(size)).drop("_last")
        upto = F.sum("_size").over(Window.partitionBy("organization_id").orderBy("observed_at", "digest").rowsBetween(Window.unboundedPreceding, 0))  # of one micro-batch
        quota = self.policies.select("organization_id", "quota_bytes")
        rows = rows.withColumn("_upto", upto).join(self.usage().withColumnRenamed("bytes", "_used"), "organization_id", "left").join(quota, "organization_id", "left")
        over = F.col("quota_bytes").isNotNull() & (F.col("_size") > 0) & (F.coalesce("_used", F.lit(0)) + F.col("_upto") > F.col("quota_bytes"))
        return rows.withColumn("over", over).drop("_size", "_upto", "_used", "quota_bytes")

    def _queue(self, fresh: DataFrame, content: DataFrame, heads: DataFrame, again: bool) -> None:
        """Raw segments, then heads, usage and backlog in one snapshot. ``again``: what a cut-off try has left is not written twice."""
        raw = raw_segments(content.select(*m.BATCH.fieldNames())).persist(CONTENT)
        try:
            new = raw.join(self._read("segments", raw.schema).select("digest"), "digest", "left_anti") if again else raw
            self._write(new, f"{self.root}/segments")
            number = self._snapshot() + 1
            placed = self._sliced(raw, number)
            facts = placed.select(*KEY, "digest", "bytes", "signal", "date", "slice", F.lit(number).cast("long").alias("queued")).join(fresh.select(*KEY, "content_digest", "organization_id"), KEY).withColumn("committed_at", F.lit(self._clock().isoformat(sep=" ") + "+00:00").cast("timestamp"))
            fit = lambda df, kind: df.select(F.lit(kind).alias("kind"), *[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STATE.fields[1:]])
            last = heads.unionByName(facts.select(*heads.columns)).groupBy(*STREAM).agg(F.max(F.struct("sequence", "digest", "content_digest")).alias("h")).select(*STREAM, "h.*")
            used = self.usage().unionByName(facts.select("organization_id", "bytes")).groupBy("organization_id").agg(F.sum("bytes").alias("bytes"))
            self._commit(fit(last, "head").unionByName(fit(used, "usage")).unionByName(fit(self.backlog(), "pending")).unionByName(fit(facts, "pending")))
        finally:
            raw.unpersist()

    def _sliced(self, raw: DataFrame, number: int) -> DataFrame:
        """A copy of the content for passes, apart from all that is there, and its facts with the slice each segment is in."""
        owned = raw.join(F.broadcast(self.scopes.select("source_id", "organization_id")), "source_id")
        inorder = owned.repartitionByRange(-(-raw.count() // SLICE), "organization_id", "digest").withColumn("slice", F.spark_partition_id().cast("long"))
        inorder.select(*raw.columns, "slice").write.mode("overwrite").partitionBy("slice").parquet(f"{self.root}/queue/n-{number}")
        return self._read(f"queue/n-{number}", StructType([*raw.schema.fields, StructField("slice", _LONG)]))

    # Projection

    def drain(self, passes: int | None = None) -> int:
        """Projects queued segments, pass by pass; returns how many. Each pass takes the oldest of every organization within the limits, in turns."""
        done = 0
        while passes is None or passes > 0:
            with self._lock:
                n = self._pass()
            if not n:
                break
            done, passes = done + n, None if passes is None else passes - 1
        return done

    def _pass(self) -> int:
        number = self._snapshot()
        queued = self.backlog().withColumn("projected", F.lit(False))
        picked = fair_pending(queued, self.limits.segments, self.limits.bytes).orderBy("turn", "committed_at", "digest").limit(self.limits.all_segments)
        rows = [r.asDict() for r in picked.select(*KEY, "digest", "content_digest", "queued", "slice").collect()]  # ``all_segments`` at most
        if not rows:
            return 0
        again = not self._first_time(f"pass-{number}")
        mine = self.spark.createDataFrame(rows, _schema(*_NUMBER, ("digest", _TEXT), ("content_digest", _TEXT), ("queued", _LONG), ("slice", _LONG)))
        # A queue of an earlier state has no slices.
        folders = sorted({f"{self.root}/queue/n-{r['queued']}" + ("" if r["slice"] is None else f"/slice={r['slice']}") for r in rows})
        content = self.spark.read.schema(raw_segments(self.spark.createDataFrame([], m.BATCH)).schema).parquet(*folders)
        batches, _ = parsed_segments(content.join(mine.select("digest"), "digest", "left_semi"))
        self._project(batches, again)
        entry = mine.select(*KEY, "digest", "content_digest", F.lit(number).cast("long").alias("epoch"))
        self._append(entry.join(self.ledger().select("digest"), "digest", "left_anti").select(*LEDGER.fieldNames()) if again else entry, "ledger")
        self._commit(self.state().join(mine.select("digest", F.lit("pending").alias("kind")), ["digest", "kind"], "left_anti"))
        waiting = {r["queued"] for r in self.backlog().select("queued").distinct().collect()}
        for n in {r["queued"] for r in rows} - waiting:
            path, files = self._path(f"queue/n-{n}")
            files.delete(path, True)
        return len(rows)

    def _project(self, batches: DataFrame, again: bool, version: str | None = None) -> None:
        """Adds the batches' rows, and the rollup parts of each of them. ``again``: parts of the way may be there already."""
        # A segment's rows stay together, so that its rollup parts need no shuffle.
        rows = flatten(batches.repartition(*KEY), self.scopes).withColumn("date", utc_date(F.col("timestamp")))
        rows = (self._versioned(rows) if version is None else rows.withColumn("_version", F.lit(version))).withColumnRenamed("_version", "version").withColumns(self._promoted()).persist()
        try:
            new = rows
            if again:
                there = self._all_rows().join(rows.select("version", *PARTITIONS).distinct(), ["version", *PARTITIONS], "left_semi").select("version", *m.IDENTITY)
                new = rows.join(there, ["version", *m.IDENTITY], "left_anti")
            self._write(new, f"{self.root}/observations", ["version", *PARTITIONS])
            named = rows.select(*KEY, "version").distinct()
            for kind, made in (("log", log_rollup(rows, KEY)), ("metric", segment_metric_rollup(rows, self.registry, KEY))):
                parts = made.withColumn("date", utc_date(F.col("bucket_start"))).join(named, KEY)
                if again:
                    parts = parts.join(self._parts(kind).select("version", *KEY).distinct(), ["version", *KEY], "left_anti")
                self._write(parts, f"{self.root}/{kind}_rollup", ["version", "date"])
        finally:
            rows.unpersist()

    # Rebuild and recovery

    def rebuild(self, version: str, organization: str | None = None) -> None:
        """A new version from the hot raw segments, of all or of one organization, with the registry at hand; readers change over when it is whole."""
        self.finish_rebuild(self.begin_rebuild(version, organization))

    def begin_rebuild(self, version: str, organization: str | None = None) -> Rebuild:
        """Writes what the ledger has by now; ingest may go on meanwhile. Rollup parts of segments that are not hot any more are taken over."""
        with self._lock:
            started = Rebuild(version, organization, self.version(organization))
            if self._there(f"loaded/version={version}"):
                raise ValueError(f"there is a version {version} already")
            ledger, indexed = self.ledger(), self.registry.indexed()
            if indexed:
                self._append(self.spark.createDataFrame([(version, signal, d.name, d.type) for signal, d in indexed], _PROMOTED), "promoted")
        self._load(started, ledger)
        for kind in ("log", "metric"):
            parts = self._live(self._parts(kind))
            parts = parts if organization is None else parts.where(F.col("organization_id") == organization)
            old = parts.join(self._read("loaded", _LOADED).where(F.col("version") == version).select(*KEY), KEY, "left_anti")
            self._write(old.withColumn("version", F.lit(version)), f"{self.root}/{kind}_rollup", ["version", "date"])
        return started

    def finish_rebuild(self, started: Rebuild) -> None:
        """Catches up with what was projected meanwhile, and changes readers over if they still take the version they took before."""
        with self._lock:
            self._load(started, self.ledger())
            if self.version(started.organization) != started.before:
                raise RuntimeError("another rebuild has finished first")
            self._append(self.spark.createDataFrame([(started.organization, started.version, self._next("current", _CURRENT))], _CURRENT), "current")

    def _load(self, started: Rebuild, ledger: DataFrame) -> None:
        """Projects the hot segments of ``ledger`` that the new version lacks."""
        have = self._read("loaded", _LOADED).where(F.col("version") == started.version).select(*KEY)
        ours = self.scopes if started.organization is None else self.scopes.where(F.col("organization_id") == started.organization)
        todo = ledger.select(*KEY, "digest").join(F.broadcast(ours.select("source_id")), "source_id", "left_semi").join(have, KEY, "left_anti").join(self._gone(), KEY, "left_anti").persist()
        try:
            batches, _ = parsed_segments(self.segments().join(todo.select("digest"), "digest", "left_semi").dropDuplicates(["digest"]))
            self._project(batches, False, started.version)
            todo.select(*KEY, F.lit(started.version).alias("version")).write.mode("append").partitionBy("version").parquet(f"{self.root}/loaded")
        finally:
            todo.unpersist()

    def recover(self, epoch: int) -> int:
        """Raw segments that are neither projected nor queued, left by a broken run, are settled anew; returns how many there were."""
        with self._lock:
            known = self.ledger().select("digest").unionByName(self.backlog().select("digest"))
            lost = self.segments().join(known, "digest", "left_anti")
            count = lost.count()
            if count:
                batches, _ = parsed_segments(lost)
                self._admit(batches.persist(CONTENT), epoch, False, True)
                self.drain()
            return count

    # Retention

    def age(self, policy: Retention) -> int:
        """Moves segments to the tier that retention gives them by now, and returns how many.

        Segments are marked first; then their content is copied, then they are cold. A move that was cut off is finished
        by the next one. A cold segment that is deleted leaves room in its organization's quota.
        """
        with self._lock:
            moved = tiers(self.catalogue().where("tier in ('hot', 'cold')"), policy, self._clock(), self.policies).where("next_tier <> tier").select(*KEY, "digest", "organization_id", "bytes", "next_tier").persist()
            try:
                count = moved.count()
                deleted = count and bool(moved.where("next_tier = 'deleted'").head(1))
                if count:
                    self._mark(moved.withColumn("tier", F.when(F.col("next_tier") == "cold", "archiving").otherwise(F.col("next_tier"))))
                if deleted:  # what is left is summed anew, so that a run that broke here does no harm
                    used = self.catalogue().groupBy("organization_id").agg(F.sum("bytes").alias("_used"))
                    state = self.state().join(used, "organization_id", "left")
                    self._commit(state.withColumn("bytes", F.when(F.col("kind") == "usage", F.coalesce("_used", F.lit(0))).otherwise(F.col("bytes"))))
                self.finish_archiving()
                return count
            finally:
                moved.unpersist()

    def _mark(self, rows: DataFrame) -> None:
        self._append(rows.select(*KEY, "digest", "tier", F.lit(self._next("tiers", _TIERS)).cast("long").alias("at")), "tiers")

    def finish_archiving(self) -> int:
        """Copies the content of marked segments, then calls them cold; returns how many."""
        with self._lock:
            marked = self.tiers().where("tier = 'archiving'").persist()
            try:
                count = marked.count()
                if count:
                    schema = raw_segments(self.spark.createDataFrame([], m.BATCH)).schema
                    content = self._read("segments", schema).join(marked, "digest", "left_semi").dropDuplicates(["digest"])
                    self._write(content.join(self._read("cold", schema).select("digest"), "digest", "left_anti"), f"{self.root}/cold")
                    self._mark(marked.withColumn("tier", F.lit("cold")))
                return count
            finally:
                marked.unpersist()

    def retain(self, policy: Retention) -> list[str]:
        """Ages segments, lets days expire that retention has wholly passed, and deletes files that no read needs; returns the day folders that are gone."""
        with self._lock:
            self.age(policy)
            now = self._clock()
            every = effective(self.scopes.select("organization_id").distinct(), policy, self.policies)
            days = [(s, {"deployments": "evidence"}.get(s, s)) for s in m.SIGNALS] + [(ROLLUPS, "rollups")]
            first = lambda c: F.date_sub(F.lit(now.date()), F.col(c).cast("int"))
            wanted = every.select("organization_id", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), first(c).alias("day")) for s, c in days])).alias("e")).select("organization_id", "e.*")
            old = self.expired().withColumnRenamed("day", "_old")
            later = wanted.join(old, ["organization_id", "signal"], "left").where(F.col("_old").isNull() | (F.col("day") > F.col("_old")))
            if later.head(1):
                self._append(later.select("organization_id", "signal", "day", F.lit(self._next("expired", _EXPIRED)).cast("long").alias("at")), "expired")
            return self.purge()

    def purge(self) -> list[str]:
        """Deletes files in which no row is read any more; returns the day folders that are gone."""
        with self._lock:
            rows = self._all_rows().withColumn("_file", F.col("_metadata.file_path"))
            hot = self._unexpired(self._live(rows).join(self._gone(), KEY, "left_anti"))
            gone = self._delete_unread(rows, hot)
            for kind in ("log", "metric"):
                parts = self._parts(kind).withColumn("_file", F.col("_metadata.file_path"))
                gone += self._delete_unread(parts, self._unexpired(self._live(parts), F.lit(ROLLUPS)))
            schema = raw_segments(self.spark.createDataFrame([], m.BATCH)).schema
            moved = self.tiers()
            for name, dead in (("segments", "tier in ('cold', 'deleted')"), ("cold", "tier = 'deleted'")):
                raw = self._read(name, schema).withColumn("_file", F.col("_metadata.file_path")) if self._there(name) else None
                if raw is not None:
                    self._delete_unread(raw, raw.join(moved.where(dead), "digest", "left_anti"))
            return gone

    def _delete_unread(self, rows: DataFrame, read: DataFrame) -> list[str]:
        """Deletes the files of ``rows`` that ``read`` has no row of, and returns the folders that are empty then."""
        unread = rows.select("_file").distinct().join(read.select("_file").distinct(), "_file", "left_anti")
        folders = set()
        for r in unread.collect():  # a row a file that goes
            path = self.spark._jvm.org.apache.hadoop.fs.Path(r["_file"])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
            folders.add(path.getParent().toString())
        gone = []
        for folder in sorted(folders):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if not any(f.getPath().getName().endswith(".parquet") for f in files.listStatus(path)):
                files.delete(path, True)
                gone.append(folder)
        return gone

    def start(self, incoming: str, checkpoint: str, files_per_trigger: int = 16, once: bool = True, automatic: bool = False, passes: int | None = None) -> StreamingQuery:
        """Streams JSON batch files from ``incoming``; ``once`` drains what is there, else it triggers every second."""
        source = self.spark.readStream.schema(m.BATCH).option("maxFilesPerTrigger", files_per_trigger).json(incoming)
        writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: self.settle(df, epoch, automatic, passes))
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def tumbling(stream: DataFrame) -> DataFrame:
    """Five-minute counts by name as a stream, for dashboards that follow live data (complete or update mode)."""
    return stream.groupBy(bucket_start(F.col("timestamp"), WIDTH).alias("bucket_start"), "name").agg(F.count(F.lit(1)).alias("rows"))


def tailed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the lines (column line) of text files that are added to ``folder``; the checkpoint is the cursor."""
    return spark.readStream.format("text").load(folder).withColumnRenamed("value", "line")


EVENT = StructType([StructField("rule_id", T.StringType()), StructField("at", TimestampType()), StructField("rows", T.LongType())])


def stream_incidents(evaluations: DataFrame, minimum: int, consecutive: int) -> DataFrame:
    """Incident events of a stream of evaluations (rule_id, at, rows); one small state a rule.

    A row with an ``action`` (and ``until``, for a silence), where the stream has these columns, is a person's
    action in place of an evaluation; one that the incident does not take is told as ``refused``.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState

    from ..operators.alerts import Incident, act, evaluate

    rows = evaluations
    for name, kind in (("action", "string"), ("until", "timestamp")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))

    def step(key, frames, state: GroupState):
        number, name, count, until = state.get if state.exists else (0, "none", 0, None)
        incident = None if name == "none" else Incident(number, name, count, None if until is None else datetime.fromtimestamp(until / 1e6, timezone.utc).replace(tzinfo=None))
        out = []
        for r in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples():
            at = r.at.to_pydatetime()
            if isinstance(r.action, str):
                try:
                    incident, event = act(incident or Incident(0, "resolved", 0), r.action, at, None if pd.isna(r.until) else r.until.to_pydatetime())
                except ValueError:
                    event = "refused"
            else:
                fresh = incident is None or incident.state == "resolved"
                incident, event = evaluate(incident, r.rows >= minimum, at, consecutive, number + 1)
                number += fresh and event == "opened"
            if event:
                out.append((key[0], int(number), r.at, event, incident.state if incident else "none"))
        late = incident.silenced_until if incident else None
        state.update((int(number), incident.state if incident else "none", incident.count if incident else 0, None if late is None else int(late.replace(tzinfo=timezone.utc).timestamp() * 1e6)))
        yield pd.DataFrame(out, columns=["rule_id", "number", "at", "event", "state"])

    return rows.groupBy("rule_id").applyInPandasWithState(step, "rule_id string, number long, at timestamp, event string, state string", "number long, state string, count long, silenced_until long", "append", "NoTimeout")
