"""Schema inference and promotion, retention and tiers, projection lag and quotas."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.typed import MOMENT, NUMBER, WHOLE, bucket_start, number, typed, whole
from ..model import IDENTITY
from ..plans.fields import BUILT_IN, METRIC_ONLY, NUMERIC, Descriptor, Registry
from .rollups import WIDTH


def inferred_type(text: Column) -> Column:
    """integer, float, boolean, time or string; only true and false are booleans."""
    return (F.when(text.rlike(WHOLE) & whole(text).isNotNull(), "integer").when(text.rlike(NUMBER) & number(text).isNotNull(), "float").when(text.isin("true", "false"), "boolean")
            .when(text.rlike(MOMENT) & text.try_cast("timestamp").isNotNull(), "time").otherwise("string"))


def widened(types: Column) -> Column:
    """One type for a group: equal types stay, integers with floats are floats, any other mix is text."""
    kinds = F.array_sort(F.collect_set(types))
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(F.array_join(kinds, ",") == "float,integer", "float").otherwise("string")


def field_statistics(observations: DataFrame, registry: Registry | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per signal and unreviewed attribute (and ``by`` columns): rows, bytes, inferred type, first and last seen."""
    registry = registry or Registry()
    known = [*BUILT_IN, *METRIC_ONLY, *{n for _, n in registry.reviewed}]
    flat = observations.select("signal", "timestamp", *by, F.explode("attributes").alias("field", "value")).where(~F.col("field").isin(known))
    for signal, name in sorted(registry.rejected):
        flat = flat.where(~((F.col("signal") == signal) & (F.col("field") == name)))
    kinds = flat.withColumn("kind", inferred_type(F.col("value")))
    return kinds.groupBy(*by, "signal", "field").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes"), widened(F.col("kind")).alias("inferred"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


SEGMENT = ("source_id", "stream_id", "sequence")


def segment_statistics(observations: DataFrame, seen: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Field statistics of each segment that ``seen`` (the ledger of segments that have told theirs) does not list."""
    return field_statistics(observations.join(seen.select(*SEGMENT).distinct(), list(SEGMENT), "left_anti"), registry, SEGMENT)


def proposals(ledger: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Fields to review, from the statistics of all segments, each counted once however often it was told."""
    once = merge_field_statistics(ledger.dropDuplicates([*SEGMENT, "signal", "field"]))
    registry = registry or Registry()
    gone = sorted(registry.rejected | set(registry.reviewed))
    for signal, name in gone:
        once = once.where(~((F.col("signal") == signal) & (F.col("field") == name)))
    return once


def merge_field_statistics(parts: DataFrame) -> DataFrame:
    """Statistics of several segments as one."""
    return parts.groupBy("signal", "field").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), widened(F.col("inferred")).alias("inferred"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def typed_index(observations: DataFrame, signal: str, descriptors: list[Descriptor]) -> DataFrame:
    """(identity, field, value_text, value_number) of reviewed fields; values that do not parse are left out."""
    rows = observations.where(F.col("signal") == signal)
    one = lambda d: typed(F.try_element_at("attributes", F.lit(d.name)), d.type)
    cells = F.array(*[F.struct(F.lit(d.name).alias("field"), (F.lit(None).cast("string") if d.type in NUMERIC else one(d).cast("string")).alias("value_text"), (one(d).cast("double") if d.type in NUMERIC else F.lit(None).cast("double")).alias("value_number")) for d in descriptors])
    return rows.select(*IDENTITY, F.explode(cells).alias("c")).select(*IDENTITY, "c.*").where("value_text is not null or value_number is not null")


def promote(observations: DataFrame, descriptors: list[Descriptor]) -> DataFrame:
    """Reviewed attributes as typed columns beside the map, so that filters on them reach the files."""
    names = {d.name: "p_" + d.name.replace(".", "_") for d in descriptors}
    return observations.withColumns({names[d.name]: typed(F.try_element_at("attributes", F.lit(d.name)), d.type) for d in descriptors})


def promoted_column(name: str, kind: str) -> str:
    """The column of a promoted field of a type: no two of them share one."""
    return f"p_{re.sub('[^0-9A-Za-z]', '_', name)}_{zlib.crc32(name.encode()):08x}_{kind}"


def promoted_values(fields: list[tuple[str, str, str]]) -> dict[str, Column]:
    """Columns of promoted fields (signal, name, type): typed values in rows of their signals, else null."""
    signals: dict[tuple[str, str], list[str]] = {}
    for signal, name, kind in fields:
        signals.setdefault((name, kind), []).append(signal)
    return {promoted_column(name, kind): F.when(F.col("signal").isin(*of), typed(F.try_element_at("attributes", F.lit(name)), kind)) for (name, kind), of in sorted(signals.items())}


@dataclass(frozen=True)
class Retention:
    """Days that each kind of data is kept."""

    logs: int = 30
    traces: int = 30
    metrics: int = 14
    cold: int = 400
    rollups: int = 400
    evidence: int = 400
    delete_cold_raw: bool = False

    def __post_init__(self):
        days = (self.logs, self.traces, self.metrics, self.cold, self.rollups, self.evidence)
        if not all(1 <= d <= 3_650 for d in days):
            raise ValueError("days are from 1 to 3650")
        if self.rollups < self.metrics or self.cold < max(self.logs, self.traces, self.metrics):
            raise ValueError("rollups outlive raw metrics, cold data outlives hot data")

    def changed(self, new: Retention, approved: bool = False) -> Retention:
        """The new policy; keeping anything longer than before needs approval."""
        longer = [n for n in ("logs", "traces", "metrics", "cold", "rollups", "evidence") if getattr(new, n) > getattr(self, n)]
        if longer and not approved:
            raise ValueError(f"longer retention needs approval: {', '.join(longer)}")
        return new

    def days(self, signal: str) -> int:
        return self.evidence if signal == "deployments" else getattr(self, signal)


_DAYS = ("logs", "traces", "metrics", "cold", "rollups", "evidence")


def effective(rows: DataFrame, policy: Retention, policies: DataFrame | None = None) -> DataFrame:
    """``rows`` (organization_id) with the days of each kind and delete_cold_raw: their organization's own, else the policy's."""
    names = [*_DAYS, "delete_cold_raw"]
    own = [n for n in names if policies is not None and n in policies.columns]
    joined = rows.join(policies.select("organization_id", *[F.col(n).alias(f"_own_{n}") for n in own]), "organization_id", "left") if own else rows
    default = lambda n: F.lit(getattr(policy, n))
    return joined.withColumns({n: F.coalesce(f"_own_{n}", default(n)) if n in own else default(n) for n in names}).drop(*[f"_own_{n}" for n in own])


def _ago(now: datetime, days: Column) -> Column:
    return F.lit(now.isoformat(sep=" ") + "+00:00").cast("timestamp") - F.make_dt_interval(days.cast("int"))


def _hot_days() -> Column:
    """The days that a row's signal is hot; deployments are evidence."""
    return F.when(F.col("signal") == "logs", F.col("logs")).when(F.col("signal") == "traces", F.col("traces")).when(F.col("signal") == "metrics", F.col("metrics")).otherwise(F.col("evidence"))


def survivors(observations: DataFrame, policy: Retention, now: datetime, policies: DataFrame | None = None) -> DataFrame:
    """Hot rows that retention keeps."""
    kept = effective(observations, policy, policies).where(F.col("timestamp") >= _ago(now, _hot_days()))
    return kept.select(observations.columns)


def surviving_rollups(rollup: DataFrame, policy: Retention, now: datetime, policies: DataFrame | None = None) -> DataFrame:
    kept = effective(rollup, policy, policies).where(F.col("bucket_start") >= bucket_start(_ago(now, F.col("rollups")), WIDTH))
    return kept.select(rollup.columns)


def tiers(segments: DataFrame, policy: Retention, now: datetime, policies: DataFrame | None = None) -> DataFrame:
    """Segments (organization_id, signal, last_observed, projected, tier) with next_tier: hot, cold or deleted."""
    past = F.col("last_observed") < _ago(now, _hot_days())
    gone = F.col("last_observed") < _ago(now, F.col("cold"))
    after = F.when((F.col("tier") == "cold") & gone & F.col("delete_cold_raw"), "deleted").when((F.col("tier") == "hot") & past & F.col("projected"), "cold").otherwise(F.col("tier"))
    return effective(segments, policy, policies).withColumn("next_tier", after).select(*segments.columns, "next_tier")


def segments_of(observations: DataFrame) -> DataFrame:
    """One row per batch: its signal, rows, first and last observed time."""
    return observations.groupBy("organization_id", "source_id", "stream_id", "sequence", "signal").agg(
        F.count(F.lit(1)).alias("records"), F.min("timestamp").alias("first_observed"), F.max("timestamp").alias("last_observed"))


def cold_segments(segments: DataFrame, signal: str, organization: str, since: Column | None) -> DataFrame:
    """Catalogue rows that a query has to read: cold, in scope, not older than the look-back."""
    rows = segments.where((F.col("tier") == "cold") & (F.col("signal") == signal) & (F.col("organization_id") == organization))
    return rows if since is None else rows.where(F.col("last_observed") >= since)


def projection_lag(segments: DataFrame) -> DataFrame:
    """Per organization: pending segments, their bytes and the oldest commit."""
    return segments.where(~F.col("projected")).groupBy("organization_id").agg(F.count(F.lit(1)).alias("pending"), F.sum("bytes").alias("pending_bytes"), F.min("committed_at").alias("oldest"))


def fair_pending(segments: DataFrame, each: int = 16, bytes_each: int = 32 << 20) -> DataFrame:
    """The next work: the oldest pending segments of every organization, up to ``each`` and ``bytes_each`` of them.

    The count comes first, so that Spark cuts each task's rows to ``each`` an organization before they meet.
    """
    order = Window.partitionBy("organization_id").orderBy("committed_at", "digest")
    oldest = segments.where(~F.col("projected")).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= each)
    placed = oldest.withColumn("_sum", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.where((F.col("_sum") <= bytes_each) | (F.col("turn") == 1)).drop("_sum")


def quota_problems(usage: DataFrame) -> DataFrame:
    """Arrivals (organization_id, used, compressed, uncompressed, quota) with rejected: what they need exceeds the quota."""
    return usage.withColumn("rejected", F.col("used") + F.col("compressed") + F.col("uncompressed") > F.col("quota"))


def organizations(*tables: DataFrame) -> DataFrame:
    """Organizations that any of the tables knows."""
    out = tables[0].select("organization_id")
    for t in tables[1:]:
        out = out.unionByName(t.select("organization_id"))
    return out.distinct()
