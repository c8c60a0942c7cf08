"""Five-minute rollups of logs and metrics, and queries answered from them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import bucket, percentiles
from ..functions.typed import YEAR_ONE, bucket_start, sized, typed, utc_date
from ..model import SCOPE
from ..plans.fields import ALIASES, Registry, canonical
from ..plans.language import SECOND, Query
from ..plans.planner import ROLLUP_SECONDS, Plan, Scope, plan
from .query import PERCENTILES, Result, field_value, finish, matches, run, scan

WIDTH = ROLLUP_SECONDS * SECOND
LOG_KEYS = [*SCOPE, "bucket_start", "status", "route", "route_present"]


def logical_bytes() -> Column:
    """64 plus the bytes of a row's texts."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("name", "severity", "body", "trace_id", "span_id", "correlation_id")]
    pairs = F.aggregate(F.coalesce(F.map_entries("attributes"), F.array().cast("array<struct<key:string,value:string>>")), F.lit(0), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))
    return (sum(texts, F.lit(64)) + pairs).cast("bigint")


def log_rollup(observations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Exact counts by five minutes, scope, status and route, and by further columns. A missing and an empty route are told apart.

    Only statuses that are three digits from 100 to 999, written without sign or zeros in front, are kept.
    """
    status = F.try_element_at("attributes", F.lit("http.status_code"))
    route = F.try_element_at("attributes", F.lit("http.route"))
    rows = observations.where((F.col("signal") == "logs") & status.rlike("^[1-9][0-9]{2}$")).withColumns({
        "bucket_start": bucket_start(F.col("timestamp"), WIDTH), "status": status.try_cast("int"),
        "route": F.coalesce(route, F.lit("")), "route_present": route.isNotNull()})
    return rows.groupBy(*by, *LOG_KEYS).agg(F.count(F.lit(1)).alias("observation_count"), F.sum(logical_bytes()).alias("scanned_bytes"))


def merge_log_rollups(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Partial rollups as one; counts add up. ``by``: columns that follow from a bucket, kept so that filters on them reach the files."""
    return parts.groupBy(*by, *LOG_KEYS).agg(F.sum("observation_count").alias("observation_count"), F.sum("scanned_bytes").alias("scanned_bytes"))


def _first_whole(now: datetime, window: int) -> tuple[Column | None, bool]:
    """The first bucket that a look-back holds whole, and whether it cuts the one before."""
    if not window:
        return None, False
    micros = (now - datetime(1970, 1, 1)) // timedelta(microseconds=1) - window // 1_000
    over = (micros + YEAR_ONE * 1_000_000) % (ROLLUP_SECONDS * 1_000_000)
    return F.timestamp_micros(F.lit(micros - over + (ROLLUP_SECONDS * 1_000_000 if over else 0))), over > 0


def _since_bucket(rollup: DataFrame, first: Column | None) -> DataFrame:
    """Rollup rows from a bucket on; a ``date`` partition column, the UTC day of the bucket, is bounded as well."""
    if first is None:
        return rollup
    rows = rollup.where(F.col("bucket_start") >= first)
    return rows.where(F.col("date") >= utc_date(first)) if "date" in rollup.columns else rows


def query_log_rollup(rollup: DataFrame, observations: DataFrame, query: Query, scope: Scope, now: datetime, planned: Plan) -> Result:
    """Counts from whole rollup buckets, and from raw rows for the part of a bucket that the look-back cuts."""
    least = int(query.filters[0].value)
    rolled = rollup.where(F.col("status") >= least)
    for column, value in scope.parts():
        rolled = rolled.where(F.col(column) == value)
    first, cut = _first_whole(now, query.window)
    rows = _since_bucket(rolled, first).select("bucket_start", "route", "route_present", "observation_count")
    if cut:
        raw = scan(observations, "logs", scope, query.window, now).where(F.col("timestamp") < first)
        rows = rows.unionByName(log_rollup(raw).where(F.col("status") >= least).select("bucket_start", "route", "route_present", "observation_count"))
    keys = [F.when(F.col("route_present"), F.col("route")).alias("http.route")]
    if query.summary.bucket:
        keys.append(bucket_start(F.col("bucket_start"), query.summary.bucket).alias("window_start"))
    full = rows.groupBy(*keys).agg(F.sum("observation_count").alias("count"))
    return finish(full, planned)


def _spelled(name: str) -> Column:
    return F.coalesce(*[F.try_element_at("attributes", F.lit(n)) for n in (name, *[a for a, c in ALIASES.items() if c == name])])


def dimensions(registry: Registry) -> Column:
    """The attributes a metric rollup keeps, under their canonical names; a record may spell one by its alias."""
    kept = registry.rollup_dimensions()
    named = [F.struct(F.lit(d.name).alias("k"), _spelled(d.name).alias("v"), typed(_spelled(d.name), d.type).isNotNull().alias("ok")) for d in kept]
    present = F.filter(F.array(*named), lambda e: e["v"].isNotNull() & e["ok"])
    return F.map_from_entries(F.transform(F.array_sort(present), lambda e: F.struct(e["k"], e["v"])))


def digest_of(attributes: Column) -> Column:
    """SHA-256 of a map's length-prefixed keys and values in key order."""
    parts = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(sized(e["key"]), sized(e["value"])))
    return F.sha2(F.array_join(parts, ""), 256)


METRIC_KEYS = [*SCOPE, "bucket_start", "name", "dimensions_digest"]


def metric_rollup(observations: DataFrame, registry: Registry | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per five minutes, scope, name and dimensions (and further columns): count, sum, least, greatest, last value, and a sparse histogram.

    The last value is that of the latest time, of equal times the latest arrival. The histogram comes from a
    first grouping by bucket, so no group's values are ever gathered.
    """
    rows = observations.where((F.col("signal") == "metrics") & (F.abs("value") <= 1e25)).withColumn("attributes", dimensions(registry or Registry())).withColumns({
        "bucket_start": bucket_start(F.col("timestamp"), WIDTH), "dimensions_digest": digest_of(F.col("attributes")), "bucket": bucket(F.col("value"))})
    arrival = F.struct("timestamp", "source_id", "stream_id", "sequence", "record_index")
    fine = rows.groupBy(*by, *METRIC_KEYS, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.max_by(F.struct("value", "timestamp"), arrival).alias("last"), F.max(arrival).alias("at"), F.any_value("attributes").alias("attributes"))
    return fine.groupBy(*by, *METRIC_KEYS).agg(
        F.any_value("attributes").alias("attributes"), F.sum("n").alias("sample_count"), F.sum("s").alias("value_sum"), F.min("lo").alias("value_min"), F.max("hi").alias("value_max"),
        F.max_by("last", "at")["value"].alias("last_value"), F.max_by("last", "at")["timestamp"].alias("last_timestamp"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("histogram"))


def segment_metric_rollup(observations: DataFrame, registry: Registry | None, segment: Sequence[str]) -> DataFrame:
    """``metric_rollup`` by segment, whose columns ``segment`` names: most groups have one row, so a row must cost little.

    Arrivals of one segment are told apart by time and position, which one whole number of a bucket holds; so
    all that is aggregated has a fixed width, and Spark need not sort. Dimensions are grouped as they are, digests come after.
    """
    start = bucket_start(F.col("timestamp"), WIDTH)
    arrival = (F.unix_micros("timestamp") - F.unix_micros("bucket_start")) * F.lit(1 << 31) + F.col("record_index")
    rows = observations.where((F.col("signal") == "metrics") & (F.abs("value") <= 1e25)).withColumns({
        "bucket_start": start, "kept": F.map_entries(dimensions(registry or Registry())), "bucket": bucket(F.col("value"))}).withColumn("arrival", arrival)
    keys = [*segment, *SCOPE, "bucket_start", "name", "kept"]
    fine = rows.groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.max_by("value", "arrival").alias("last"), F.max("arrival").alias("at"), F.max("timestamp").alias("latest"))
    made = fine.groupBy(*keys).agg(
        F.sum("n").alias("sample_count"), F.sum("s").alias("value_sum"), F.min("lo").alias("value_min"), F.max("hi").alias("value_max"), F.max_by("last", "at").alias("last_value"),
        F.max("latest").alias("last_timestamp"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("histogram"))
    named = made.withColumn("attributes", F.map_from_entries("kept")).withColumn("dimensions_digest", digest_of(F.col("attributes")))
    return named.select(*segment, *METRIC_KEYS, "attributes", "sample_count", "value_sum", "value_min", "value_max", "last_value", "last_timestamp", "histogram")


def merge_metric_rollups(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Partial rollups of the same buckets as one: counts and histograms add up, later last values win (of equal times the greater)."""
    keys = [*by, *METRIC_KEYS]
    last = F.struct("last_timestamp", "last_value")
    flat = parts.groupBy(*keys).agg(F.any_value("attributes").alias("attributes"), F.sum("sample_count").alias("sample_count"), F.sum("value_sum").alias("value_sum"), F.min("value_min").alias("value_min"),
                                    F.max("value_max").alias("value_max"), F.max_by("last_value", last).alias("last_value"), F.max("last_timestamp").alias("last_timestamp"))
    hist = parts.select(*keys, F.explode("histogram").alias("bucket", "n")).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    return flat.join(hist.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "n")))).alias("histogram")), keys)


def _as_observations(rollup: DataFrame) -> DataFrame:
    """Rollup rows with the columns that filters and groups read."""
    return rollup.withColumns({"signal": F.lit("metrics"), "timestamp": F.col("bucket_start")})


def query_metric_rollup(rollup: DataFrame, observations: DataFrame, query: Query, scope: Scope, now: datetime, planned: Plan, registry: Registry | None = None) -> Result:
    """Merged partial aggregates of whole buckets, and of the raw rows where the look-back cuts a bucket.

    Percentiles are read from the merged histograms and are approximate; all else is exact.
    """
    registry = registry or Registry()
    first, cut = _first_whole(now, query.window)
    parts = _since_bucket(rollup, first).drop("date")
    if cut:
        parts = parts.unionByName(metric_rollup(scan(observations, "metrics", scope, query.window, now).where(F.col("timestamp") < first), registry))
    rows = scan(_as_observations(parts), "metrics", scope, 0, now).where(matches(query, registry))
    s = query.summary
    keys = {**({"window_start": bucket_start(F.col("timestamp"), s.bucket)} if s.bucket else {}), **{canonical(g): field_value(registry.describe("metrics", g)) for g in s.groups}}
    names = {k: f"_k{i}" for i, k in enumerate(keys)} or {"": "_k0"}
    base = rows.select(*([v.alias(names[k]) for k, v in keys.items()] or [F.lit(0).alias("_k0")]), "sample_count", "value_sum", "value_min", "value_max", "histogram")
    merged = {"count": F.sum("sample_count"), "sum": F.sum("value_sum"), "avg": F.sum("value_sum") / F.sum("sample_count"), "min": F.min("value_min"), "max": F.max("value_max")}
    by = list(names.values())
    full = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[merged[a.function].alias(a.alias) for a in s.aggregates if a.function in merged])
    shares = [(a.alias, PERCENTILES[a.function]) for a in s.aggregates if a.function in PERCENTILES]
    if shares:
        got = percentiles(base.select(*by, F.explode("histogram").alias("bucket", "n")), by, shares).alias("r")
        left, condition = full.alias("l"), F.lit(True)
        for k in by:
            condition = condition & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        full = left.join(got, condition).select("l.*", *[f"r.{n}" for n, _ in shares])
    return finish(full.select(*[F.col(names[k]).alias(k) for k in keys], *[a.alias for a in s.aggregates]), planned)


def answer(observations: DataFrame, query: Query, scope: Scope, now: datetime, registry: Registry | None = None, sensitive: bool = False, logs: DataFrame | None = None, metrics: DataFrame | None = None, cold: DataFrame | None = None) -> Result:
    """A query by the cheapest path that fits: a rollup, if one is given and its rules hold, else rows."""
    registry = registry or Registry()
    planned, raw = plan(query, scope, registry, sensitive, cold=cold is not None), registry.held_by(())  # rollups keep no columns of single fields
    if planned.path == "log_rollup" and logs is not None:
        return query_log_rollup(logs, observations, query, scope, now, planned)
    if planned.path == "metric_rollup" and metrics is not None:
        return query_metric_rollup(metrics, observations, query, scope, now, planned, raw)
    return run(observations, query, scope, now, registry, sensitive, cold)


def affected_buckets(rows: DataFrame) -> DataFrame:
    """The rollup buckets of each organization that new rows touch, late ones included."""
    return rows.select("organization_id", bucket_start(F.col("timestamp"), WIDTH).alias("bucket_start")).distinct()
