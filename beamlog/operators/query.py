"""Running a plan over observations: one lazy DataFrame of built-in expressions."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from ..functions.histogram import bucket as magnitude
from ..functions.typed import bucket_start, number, sized, typed, utc_date
from ..plans.fields import CORE, INTEGER, NUMERIC, TIME, Descriptor, Registry, canonical
from ..plans.language import Query
from ..plans.planner import BudgetError, Plan, Scope, literal, plan, referenced, result_columns

PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class Result:
    """``rows`` are ordered and limited; ``full`` has every row, ordered columns in ``order`` included.

    ``seen`` counts, in the first run of either, the rows that passed the filters (matched_rows).
    """

    rows: DataFrame
    full: DataFrame
    columns: list[str]
    order: list[Column]
    plan: Plan
    seen: Observation | None = None

    def truncated(self) -> bool:
        """Whether the limit cut rows: one row more than it exists."""
        return self.full.limit(self.plan.query.limit + 1).count() > self.plan.query.limit


def raw_field(name: str) -> Column:
    """A field as stored. Core texts are missing when empty; an attribute may be present and empty."""
    name = canonical(name)
    if name in ("timestamp", "value"):
        return F.col(name)
    if name in CORE:
        return F.nullif(F.col(CORE[name]), F.lit(""))
    return F.try_element_at("attributes", F.lit(name))


def field_value(descriptor: Descriptor) -> Column:
    """A field in its type, null where it is missing or does not parse; from its own column where one is stored."""
    if descriptor.column:
        return F.col(descriptor.column)
    raw = raw_field(descriptor.name)
    if descriptor.name in ("timestamp", "value"):
        return raw if descriptor.name == "timestamp" else F.when(F.abs(raw) < float("inf"), raw)
    return typed(raw, descriptor.type)


def predicate(descriptor: Descriptor, op: str, text: str) -> Column:
    """A filter as a condition. A missing or unparseable field is null and so never matches, not even by !=."""
    value, wanted = field_value(descriptor), literal(descriptor, op, text)
    if op == "=~":
        return value.rlike(wanted)
    if descriptor.type == INTEGER:
        wanted = F.lit(wanted).cast("bigint")
    elif descriptor.type == TIME:
        wanted = F.timestamp_micros(F.lit(int(wanted.timestamp()) * 1_000_000 + wanted.microsecond))
    else:
        wanted = F.lit(wanted)
    return {"==": value == wanted, "!=": value != wanted, ">": value > wanted, ">=": value >= wanted, "<": value < wanted, "<=": value <= wanted}[op]


def matches(query: Query, registry: Registry) -> Column:
    """All filters of a query; true for every row where it has none."""
    return reduce(lambda a, b: a & b, [predicate(registry.describe(query.signal, f.field), f.op, f.value) for f in query.filters], F.lit(True))


def utc_moment(at: datetime) -> Column:
    """A time without zone, taken as UTC whatever the session's zone."""
    return F.timestamp_micros(F.lit((at - datetime(1970, 1, 1)) // timedelta(microseconds=1)))


def since(now: datetime, nanos: int) -> Column:
    return utc_moment(now - timedelta(microseconds=nanos // 1_000))


def scan(observations: DataFrame, signal: str, scope: Scope, window: int, now: datetime) -> DataFrame:
    """Rows of a signal in a scope, from ``now`` (UTC, no zone) minus the look-back on; there is no upper bound.

    Where the table has a ``date`` partition column (the UTC day), it is bounded as well so that partitions are pruned.
    """
    rows = observations.where(F.col("signal") == signal)
    for column, value in scope.parts():
        rows = rows.where(F.col(column) == value)
    if window:
        rows = rows.where(F.col("timestamp") >= since(now, window))
        if "date" in observations.columns:
            rows = rows.where(F.col("date") >= utc_date(since(now, window)))
    return rows


def aggregate(function: str, value: Column | None) -> Column:
    if function == "count":
        return F.count(F.lit(1))
    return {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.avg}[function](value)


def summarize(rows: DataFrame, query: Query, registry: Registry) -> DataFrame:
    """Grouped aggregates; without groups, one row unless no row matched. One scan, whatever the aggregates.

    Percentiles come from counts of the distinct values: a first grouping by key and value, summed on the map
    side, holds partial results of all other aggregates as well; a second one reads each group's values in order.
    """
    s = query.summary
    keys = {}
    if s.bucket:
        keys["window_start"] = bucket_start(F.col("timestamp"), s.bucket)
    for g in s.groups:
        d = registry.describe(query.signal, g)
        keys[d.name] = field_value(d)
    inputs = {a.field: f"_v{i}" for i, a in enumerate(s.aggregates) if a.field}
    values = {column: _as_number(registry.describe(query.signal, f)) for f, column in inputs.items()}
    names = {k: f"_k{i}" for i, k in enumerate(keys)} or {"": "_k0"}
    base = rows.select(*([v.alias(names[k]) for k, v in keys.items()] or [F.lit(0).alias("_k0")]), *[v.alias(c) for c, v in values.items()])
    by = list(names.values())
    shares = {i: (inputs[a.field], PERCENTILES[a.function]) for i, a in enumerate(s.aggregates) if a.function in PERCENTILES}
    plain = {i: (a.function, inputs.get(a.field)) for i, a in enumerate(s.aggregates) if a.function not in PERCENTILES}
    if shares:
        grouped = with_percentiles(base, by, plain, shares, split=not keys or planned_bytes(rows) > SPLIT_BYTES)
    else:
        grouped = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[aggregate(f, F.col(c) if c else None).alias(f"_a{i}") for i, (f, c) in plain.items()])
    return grouped.select(*[F.col(names[k]).alias(k) for k in keys], *[F.col(f"_a{i}").alias(a.alias) for i, a in enumerate(s.aggregates)])


#: Beyond so many planned bytes of input, no task may hold all values of a group; below, one task can hold them all.
SPLIT_BYTES = 256 << 20
#: Equal slices of the range of values that a magnitude holds.
SLICES = 4096


def planned_bytes(rows: DataFrame) -> int:
    """The planner's estimate of the rows' size."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in columns])


def with_percentiles(rows: DataFrame, by: list[str], plain: dict[int, tuple[str, str | None]], shares: dict[int, tuple[str, float]], split: bool = False) -> DataFrame:
    """Per group, columns _a<i>: plain aggregates (function, column) and exact nearest-rank percentiles (column, share).

    Each row counts once for every ranked column, and for the plain aggregates with the first one. With ``split``, a
    group's values are never together: counts of magnitudes tell which one holds each percentile, counts of equal
    slices of its range tell which slice does, and only that slice's values are put in order. The rows are read once
    for the percentiles and once for the plain aggregates.
    """
    ranked = sorted({c for c, _ in shares.values()})
    several = len(ranked) > 1
    first = F.col("_f") == 0 if several else F.lit(True)
    parts, finals = {}, {}
    for i, (f, c) in plain.items():
        if f in ("count", "avg"):
            parts[f"_p{i}n"] = F.count(F.when(first, F.lit(1) if f == "count" else F.col(c)))
        if f != "count":
            whole = {"min": F.min, "max": F.max, "sum": F.sum, "avg": F.sum}[f]
            parts[f"_p{i}"] = whole(F.when(first, F.col(c)))
        finals[i] = F.sum(f"_p{i}n") if f == "count" else F.try_divide(F.sum(f"_p{i}"), F.sum(f"_p{i}n")) if f == "avg" else {"min": F.min, "max": F.max, "sum": F.sum}[f](f"_p{i}")
    used = sorted({c for _, c in plain.values() if c})
    own = [*by, "_f"] if several else by
    if several:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("_f"), F.col(c).alias("_x")) for k, c in enumerate(ranked)]))
        flat = rows.select(*by, *used, each.alias("_e")).select(*by, *used, "_e._f", "_e._x")
    else:
        flat = rows.select(*by, *used, F.col(ranked[0]).alias("_x"))
    counted = F.when(F.col("_x").isNotNull(), F.col("_c")).otherwise(0)
    of = lambda c: F.col("_f") == ranked.index(c) if several else F.lit(True)
    rank = lambda share: F.ceil(F.lit(share) * F.col("_all"))
    upto = lambda keys, order, n: F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    plains = [v.alias(f"_a{i}") for i, v in finals.items()]
    if not split:
        fine = flat.groupBy(*own, "_x").agg(F.count(F.lit(1)).alias("_c"), *[p.alias(n) for n, p in parts.items()])
        placed = fine.withColumns({"_all": F.sum(counted).over(Window.partitionBy(*own)), "_upto": upto(own, "_x", counted)})
        reached = lambda c, share: F.min(F.when(of(c) & (F.col("_upto") >= rank(share)), F.col("_x")))
        return placed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *plains, *[reached(c, share).alias(f"_a{i}") for i, (c, share) in shares.items()])
    # The counts below are one shuffle, read by all that follows: no filter and no other aggregate may differ between its readers.
    fine = flat.select(*own, "_x").groupBy(*own, "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", magnitude(F.col("_x")))
    coarse = fine.groupBy(*own, "_b").agg(F.sum(counted).alias("_s"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.sum("_c").alias("_m"))  # some ten thousand magnitudes a group at most
    if plain:
        groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[aggregate(f, F.col(c) if c else None).alias(f"_a{i}") for i, (f, c) in plain.items()])
    else:
        groups = coarse.groupBy(*by).agg(F.sum("_m").alias("_n")).where("_n > 0")  # every group; the counts are asked for, so that the shuffle stays the same
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), rank(share).alias("_rank"), of(c).alias("_own")) for i, (c, share) in shares.items()])).alias("_q")
    placed = coarse.withColumns({"_all": F.sum("_s").over(Window.partitionBy(*own)), "_upto": upto(own, "_b", "_s")})
    held = placed.select(*own, "_b", "_low", "_high", "_s", "_upto", asked).where("_q._own and _q._rank <= _upto and _q._rank > _upto - _s")
    held = held.select(*own, "_b", "_low", "_high", F.col("_q._i").alias("_i"), (F.col("_q._rank") - F.col("_upto") + F.col("_s")).alias("_rank"))
    near = fine.alias("l").join(held.alias("r"), _same("l", "r", [*own, "_b"])).select(*[F.col(f"l.{k}") for k in by], "l._x", "l._c", "r._i", "r._rank", "r._low", "r._high")
    width = F.col("_high") - F.col("_low")
    near = near.withColumn("_slice", F.when(width > 0, F.floor((F.col("_x") - F.col("_low")) / width * SLICES)).otherwise(0))
    sliced = near.groupBy(*by, "_i", "_rank", "_slice").agg(F.sum("_c").alias("_s")).withColumn("_upto", upto([*by, "_i"], "_slice", "_s"))
    slices = sliced.where("_rank <= _upto and _rank > _upto - _s").select(*by, "_i", "_slice", (F.col("_rank") - F.col("_upto") + F.col("_s")).alias("_left"))
    last = near.alias("l").join(slices.alias("r"), _same("l", "r", [*by, "_i", "_slice"])).select(*[F.col(f"l.{k}") for k in by], "l._i", "l._x", "l._c", "r._left")
    found = last.withColumn("_upto", upto([*by, "_i"], "_x", "_c")).where(F.col("_upto") >= F.col("_left")).groupBy(*by).agg(*[F.min(F.when(F.col("_i") == i, F.col("_x"))).alias(f"_a{i}") for i in shares])
    return groups.alias("l").join(found.alias("r"), _same("l", "r", by), "left").select("l.*", *[f"r._a{i}" for i in shares])


def _as_number(descriptor: Descriptor) -> Column:
    value = field_value(descriptor)
    return value.cast("double") if descriptor.type in NUMERIC else number(value.cast("string"))


def group_key(columns: list[str]) -> Column:
    return F.concat(F.lit(""), *[sized(F.col(f"`{c}`")) for c in columns])


def ordering(query: Query) -> tuple[list[Column], list[str]]:
    """Sort keys with unique ties, and the helper columns they read. Nulls come last in both directions."""
    out = []
    if query.sort:
        name = query.sort.field if query.summary and query.sort.field in {a.alias for a in query.summary.aggregates} else canonical(query.sort.field)
        key = F.col(f"`{name}`")
        out.append(key.desc_nulls_last() if query.sort.descending else key.asc_nulls_last())
    if query.summary:
        return [*out, F.col("_order").asc()], ["_order"]
    return [*out, F.col("_timestamp").desc(), F.col("source_id").asc(), F.col("stream_id").asc(), F.col("sequence").desc(), F.col("record_index").asc()], ["_timestamp", "source_id", "stream_id", "sequence", "record_index"]


def project(rows: DataFrame, query: Query, registry: Registry) -> DataFrame:
    cells = [field_value(registry.describe(query.signal, c)).alias(c) for c in result_columns(query)]
    return rows.select(*cells, F.col("timestamp").alias("_timestamp"), "source_id", "stream_id", "sequence", "record_index")


def finish(full: DataFrame, planned: Plan, seen: Observation | None = None) -> Result:
    query, columns = planned.query, result_columns(planned.query)
    if query.summary:
        keys = [c for c in columns if c not in {a.alias for a in query.summary.aggregates}]
        full = full.withColumn("_order", group_key(keys))
    order, _ = ordering(query)
    quoted = [F.col(f"`{c}`") for c in columns]
    return Result(full.orderBy(*order).limit(query.limit).select(*quoted), full, columns, order, planned, seen)


def run(observations: DataFrame, query: Query, scope: Scope, now: datetime, registry: Registry | None = None, sensitive: bool = False, cold: DataFrame | None = None, planned: Plan | None = None, seen: Observation | None = None) -> Result:
    """The exact row path, over hot observations and, where given, cold ones. ``seen`` (see Result) costs no scan of its own.

    Fields that ``registry`` says are stored in columns are read from these where the hot table has them; cold rows get them first.
    """
    registry = (registry or Registry()).held_by(observations.columns)
    planned = planned or plan(query, scope, registry, sensitive, cold=cold is not None, rollups=False)
    rows = scan(observations, query.signal, scope, query.window, now)
    if cold is not None:  # apart from the hot rows, for the two may be partitioned differently
        raw = registry.held_by(())
        stored = {c: field_value(raw.describe(query.signal, name)) for (signal, name), c in registry.columns.items() if signal == query.signal}
        rows = rows.unionByName(scan(cold, query.signal, scope, query.window, now).withColumns(stored), allowMissingColumns=True)
    rows = rows.where(matches(query, registry))
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("matched_rows"))
    full = summarize(rows, query, registry) if query.summary else project(rows, query, registry)
    return finish(full, planned, seen)


def ranked(result: Result) -> DataFrame:
    """The limited rows with their position, so that order itself can be compared."""
    top = result.full.orderBy(*result.order).limit(result.plan.query.limit)
    place = F.row_number().over(Window.orderBy(*result.order)).cast("bigint")  # of at most ``limit`` rows
    return top.withColumn("rank", place).select("rank", *[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in result.columns])


def statistics(observations: DataFrame, query: Query, scope: Scope, now: datetime, registry: Registry | None = None) -> DataFrame:
    """One row: scanned rows and bytes of the scan, matched rows of the filters."""
    rows = scan(observations, query.signal, scope, query.window, now)
    size = F.lit(64) + sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("name", "severity", "body", "trace_id", "span_id", "correlation_id")), F.lit(0)) + F.coalesce(F.octet_length(F.to_json("attributes")), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("scanned_rows"), F.count_if(F.coalesce(matches(query, registry or Registry()), F.lit(False))).alias("matched_rows"), F.sum(size).alias("scanned_bytes"))


def within_budget(observations: DataFrame, planned: Plan, now: datetime, registry: Registry | None = None) -> dict:
    """Scan statistics of a plan by the bytes of its rows, or a BudgetError where they exceed its budget. A scan of its own; ``answer_within`` needs none."""
    got = statistics(observations, planned.query, planned.scope, now, registry).first().asDict()
    _check_bytes(got["scanned_bytes"] or 0, planned)
    return got


def _check_bytes(scanned: int, planned: Plan) -> None:
    if scanned > planned.budget.scanned_bytes:
        raise BudgetError(f"{scanned} scanned bytes exceed the budget of {planned.budget.scanned_bytes}")


@dataclass(frozen=True)
class Answer:
    """Collected rows, whether the limit cut any, and what the run read: records and bytes of its scans, rows that passed the filters."""

    rows: list[Row]
    truncated: bool
    scanned_rows: int
    scanned_bytes: int
    matched_rows: int | None


#: Seconds between two looks at what a running query has read.
LOOK_SECONDS = 0.1


def read_so_far(context: SparkContext, tag: str) -> tuple[int, int]:
    """Records and bytes that the stages of the jobs with this tag have read from storage, as far as tasks have told."""
    inner = context._jsc.sc()
    tracker, store, stages = inner.statusTracker(), inner.statusStore(), set()
    for job in tracker.getJobIdsForTag(tag):
        info = tracker.getJobInfo(job)
        if info.isDefined():
            stages.update(info.get().stageIds())
    known = [stage for stage in stages if tracker.getStageInfo(stage).isDefined()]
    attempts = [store.lastStageAttempt(stage) for stage in known]
    return sum(a.inputRecords() for a in attempts), sum(a.inputBytes() for a in attempts)


def answer_within(result: Result) -> Answer:
    """Runs a result once under its plan's budget.

    The run's jobs carry a tag. A watcher looks at what their tasks have read so far and cancels them when the
    budget's seconds are over or its bytes are exceeded, so a query too large stops soon after it has read as much
    as it may. One row more than the limit is asked for. Rows whose texts take more than the budget's memory are refused.
    """
    planned, context, tag = result.plan, result.full.sparkSession.sparkContext, f"budget-{uuid.uuid4().hex}"
    budget, until = planned.budget, time.monotonic() + planned.budget.seconds
    done, why = threading.Event(), []

    def watch() -> None:
        while not done.wait(max(0.0, min(LOOK_SECONDS, until - time.monotonic()))):
            if time.monotonic() >= until:
                why.append(f"the query took longer than {budget.seconds} s")
            else:
                scanned = read_so_far(context, tag)[1]
                if scanned > budget.scanned_bytes:
                    why.append(f"{scanned} scanned bytes exceed the budget of {budget.scanned_bytes}")
            if why:
                return context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        rows = result.full.orderBy(*result.order).limit(planned.query.limit + 1).select(*[F.col(f"`{c}`") for c in result.columns]).collect()
    except Exception as e:
        if why:
            raise BudgetError(why[0]) from e
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    context._jsc.sc().listenerBus().waitUntilEmpty()  # the last tasks' figures are on their way
    records, scanned = read_so_far(context, tag)
    _check_bytes(scanned, planned)
    size = sum(len(str(v)) for r in rows for v in r if v is not None)
    if size > budget.memory_bytes:
        raise BudgetError(f"a result of {size} bytes exceeds the budget of {budget.memory_bytes}")
    return Answer(rows[: planned.query.limit], len(rows) > planned.query.limit, records, scanned, result.seen.get.get("matched_rows", 0) if result.seen else None)


def collect_within(result: Result) -> tuple[list[Row], bool]:
    """The rows of ``answer_within`` and whether the limit cut any."""
    answer = answer_within(result)
    return answer.rows, answer.truncated


__all__ = ["Answer", "Result", "answer_within", "collect_within", "finish", "matches", "predicate", "ranked", "referenced", "run", "scan", "statistics", "summarize", "with_percentiles", "within_budget"]
