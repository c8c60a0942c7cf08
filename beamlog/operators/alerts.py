"""Alert rules: evaluations, incidents as a fold over them, batch-local rules, transitions."""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.fields import Registry
from ..plans.language import Query, QueryError
from .query import matches, run, utc_moment

# Incident states in the order in which lists show them.
STATES = ("firing", "pending", "acknowledged", "silenced", "resolved")
LONGEST_SILENCE = timedelta(days=30)


@dataclass(frozen=True)
class Rule:
    id: str
    minimum: int = 1
    consecutive: int = 1
    interval_seconds: int = 60
    severity: str = "warning"

    def __post_init__(self):
        if not (1 <= self.minimum <= 100_000 and 1 <= self.consecutive <= 10 and 15 <= self.interval_seconds <= 86_400 and self.severity in ("information", "warning", "critical")):
            raise ValueError("rule out of bounds")


@dataclass(frozen=True)
class Incident:
    number: int
    state: str
    count: int
    silenced_until: datetime | None = None


def evaluate(open_incident: Incident | None, matched: bool, at: datetime, consecutive: int, number: int = 1) -> tuple[Incident | None, str | None]:
    """The incident after one evaluation, and the event it makes; a failed query is no evaluation at all."""
    if open_incident is None or open_incident.state == "resolved":
        if not matched:
            return open_incident, None
        return Incident(number, "firing" if consecutive == 1 else "pending", 1), "opened"
    if not matched:
        return replace(open_incident, state="resolved", silenced_until=None), "resolved"
    more = replace(open_incident, count=open_incident.count + 1)
    if more.state == "pending" and more.count >= consecutive:
        return replace(more, state="firing"), "promoted"
    if more.state == "silenced" and more.silenced_until is not None and at >= more.silenced_until:
        return replace(more, state="firing", silenced_until=None), "unsilenced"
    return more, None


def act(incident: Incident, action: str, at: datetime, until: datetime | None = None) -> tuple[Incident, str]:
    """A person's action on an open incident."""
    if incident.state == "resolved":
        raise ValueError("the incident is resolved")
    if action == "acknowledge":
        return replace(incident, state="acknowledged", silenced_until=None), "acknowledged"
    if action == "silence":
        if until is None or not at < until <= at + LONGEST_SILENCE:
            raise ValueError("a silence ends within 30 days")
        return replace(incident, state="silenced", silenced_until=until), "silenced"
    if action == "resolve":
        return replace(incident, state="resolved", silenced_until=None), "resolved"
    raise ValueError(f"unknown action: {action}")


def consecutive_matches(evaluations: DataFrame, minimum: int) -> DataFrame:
    """Evaluations (rule_id, at, rows) with matched and the length of the run of matches they end; by gaps and islands."""
    order = Window.partitionBy("rule_id").orderBy("at")
    flagged = evaluations.withColumn("matched", F.col("rows") >= minimum)
    broken = flagged.withColumn("_island", F.sum(F.when(F.col("matched"), 0).otherwise(1)).over(order))
    run = F.sum(F.when(F.col("matched"), 1).otherwise(0)).over(Window.partitionBy("rule_id", "_island").orderBy("at"))
    return broken.withColumn("run", run).drop("_island")


def incidents(evaluations: DataFrame, minimum: int, consecutive: int) -> DataFrame:
    """Incidents of evaluations alone, one row each: opened, promoted and resolved times, state and matches."""
    runs = consecutive_matches(evaluations, minimum)
    order = Window.partitionBy("rule_id").orderBy("at")
    numbered = runs.withColumn("number", F.sum(F.when(F.col("run") == 1, 1).otherwise(0)).over(order)).withColumn("next_at", F.lead("at").over(order))
    last = F.max_by("next_at", "at")
    grouped = numbered.where("matched").groupBy("rule_id", "number").agg(
        F.min("at").alias("opened_at"), F.min(F.when(F.col("run") == consecutive, F.col("at"))).alias("fired_at"), F.count(F.lit(1)).alias("matches"), last.alias("resolved_at"))
    state = F.when(F.col("resolved_at").isNotNull(), "resolved").when(F.col("fired_at").isNotNull(), "firing").otherwise("pending")
    return grouped.withColumn("state", state)


def fold(evaluations: DataFrame, minimum: int, consecutive: int) -> DataFrame:
    """Events of every rule's incidents, as the state machine makes them of its evaluations in order; by windows alone.

    An incident opens with a run of matches, is promoted by the run's ``consecutive``-th, and ends at the next
    evaluation that does not match. Without people's actions nothing else happens.
    """
    order = Window.partitionBy("rule_id").orderBy("at")
    runs = consecutive_matches(evaluations, minimum).withColumns({"_before": F.coalesce(F.lag("run").over(order), F.lit(0))})
    numbered = runs.withColumn("number", F.sum(F.when(F.col("matched") & (F.col("run") == 1), 1).otherwise(0)).over(order))
    event = (F.when(F.col("matched") & (F.col("run") == 1), "opened").when(F.col("matched") & (F.col("run") == consecutive), "promoted")
             .when(~F.col("matched") & (F.col("_before") > 0), "resolved"))
    state = F.when(~F.col("matched"), "resolved").when(F.col("run") >= consecutive, "firing").otherwise("pending")
    told = numbered.withColumns({"event": event, "state": state, "count": F.when(F.col("matched"), F.col("run")).otherwise(F.col("_before"))})
    return told.where("event is not null").select("rule_id", "number", "at", "event", "state", "count")


MAX_DUE = 64
_RULE = ["organization_id", "rule_id"]


def due_rules(rules: DataFrame, now: datetime, most: int = MAX_DUE) -> DataFrame:
    """The enabled rules whose time has come, the longest waiting first: (organization_id, rule_id, query_id, minimum, consecutive, interval_seconds, enabled, next_at)."""
    return rules.where(F.col("enabled") & (F.col("next_at") <= utc_moment(now))).orderBy("next_at", *_RULE).limit(most)


def claimed(rules: DataFrame, due: DataFrame, now: datetime) -> DataFrame:
    """The rules with the due ones' next time moved on, to be stored before they run, so that no other run takes them."""
    taken = due.select(*_RULE, F.lit(True).alias("_taken"))
    later = F.timestamp_micros(F.unix_micros(utc_moment(now)) + F.col("interval_seconds").cast("bigint") * 1_000_000)
    return rules.join(taken, _RULE, "left").withColumn("next_at", F.when(F.col("_taken"), later).otherwise(F.col("next_at"))).drop("_taken")


def claim(spark: SparkSession, folder: str, now: datetime, most: int = MAX_DUE, stale_seconds: int = 600) -> DataFrame:
    """The due rules of the rule table in ``folder``, taken by this run and no other; their next time moves on.

    The table is a folder of versions (see ``store_rules``). A run may write the next version only if it is the first
    to create that version's mark; who comes second gets no rules. A mark that has had no version for
    ``stale_seconds`` belongs to a run that broke, and is taken over.
    """
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    version = max(int(f.getPath().getName()[2:]) for f in files.listStatus(path("")) if f.getPath().getName().startswith("v-") and files.exists(path(f"{f.getPath().getName()}/_SUCCESS")))
    rules = spark.read.parquet(f"{folder}/v-{version}")
    keys = [tuple(r) for r in due_rules(rules, now, most).select(*_RULE).collect()]  # MAX_DUE rows at most
    taken = rules.join(spark.createDataFrame(keys, "organization_id string, rule_id string"), _RULE, "left_semi").select(rules.columns)
    if not keys:
        return taken
    mark = path(f"mark-{version + 1}")
    if files.exists(mark) and spark._jvm.System.currentTimeMillis() - files.getFileStatus(mark).getModificationTime() > stale_seconds * 1000:
        files.delete(mark, False)
    if not files.createNewFile(mark):
        return taken.limit(0)
    store_rules(claimed(rules, taken, now), folder, version + 1)
    return taken


def store_rules(rules: DataFrame, folder: str, version: int = 0) -> None:
    """A version of the rule table, whole or not at all."""
    rules.write.mode("overwrite").parquet(f"{folder}/v-{version}")


#: Rules whose queries run at the same time.
AT_ONCE = 4


def evaluated(due: DataFrame, saved: dict, observations: DataFrame, now: datetime, registry: Registry | None = None, seconds: float = 60.0) -> DataFrame:
    """(organization_id, rule_id, minimum, consecutive, rows, error, at): how many rows each due rule's saved query returns.

    ``saved`` has (query, scope) by (organization_id, query_id). Each rule is a job of its own. A query that is missing
    or does not plan is "query_unavailable", one that fails as it runs is "query_failed", one that takes longer than
    ``seconds`` is cancelled and "query_timeout"; none of them is an evaluation, and none touches other rules.
    """
    spark, context = due.sparkSession, due.sparkSession.sparkContext
    rules = due.select(*_RULE, "minimum", "consecutive", "query_id").collect()  # MAX_DUE rows at most

    def one(r: Row) -> tuple[int | None, str | None]:
        tag = f"rule-{uuid.uuid4().hex}"
        late = threading.Event()
        timer = threading.Timer(seconds, lambda: (late.set(), context.cancelJobsWithTag(tag)))
        try:
            kept, scope = saved[(r["organization_id"], r["query_id"])]
            query = kept.query()
            context.addJobTag(tag)
            timer.start()
            return run(observations, query, scope, now, registry).full.limit(query.limit).count(), None
        except (KeyError, QueryError):
            return None, "query_unavailable"
        except Exception:
            return None, "query_timeout" if late.is_set() else "query_failed"
        finally:
            timer.cancel()
            context.removeJobTag(tag)

    with ThreadPoolExecutor(AT_ONCE) as pool:
        got = list(pool.map(one, rules))
    out = [(*tuple(r)[:4], *result) for r, result in zip(rules, got)]
    return spark.createDataFrame(out, "organization_id string, rule_id string, minimum long, consecutive long, rows long, error string").withColumn("at", utc_moment(now))


INCIDENT_COLUMNS = [*_RULE, "number", "state", "count", "silenced_until", "updated_at"]


def advanced(incidents: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Each rule's latest incident (INCIDENT_COLUMNS) after one evaluation a rule, with the event it makes, if any.

    Rules that were not evaluated, or whose query failed, keep theirs. The same steps as ``evaluate``, as columns.
    """
    good = evaluations.where("error is null").select(*_RULE, "minimum", "consecutive", "rows", F.col("at").alias("_at"))
    both = incidents.select(*INCIDENT_COLUMNS).join(good, _RULE, "full")
    told, is_open = F.col("_at").isNotNull(), F.coalesce(F.col("state") != "resolved", F.lit(False))
    matched = told & (F.col("rows") >= F.col("minimum"))
    opens, ends = matched & ~is_open, told & ~matched & is_open
    more = F.col("count") + 1
    promoted = matched & (F.col("state") == "pending") & (more >= F.col("consecutive"))
    loud = matched & (F.col("state") == "silenced") & (F.col("silenced_until") <= F.col("_at"))
    event = F.when(opens, "opened").when(ends, "resolved").when(promoted, "promoted").when(loud, "unsilenced")
    state = F.when(opens, F.when(F.col("consecutive") == 1, "firing").otherwise("pending")).when(ends, "resolved").when(promoted | loud, "firing").otherwise(F.col("state"))
    return both.select(
        *_RULE, F.when(opens, F.coalesce("number", F.lit(0)) + 1).otherwise(F.col("number")).cast("long").alias("number"), state.alias("state"),
        F.when(opens, 1).when(matched, more).otherwise(F.col("count")).cast("long").alias("count"),
        F.when(opens | ends | loud, None).otherwise(F.col("silenced_until")).alias("silenced_until"), F.when(matched | ends, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        event.alias("event")).where("state is not null")


def acted(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """The incidents after people's actions (organization_id, rule_id, action, at, until), one a rule, with event or problem.

    acknowledge, silence (until within 30 days) and resolve; a resolved incident takes none.
    """
    both = incidents.select(*INCIDENT_COLUMNS).join(actions.select(*_RULE, "action", F.col("at").alias("_at"), F.col("until").alias("_until")), _RULE, "left")
    action, is_open = F.col("action"), F.col("state") != "resolved"
    soon = (F.col("_until") > F.col("_at")) & (F.unix_micros("_until") - F.unix_micros("_at") <= F.lit(LONGEST_SILENCE // timedelta(microseconds=1)))
    problem = F.when(action.isNull(), None).when(~is_open, "resolved").when(~action.isin("acknowledge", "silence", "resolve"), "unknown_action").when((action == "silence") & ~F.coalesce(soon, F.lit(False)), "silence")
    good = action.isNotNull() & problem.isNull()
    state = F.when(good, F.when(action == "acknowledge", "acknowledged").when(action == "silence", "silenced").otherwise("resolved")).otherwise(F.col("state"))
    return both.select(*_RULE, "number", state.alias("state"), "count", F.when(good, F.when(action == "silence", F.col("_until"))).otherwise(F.col("silenced_until")).alias("silenced_until"),
                       F.when(good, F.col("_at")).otherwise(F.col("updated_at")).alias("updated_at"), F.when(good, state).alias("event"), problem.alias("problem"))


def incident_order(rows: DataFrame) -> DataFrame:
    """Open ones first: by state, latest update, id."""
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(i)) for i, s in enumerate(STATES)], F.lit(len(STATES)))
    return rows.orderBy(rank, F.col("updated_at").desc(), F.col("id"))


def state_rank(state: Column) -> Column:
    return F.coalesce(*[F.when(state == s, F.lit(i)) for i, s in enumerate(STATES)], F.lit(len(STATES)))


def batch_rule(records: DataFrame, query: Query, minimum: int, registry: Registry | None = None) -> DataFrame:
    """A rule on each batch alone: matches, state (matched or clear), first and last time; state error if it does not type."""
    key = ["source_id", "stream_id", "sequence"]
    span = [F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at")]
    rows = records.where(F.col("signal") == query.signal)
    try:
        hit = F.coalesce(matches(query, registry or Registry()), F.lit(False))
    except QueryError:
        return rows.groupBy(*key).agg(F.lit(0).cast("bigint").alias("matches"), *span).withColumn("state", F.lit("error"))
    return rows.groupBy(*key).agg(F.count_if(hit).alias("matches"), *span).withColumn("state", F.when(F.col("matches") >= minimum, "matched").otherwise("clear"))


def transition_problems(transitions: DataFrame, segments: DataFrame) -> DataFrame:
    """Reported transitions (rule_id, source_id, stream_id, sequence, from_sequence, to_sequence) with problem.

    Numbers follow on without a hole per rule and source; the evidence range must be stored segments. A stream's
    n-th stored number tells how many lie up to it, so a range is whole if the ranks of its ends are as far
    apart as the ends; ranges of any length cost two lookups.
    """
    order = Window.partitionBy("rule_id", "source_id").orderBy("sequence")
    steps = transitions.withColumn("_before", F.coalesce(F.lag("sequence").over(order), F.lit(0)))
    stream = ["source_id", "stream_id"]
    ranks = segments.select(*stream, "sequence").distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*stream).orderBy("sequence")))
    end = lambda c: ranks.select(*stream, F.col("sequence").alias(c), F.col("_rank").alias(f"_{c}"))
    joined = steps.join(end("from_sequence"), [*stream, "from_sequence"], "left").join(end("to_sequence"), [*stream, "to_sequence"], "left")
    span = F.col("to_sequence") - F.col("from_sequence")
    whole = F.coalesce((span >= 0) & (F.col("_to_sequence") - F.col("_from_sequence") == span), F.lit(False))
    problem = F.when(F.col("sequence") != F.col("_before") + 1, "gap").when(~whole, "evidence")
    return joined.select(*transitions.columns, problem.alias("problem"))
