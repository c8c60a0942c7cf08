"""Batches to observations: validation, flattening, stream admission and attribute hygiene."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as m
from ..functions.typed import bucket_start
from ..operators.rollups import WIDTH
from ..plans.fields import ALIASES

# Parts of attribute names that are never stored, after writing - . and / as _.
DENIED = ("authorization", "proxy_authorization", "cookie", "set_cookie", "password", "passwd", "secret", "api_key", "apikey", "access_token", "refresh_token", "client_secret")


#: How times are written in digests and raw segments: to the microsecond, in UTC, whatever the session's zone.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"}


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Native JSON batches, one a line; unknown keys are ignored, missing ones null."""
    return spark.read.schema(m.BATCH).json(path)


def flatten(batches: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """One row per record with its position; the scope comes from the ``scopes`` table by source, never from the batch."""
    rows = batches.select("source_id", "stream_id", "sequence", "signal", F.posexplode("records").alias("record_index", "r")).select(
        "source_id", "stream_id", "sequence", "record_index", "signal", "r.*")
    if scopes is None:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in m.SCOPE})
    else:
        rows = rows.join(F.broadcast(scopes.select("source_id", *m.SCOPE)), "source_id")  # by source alone all rows of one would meet in a task
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in m.OBSERVATION])


def _bytes(c: str, low: int, high: int) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).between(low, high)


def record_rules(now: datetime) -> dict[str, Column]:
    """What each record must keep, as conditions that are never null. Sizes are bytes. No metric has a field and its alias."""
    at = lambda t: F.lit(t.isoformat(sep=" ") + "+00:00").cast("timestamp")
    known = lambda c: F.coalesce(c, F.lit(False))
    optional = lambda c, ok: F.col(c).isNull() | (F.col(c) == "") | ok
    attributes = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>"))
    return {
        "time": known(F.col("timestamp").between(at(now - timedelta(days=m.OLDEST_RECORD_DAYS)), at(now + timedelta(minutes=m.FUTURE_MINUTES)))),
        "name": _bytes("name", 1, m.MAX_NAME),
        "sizes": _bytes("severity", 0, m.MAX_SEVERITY) & _bytes("body", 0, m.MAX_BODY) & _bytes("correlation_id", 0, m.MAX_CORRELATION),
        "ids": known(optional("trace_id", F.col("trace_id").rlike("^[0-9a-f]{32}$"))) & known(optional("span_id", F.col("span_id").rlike("^[0-9a-f]{16}$"))),
        "value": F.when(F.col("signal") == "metrics", known(F.abs("value") <= m.MAX_METRIC)).otherwise(F.col("value").isNull() | known(F.abs("value") < float("inf"))),
        "attributes": (F.size(attributes) <= m.MAX_ATTRIBUTES) & F.forall(F.map_keys(attributes), lambda k: F.octet_length(k).between(1, m.MAX_KEY)) & F.forall(F.map_values(attributes), lambda v: F.octet_length(F.coalesce(v, F.lit(""))) <= m.MAX_VALUE),
        "aliases": (F.col("signal") != "metrics") | ~reduce(lambda a, b: a | b, [F.map_contains_key(attributes, a) & F.map_contains_key(attributes, c) for a, c in ALIASES.items()]),
        "text": ~known(F.concat_ws("", "name", "severity", "body", F.to_json("attributes")).contains("\0")) & ~F.coalesce(F.to_json("attributes"), F.lit("")).contains("\\u0000"),
    }


def validate_records(records: DataFrame, now: datetime) -> DataFrame:
    """The records with ``broken``: the names of the rules each breaks."""
    rules = record_rules(now)
    return records.withColumn("broken", F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull()))


def admissible(batches: DataFrame, now: datetime) -> DataFrame:
    """Batches with ``problem`` (null where none): one bad record rejects its whole batch."""
    at = lambda t: F.lit(t.isoformat(sep=" ") + "+00:00").cast("timestamp")
    ids = F.coalesce(F.col("source_id").rlike(m.IDENTIFIER) & F.col("stream_id").rlike(m.IDENTIFIER), F.lit(False))
    count = F.size(F.coalesce("records", F.array()))
    envelope = (F.when(~ids, "identifier").when(F.coalesce(F.col("sequence"), F.lit(0)) < 1, "sequence").when(~F.coalesce(F.col("signal").isin(*m.SIGNALS), F.lit(False)), "signal")
                .when(~count.between(1, m.MAX_RECORDS), "records").when(~F.coalesce(F.col("observed_at").between(at(now - timedelta(days=m.OLDEST_BATCH_DAYS)), at(now + timedelta(minutes=m.FUTURE_MINUTES))), F.lit(False)), "observed_at"))
    key = ["source_id", "stream_id", "sequence"]
    records = validate_records(flatten(batches), now)
    keys = F.explode_outer(F.map_keys("attributes"))
    per_record = records.groupBy(*key).agg(F.max(F.when(F.size("broken") > 0, F.element_at("broken", 1))).alias("_record"))
    per_keys = records.select(*key, keys.alias("_key")).groupBy(*key).agg((F.countDistinct("_key") > m.MAX_BATCH_KEYS).alias("_keys"))
    groups = records.where("signal = 'metrics'").select(*key, F.struct("name", bucket_start(F.col("timestamp"), WIDTH), F.array_sort(F.map_entries("attributes"))).alias("_g"))
    per_groups = groups.groupBy(*key).agg((F.countDistinct("_g") > m.MAX_METRIC_GROUPS).alias("_groups"))
    joined = batches.withColumn("_envelope", envelope)
    for part in (per_record, per_keys, per_groups):
        joined = joined.join(part, key, "left")
    problem = F.coalesce("_envelope", "_record", F.when(F.col("_keys"), "distinct_keys"), F.when(F.col("_groups"), "metric_groups"))
    return joined.withColumn("problem", problem).drop("_envelope", "_record", "_keys", "_groups")


def distinct_keys(records: DataFrame) -> DataFrame:
    """Distinct attribute keys of each batch."""
    key = ["source_id", "stream_id", "sequence"]
    return records.select(*key, F.explode(F.map_keys("attributes")).alias("k")).groupBy(*key).agg(F.countDistinct("k").alias("distinct_keys"))


def batch_digest() -> Column:
    """SHA-256 of a batch's content in a fixed JSON form."""
    return F.sha2(F.to_json(F.struct("version", "source_id", "stream_id", "sequence", "observed_at", "signal", "records"), JSON_TIMES), 256)


def numbered(batches: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Batches of senders that keep no numbers, with the next sequence of their stream and the latest record's time as observed_at.

    Numbers go on from each stream's watermark in order of time, then content. A batch whose content is that of the
    watermark (content_digest) is a retry and gets the watermark's number again.
    """
    stream = ["source_id", "stream_id"]
    last = watermarks.select(*stream, F.col("sequence").alias("_last"), F.col("content_digest").alias("_last_content"))
    timed = batches.withColumns({"observed_at": F.array_max(F.transform("records", lambda r: r["timestamp"])), "content_digest": content_digest()}).dropDuplicates([*stream, "content_digest"])
    joined = timed.join(last, stream, "left").withColumn("_again", F.coalesce(F.col("content_digest") == F.col("_last_content"), F.lit(False)))
    place = F.sum(F.when(F.col("_again"), 0).otherwise(1)).over(Window.partitionBy(*stream).orderBy("observed_at", "content_digest").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("sequence", (F.coalesce("_last", F.lit(0)) + F.when(F.col("_again"), 0).otherwise(place)).cast("long")).drop("_last", "_last_content", "_again")


def content_digest() -> Column:
    """SHA-256 of what a batch says, without its number and time of sending."""
    return F.sha2(F.to_json(F.struct("version", "source_id", "stream_id", "signal", "records"), JSON_TIMES), 256)


def admit(arrivals: DataFrame, watermarks: DataFrame) -> DataFrame:
    """What becomes of each arrival (source_id, stream_id, sequence, digest, arrived), given each stream's last (sequence, digest).

    outcome: accepted, duplicate (the last or an accepted batch again), conflict (its number, other content),
    older_replay, or gap. Only the first of arrivals that share a number counts; numbers must follow on
    without a hole, so acceptance ends at the first hole of a stream.
    """
    stream = ["source_id", "stream_id"]
    base = arrivals.join(watermarks.select(*stream, F.col("sequence").alias("_last"), F.col("digest").alias("_last_digest")), stream, "left")
    last = F.coalesce("_last", F.lit(0))
    first_of = Window.partitionBy(*stream, "sequence").orderBy("arrived", "digest")
    firsts = base.withColumns({"_nth": F.row_number().over(first_of), "_first_digest": F.first("digest").over(first_of)})
    fresh = firsts.where((F.col("_nth") == 1) & (F.col("sequence") > last)).select(*stream, "sequence", (F.col("sequence") - last).alias("_step"))
    # A stream's run without holes has its n-th fresh number n steps above the watermark.
    runs = fresh.withColumn("_ok", F.row_number().over(Window.partitionBy(*stream).orderBy("sequence")) == F.col("_step")).select(*stream, "sequence", "_ok")
    every = firsts.join(runs, [*stream, "sequence"], "left")
    again = F.when(F.col("digest") == F.col("_first_digest"), "duplicate").otherwise("conflict")
    outcome = (F.when(F.col("sequence") < last, "older_replay")
               .when(F.col("sequence") == last, F.when(F.col("digest") == F.col("_last_digest"), "duplicate").otherwise("conflict"))
               .when(~F.coalesce("_ok", F.lit(False)), "gap").when(F.col("_nth") == 1, "accepted").otherwise(again))
    return every.withColumn("outcome", outcome).drop("_last", "_last_digest", "_nth", "_first_digest", "_ok")


def stream_gaps(batches: DataFrame) -> DataFrame:
    """Holes in each stream's numbers: the number before and after."""
    order = Window.partitionBy("source_id", "stream_id").orderBy("sequence")
    numbers = batches.select("source_id", "stream_id", "sequence").distinct()
    after = numbers.withColumn("next_sequence", F.lead("sequence").over(order))
    return after.where("next_sequence > sequence + 1")


def without_denied(attributes: Column) -> Column:
    """The attributes without those whose names look like credentials."""
    plain = lambda k: F.lower(F.regexp_replace(k, "[-./]", "_"))
    return F.map_filter(attributes, lambda k, _: ~plain(k).rlike("|".join(DENIED)))


def new_rows(observations: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose identity is not stored yet, one per identity."""
    key = list(m.IDENTITY)
    return observations.dropDuplicates(key).join(stored.select(*key), key, "left_anti")
