"""Raw segments: admitted batches as text with the digest of their content, and the checked way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as m
from ..functions.typed import utc_date
from ..operators.lifecycle import cold_segments
from .ingest import JSON_TIMES, batch_digest, flatten


def raw_segments(batches: DataFrame) -> DataFrame:
    """One row per batch: its number, signal and UTC day, its content as JSON with both digests, and its catalogue facts."""
    times = F.transform("records", lambda r: r["timestamp"])
    content = F.to_json(F.struct(*m.BATCH.fieldNames()), JSON_TIMES)
    return batches.withColumn("content", content).select(
        "source_id", "stream_id", "sequence", batch_digest().alias("digest"), F.sha2("content", 256).alias("checksum"), F.octet_length("content").cast("long").alias("bytes"), F.size("records").alias("records"),
        F.array_min(times).alias("first_observed"), F.array_max(times).alias("last_observed"), "content", "signal", utc_date(F.col("observed_at")).alias("date"))


def parsed_segments(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batches of segments whose content has its checksum and digest, and the segments that fail."""
    parsed = segments.withColumn("_b", F.from_json("content", m.BATCH, JSON_TIMES))
    sound = F.coalesce((F.sha2("content", 256) == F.col("checksum")) & F.col("_b").isNotNull(), F.lit(False))
    return parsed.where(sound).select("_b.*"), segments.where(~F.coalesce(F.sha2("content", 256) == F.col("checksum"), F.lit(False)))


def cold_observations(segments: DataFrame, catalogue: DataFrame, scopes: DataFrame, signal: str, organization: str, since: Column | None = None) -> DataFrame:
    """Observations of cold segments that a look-back may reach, read from their raw content.

    ``catalogue`` has (digest, tier, organization_id, signal, last_observed); only its rows in scope that are not
    older than ``since`` are read.
    """
    wanted = cold_segments(catalogue, signal, organization, since).select("digest")
    batches, _ = parsed_segments(segments.where(F.col("signal") == signal).join(wanted, "digest", "left_semi"))
    return flatten(batches, scopes)
