"""Sparse logarithmic histograms: buckets of 1/64 in log1p of the magnitude, mergeable by adding counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 64


def bucket(value: Column) -> Column:
    """0 for 0, else the signed, rounded log position, away from 0 by one; halves round away from zero."""
    place = F.round(F.log1p(F.abs(value)) * STEPS).cast("bigint") + 1
    return F.when(value == 0, F.lit(0).cast("bigint")).when(value > 0, place).otherwise(-place)


def bucket_value(b: Column) -> Column:
    """The middle of a bucket."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * F.expm1((F.abs(b) - 1) / F.lit(float(STEPS))))


def percentiles(counts: DataFrame, by: list[str], shares: list[tuple[str, float]], bucket: str = "bucket", count: str = "n") -> DataFrame:
    """Per group, columns named by ``shares``: the first bucket whose running count reaches ceil(share x total)."""
    merged = counts.groupBy(*by, bucket).agg(F.sum(count).alias("_c"))
    upto = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    summed = merged.withColumns({"_upto": F.sum("_c").over(upto), "_all": F.sum("_c").over(Window.partitionBy(*by))})
    reached = lambda share: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(share) * F.col("_all")), F.col(bucket)))
    got = summed.groupBy(*by).agg(*[reached(share).alias(name) for name, share in shares])
    return got.select(*by, *[bucket_value(F.col(name)).alias(name) for name, _ in shares])
