"""Mixing sources to target weights by entropy balancing: tilted document rates, rounded into whole copies."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, hashable, n_words, ship, stored

MAX_RATE = 3.0
TOLERANCE = 1e-9
MAX_STEPS = 60
#: Documents of one (source, size) cell that are ranked together, on average, and the parts that a cell is dealt to at most.
CELL_ROWS, MAX_SPLITS = 256, 10_000
#: Single-copy corrections of each source after the systematic rounding.
FITS = 4


def _ranked(sources: DataFrame) -> DataFrame:
    """The distinct sources with their place (from 0) by code point, null last: sorted by ranges, each after the rows of those before."""
    order = F.col("source").asc_nulls_last()
    placed = sources.repartitionByRange(order).sortWithinPartitions(order).select("source", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth"))
    placed = stored(placed, "sources")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # of one row a partition
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("k")).select("part", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select("source", (F.col("start") + F.col("nth")).alias("place"))


def source_targets(sizes: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Per source: its size and target. ``sizes`` has (source, size, n); one row a source comes out.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the whole size. A target stops at
    ``max_rate`` times its source's size and the excess goes to the others by weight, until none is above: each
    round is two sums over the sources, and ends when no further source is full.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    p, r = per.alias("p"), _ranked(sizes.select("source").distinct()).alias("r")
    weighed = p.join(r, F.col("p.source").eqNullSafe(F.col("r.source"))).select("p.source", "source_size", (F.col("place") % 3 + 1).cast("double").alias("weight"))
    weighed = stored(weighed.withColumn("cap", F.lit(float(max_rate)) * F.col("source_size")), "source-weights")
    total, level, full = weighed.agg(F.sum("source_size")).first()[0] or 0, None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level >= F.col("cap")
        count, held, weights = weighed.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight")))).first()
        if count == full or not weights:
            break
        full, level = count, (total - held) / weights
    # Where all are full, as when the whole size is 0, every target is its cap.
    return weighed.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level if level is not None else 0.0)).alias("target"))


def balanced_rates(sizes: DataFrame, targets: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """Tilt of each source: rates min(max_rate, exp(tilt x size / mean size)) whose tokens meet the target.

    These rates are the entropy-balancing solution: nearest to one copy of everything in relative entropy,
    within the rate limit, under the token constraint of every source. The dual is convex and its Hessian is
    diagonal over sources, so each source is solved by itself from its part of the (source, size) histogram, at most
    one row per size, whatever the number of documents. Sources at their cap need no tilt (all rates are
    max_rate), sources without tokens keep one copy.
    """
    h, g = sizes.where("size > 0").alias("h"), targets.alias("g")
    hist = h.join(g, F.col("h.source").eqNullSafe(F.col("g.source"))).select("h.source", F.col("h.size").cast("double").alias("size"), F.col("h.n").cast("double").alias("n"), F.col("source_size").cast("double").alias("source_size"), "target")
    schema = T.StructType([sizes.schema["source"], T.StructField("mean", T.DoubleType()), T.StructField("tilt", T.DoubleType()), T.StructField("capped", T.BooleanType()), T.StructField("met", T.BooleanType())])

    def solved(part: pa.Table) -> pa.Table:
        size, n = (part.column(c).to_numpy() for c in ("size", "n"))
        order = np.argsort(size)
        of, target = (part.column(c)[0].as_py() for c in ("source_size", "target"))
        capped, mean = target >= max_rate * of * (1 - 1e-12), of / n.sum()
        tilt, met = (0.0, True) if capped else _tilt(size[order], n[order], mean, target, max_rate)
        return pa.table([part.column("source").slice(0, 1), *[pa.array([x]) for x in (mean, tilt, capped, met)]], names=schema.names)

    ship(sizes.sparkSession)
    got = stored(hist.groupBy("source").applyInArrow(solved, schema), "tilts")
    if unmet := got.where("not met").count():
        warnings.warn(f"the tilts of {unmet} sources have not met their targets in {MAX_STEPS} steps", stacklevel=2)
    return got.drop("met")


def _tilt(size: np.ndarray, n: np.ndarray, mean: float, target: float, max_rate: float) -> tuple[float, bool]:
    """The tilt of one source and whether it meets the target: Newton steps on the dual; those that leave the bracket of the root fall back to its middle."""
    x, tokens, tilt, low, high = size / mean, size * n, 0.0, -1e3, 1e3
    for _ in range(MAX_STEPS):
        free = np.exp(np.minimum(tilt * x, 50.0))
        gap = (tokens * np.minimum(free, max_rate)).sum() - target
        if abs(gap) <= TOLERANCE * target:
            return tilt, True
        slope = (tokens * free * x)[free < max_rate].sum()  # 0 where no rate can move
        low, high = tilt if gap < 0 else low, tilt if gap > 0 else high
        step = tilt - gap / slope if slope > 0 else low
        tilt = float(step if low < step < high else (low + high) / 2)
    return tilt, False


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", max_rate: float = MAX_RATE, carry: list[str] | None = None) -> DataFrame:
    """Copies of each document so that every source's words come near its target.

    Columns: ``carry`` (default: the id), size, source_size, target, copies, taken (= copies x size). Sizes
    are white-space separated words, 0 for null; documents of size 0 get one copy and take nothing. Rates are rounded by
    systematic sampling in order of size within a source, then single copies of fitting sizes close what is
    left of the gap, up to FITS of them. Cells of equal (source, size) are split by a hash of id and text before
    ranking; the ranks of a cell decide which of its equal-sized documents get the extra copy. Reruns agree.
    An empty table gives an empty result.
    """
    carry = carry or [doc_id]
    rows = docs.select(*[F.col(c).alias(f"_mx_c{i}") for i, c in enumerate(carry)], F.col(source).alias("_mx_source"), n_words(F.col(text)).alias("_mx_size"),
                       F.xxhash64(F.col(doc_id)).alias("_mx_a"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_mx_b"))
    lean = stored(rows, "sizes")
    hist = stored(lean.groupBy(F.col("_mx_source").alias("source"), F.col("_mx_size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "size-histogram")
    targets = stored(source_targets(hist, max_rate), "targets")
    tilts = balanced_rates(hist, targets, max_rate)

    # One row per (source, size): rate, whole copies, fraction, and the fractions before it in size order.
    h, g, t = hist.alias("h"), targets.alias("g"), tilts.alias("t")
    rate = F.when(F.col("t.capped"), F.lit(max_rate)).when(F.col("t.tilt").isNull(), F.lit(1.0)).otherwise(
        F.least(F.lit(max_rate), F.exp(F.least(F.col("t.tilt") * F.col("h.size") / F.col("t.mean"), F.lit(50.0)))))
    cells = h.join(g, F.col("h.source").eqNullSafe(F.col("g.source"))).join(t, F.col("h.source").eqNullSafe(F.col("t.source")), "left").select(
        F.col("h.source").alias("source"), F.col("h.size").alias("size"), F.col("h.n").alias("n"), "g.source_size", "g.target", rate.alias("rate"))
    cells = cells.withColumns({"whole": F.floor("rate"), "part": F.col("rate") - F.floor("rate"), "splits": F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(MAX_SPLITS))})
    # At most one row per size in a source, whatever the number of documents.
    so_far = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("part") * F.col("n")).over(so_far), F.lit(0.0)) + 0.5
    cells = cells.withColumn("before", before).withColumn("extra", F.floor(F.col("before") + F.col("part") * F.col("n")) - F.floor("before"))
    # What whole copies still miss: one copy more or less of the best-fitting size, a few times.
    own = Window.partitionBy("source")
    for _ in range(FITS):
        gap = F.col("target") - F.sum(F.col("size") * (F.col("whole") * F.col("n") + F.col("extra"))).over(own)
        more = (F.col("gap") > 0) & (F.col("extra") < F.col("n")) & (F.col("whole") < max_rate)
        change = F.when(more, 1).when((F.col("gap") < 0) & (F.col("extra") > 0), -1).otherwise(0)
        gain = F.abs("gap") - F.abs(F.col("gap") - F.col("change") * F.col("size"))
        best = F.max(F.struct("gain", "size")).over(own)
        cells = cells.withColumn("gap", gap).withColumn("change", change).withColumn("gain", gain).withColumn("best", best)
        chosen = (F.col("best.gain") > 0) & (F.col("best.size") == F.col("size"))
        cells = cells.withColumn("extra", F.col("extra") + F.when(chosen, F.col("change")).otherwise(0)).drop("gap", "change", "gain", "best")
    cells = stored(cells.drop("n", "part", "before", "rate"), "cells")

    d, c = lean.alias("d"), cells.alias("c")
    placed = d.join(c, F.col("d._mx_source").eqNullSafe(F.col("c.source")) & (F.col("d._mx_size") == F.col("c.size"))).select(
        "d.*", "source", "size", "source_size", "target", "whole", "extra", F.pmod(F.col("_mx_b"), F.col("splits")).alias("split"))
    counts = placed.groupBy("source", "size", "split").agg(F.count(F.lit(1)).alias("k"))
    at_split = Window.partitionBy("source", "size").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("k").over(at_split), F.lit(0))).drop("k")
    p, o = placed.alias("p"), offsets.alias("o")
    numbered = p.join(o, F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.size") == F.col("o.size")) & (F.col("p.split") == F.col("o.split"))).select("p.*", "ahead")
    rank = F.row_number().over(Window.partitionBy("source", "size", "split").orderBy("_mx_a", "_mx_b")) + F.col("ahead")
    copies = F.col("whole") + F.when(F.col("_mx_rank") <= F.col("extra"), 1).otherwise(0)
    return numbered.withColumn("_mx_rank", rank).select(
        *[F.col(f"_mx_c{i}").alias(name) for i, name in enumerate(carry)],
        F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"),
        copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents with at least one copy, in their own columns plus size, source_size, target, taken and copies.

    An input column of one of these names (in any case) is kept and the added one gets underscores in front. Of
    rows of one id and text, each has its own copies: they are numbered and so told apart.
    """
    names = free_name(docs, "size", "source_size", "target", "taken", "copies")
    own = [f"_my_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(docs.columns, own)], F.col(doc_id).alias("_my_id"), F.col(text).alias("_my_text"), F.col(source).alias("_my_source"))
    keys = {"_my_k1": F.xxhash64("_my_id", "_my_text"), "_my_k2": F.xxhash64(F.lit(1), "_my_id", "_my_text", "_my_source")}
    rows = rows.withColumns(keys)
    got = stored(mix_sources(rows.select("_my_id", "_my_text", "_my_source", *keys), "_my_text", "_my_id", "_my_source", carry=list(keys)), "copies")
    # Rows with the same id, text and source are alike in all that the mix looks at: only how many get which copies matters.
    shares = got.groupBy(*keys, "size", "source_size", "target", "copies", "taken").agg(F.count(F.lit(1)).alias("_my_n"))
    upto = F.sum("_my_n").over(Window.partitionBy(*keys).orderBy(F.col("copies").desc()).rowsBetween(Window.unboundedPreceding, 0))  # a row for each number of copies
    shares = stored(shares.withColumn("_my_upto", upto), "copy-shares")
    several = shares.groupBy(*keys).agg(F.sum("_my_n").alias("m")).where("m > 1").select(*keys, F.lit(True).alias("_my_several"))
    added = [F.col(c).alias(n) for c, n in zip(("size", "source_size", "target", "taken", "copies"), names)]
    kept = [F.col(n).alias(c) for c, n in zip(docs.columns, own)]
    alone = shares.where("copies > 0").join(several, list(keys), "left_anti")
    out = rows.join(alone, list(keys)).select(*kept, *added)
    repeated = rows.join(several, list(keys)).withColumn("_my_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*[c for c in own if hashable(rows.schema[c].dataType)]))))
    told = repeated.join(shares, list(keys)).where("copies > 0 and _my_nth <= _my_upto and _my_nth > _my_upto - _my_n")
    return out.unionByName(told.select(*kept, *added))


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
