"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash of what survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_filter, may_hold, one_of_each, squeezed, stored

PREFIX_CHARS = 256


def _refined(docs: DataFrame, carry: dict[str, Column], text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with _xd_maybe (may have an equal), their lean rows (no text), and the groups of those that may.

    1. (length, prefix hash) of every row are counted, after map-side sums; lengths that occur once and then
       prefixes that occur once drop out, without any hash of the full text.
    2. Bit maps of what survives go to the scan, of bounded size, so that no text is shuffled to learn whether
       its row survives. Only rows that may survive hash their full text.
    3. Groups of equal (length, full hash) are summed; a hot group is summed on the map side first.
    """
    norm = squeezed(F.col(text))
    rows = docs.withColumns({"_xd_len": F.length(norm), "_xd_prefix": F.xxhash64(F.length(norm), F.substring(norm, 1, PREFIX_CHARS))})
    counts = stored(rows.groupBy("_xd_len", "_xd_prefix").agg(F.count(F.lit(1)).alias("_xd_n")), "prefix-groups")
    lengths = counts.groupBy("_xd_len").agg(F.sum("_xd_n").alias("_xd_m")).where("_xd_m > 1").select("_xd_len")
    survivors = stored(counts.where("_xd_n > 1").join(lengths, "_xd_len", "left_semi").select("_xd_prefix"), "prefixes")
    marked = may_hold(rows, F.col("_xd_prefix"), bit_filter(survivors), "_xd_maybe")
    lean = stored(
        marked.select(
            F.col(doc_id).alias("_xd_id"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("_xd_points"), "_xd_len",
            F.when(F.col("_xd_maybe"), F.sha2(norm, 256)).alias("_xd_full"), F.monotonically_increasing_id().alias("_xd_row"),
            *[c.alias(f"_xd_c{i}") for i, c in enumerate(carry.values())],
        ),
        "hashed",
    )
    best = F.min(F.struct((-F.col("_xd_points")).alias("p"), F.col("_xd_id").isNull().alias("z"), F.col("_xd_id").alias("i"), F.col("_xd_row").alias("r")))
    groups = lean.where("_xd_full is not null").groupBy("_xd_len", "_xd_full").agg(best.alias("_xd_best"), F.count(F.lit(1)).alias("_xd_size"))
    return marked, lean, stored(groups, "groups")


def exact_dedup(docs: DataFrame, carry: dict[str, Column], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: the ``carry`` expressions plus keep_id, group_size, kept.

    Texts are equal when identical after deleting the six white-space characters; a null text counts as
    empty, so null and blank rows form one group. The row with the most code points in its original text
    stays, then the smallest id (null ids last). Of fully repeated rows (same id and text) exactly one is
    kept. Other columns of ``docs`` never take part; an empty table gives an empty result.
    """
    _, lean, groups = _refined(docs, carry, text, doc_id)
    own = [F.col(f"_xd_c{i}").alias(name) for i, name in enumerate(carry)]
    alone = lean.where("_xd_full is null").select(*own, F.col("_xd_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    grouped = lean.where("_xd_full is not null").join(groups, ["_xd_len", "_xd_full"]).select(
        *own, F.col("_xd_best.i").alias("keep_id"), F.col("_xd_size").cast("long").alias("group_size"), (F.col("_xd_best.r") == F.col("_xd_row")).alias("kept"))
    return alone.unionByName(grouped)


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, one of each group of equal texts as in ``exact_dedup``, in their own columns.

    Rows that surely have no equal pass without a shuffle; the others are looked up among those that stay, by
    128 bits of the hash of id and text. Of rows with the same id and text the one of the least hash over all
    its columns stays.
    """
    keys = {"_xk_1": F.xxhash64(F.col(doc_id), F.col(text)), "_xk_2": F.xxhash64(F.lit(1), F.col(doc_id), F.col(text))}
    marked, lean, groups = _refined(docs, keys, text, doc_id)
    stay = lean.where("_xd_full is not null").join(groups, ["_xd_len", "_xd_full"]).where("_xd_best.r = _xd_row").select(F.col("_xd_c0").alias("_xk_1"), F.col("_xd_c1").alias("_xk_2"))
    several = marked.where("_xd_maybe").withColumns(keys).join(stay, ["_xk_1", "_xk_2"], "left_semi")
    return marked.where("not _xd_maybe").select(docs.columns).unionByName(one_of_each(several, ["_xk_1", "_xk_2"], docs.columns))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = exact_dedup(docs, {"doc_id": F.col("doc_id"), "text_sha256": F.sha2(squeezed(F.col("text")), 256)})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
