"""Fill-in-the-middle: whole texts cut at line ends and put in another order, by DuckDB SQL over each Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name, map_batches, text_bytes

#: Marks of prefix, suffix and middle, and the pattern of a line.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINE = r"[^\n]*\n|[^\n]+"
#: Share of texts that are cut, and of the cut ones that put their suffix first; in percent.
RATE, SUFFIX_FIRST = 100, 50
#: Text bytes that DuckDB holds at once, or one longer text.
SLICE_BYTES = 8 << 20
#: What the operator can tell of each row, in order, with types.
RESULTS = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType(), "output_sha256": T.StringType(), "restored": T.StringType(), "restored_sha256": T.StringType()}


def cut_sql(table: str, keep: str, seed: int, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> str:
    """SQL over ``table`` (id, text): the ``keep`` columns beside all of RESULTS, a row for each row and in its order.

    What decides about a row are the first groups of eight digits of a SHA-256 of seed and id. ``restored`` is read
    back from output and form alone: no text that is cut holds a mark, so each mark stands once in its output.
    """
    return rf"""
WITH texts AS (SELECT *, coalesce(text, '') AS whole, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS digest FROM {table}),
lines AS (SELECT *, regexp_extract_all(whole, '{LINE}') AS units, [('0x' || substr(digest, 8 * k + 1, 8))::UBIGINT FOR k IN [0, 1, 2, 3]] AS h FROM texts),
places AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT AS first_cut, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1))::BIGINT AS last_cut,
  CASE WHEN whole = '' OR contains(whole, '{PREFIX}') OR contains(whole, '{SUFFIX}') OR contains(whole, '{MIDDLE}') OR h[3] % 100 >= {rate} THEN 'plain'
       WHEN h[4] % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM lines),
parts AS (SELECT *, array_to_string(list_slice(units, 1, first_cut), '') AS head, array_to_string(list_slice(units, first_cut + 1, last_cut), '') AS mid, array_to_string(list_slice(units, last_cut + 1, n), '') AS tail FROM places),
made AS (SELECT *, CASE form WHEN 'plain' THEN whole WHEN 'psm' THEN '{PREFIX}' || head || '{SUFFIX}' || tail || '{MIDDLE}' || mid
  ELSE '{SUFFIX}' || tail || '{PREFIX}' || head || '{MIDDLE}' || mid END AS output FROM parts),
read_back AS (SELECT *, split_part(output, '{MIDDLE}', 1) AS front, split_part(output, '{MIDDLE}', 2) AS inner_part FROM made),
back AS (SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN substr(split_part(front, '{SUFFIX}', 1), {len(PREFIX) + 1}) || inner_part || split_part(front, '{SUFFIX}', 2)
  ELSE split_part(front, '{PREFIX}', 2) || inner_part || substr(split_part(front, '{PREFIX}', 1), {len(SUFFIX) + 1}) END AS restored FROM read_back)
SELECT {keep} FROM (SELECT *, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM back)
"""


def fill_in_middle(docs: DataFrame, results: dict[str, str], seed: int = 7, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all of ``docs`` by default) and the wanted ``results``: names of RESULTS with the column name of each.

    A text is cut into lines, prefix, middle and suffix at two places that the id's hash gives, and written with the
    suffix before the middle (psm) or first (spm). Empty and null texts, texts that hold a mark and those beyond
    ``rate`` stay as they are (plain; its counts are null). A null id counts as an empty one, rows that repeat are
    cut alike, and a result whose name a column of ``docs`` has is told under a longer one. Each Arrow batch is
    registered with DuckDB, in slices of ``SLICE_BYTES``; no row is moved and other columns are not read by it.
    """
    unknown = set(results) - set(RESULTS)
    if unknown or not results:
        raise ValueError(f"no such results: {sorted(unknown)}" if unknown else "no result is asked for")
    carry = docs.columns if carry is None else carry
    *own, key, body = free_name(docs, *results.values(), "fim_id", "fim_text")
    rows = docs.select(*carry, F.col(doc_id).cast("string").alias(key), F.col(text).alias(body))
    kept = rows.select(*carry).schema.fields
    schema = T.StructType([*kept, *[T.StructField(name, RESULTS[r]) for name, r in zip(own, results)]])
    sql = cut_sql("batch", ", ".join(f"{r}::{'BIGINT' if RESULTS[r] == T.LongType() else 'VARCHAR'} AS {r}" for r in results), seed, rate, suffix_first)
    n_kept, names = len(kept), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # One thread keeps a batch's order; nothing is written to a local disk.
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})
        for batch in batches:
            ids, texts = batch.column(n_kept), batch.column(n_kept + 1)
            _, offsets = text_bytes(texts)
            for i, j in chunks(np.asarray(offsets), SLICE_BYTES):
                con.register("batch", pa.table({"id": ids.slice(i, j - i), "text": texts.slice(i, j - i)}))
                made = con.sql(sql).to_arrow_table().combine_chunks()
                con.unregister("batch")
                columns = [c.slice(i, j - i) for c in batch.columns[:n_kept]] + [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made.columns]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_batches(rows, run, schema)


DIGESTS = {r: r for r in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")}


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"), DIGESTS, carry=["doc_id"])


#: Written apart from ``cut_sql``; what is rebuilt has to be the text itself.
OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::UBIGINT % (len(u) + 1) AS a, ('0x' || x[9:16])::UBIGINT % (len(u) + 1) AS b, ('0x' || x[25:32])::UBIGINT % 100 AS s FROM d),
f AS (SELECT *, t = '' OR regexp_matches(t, '<[PSM]>') AS plain, array_to_string(u[1:least(a, b)::BIGINT], '') AS p, array_to_string(u[(least(a, b) + 1)::BIGINT:greatest(a, b)::BIGINT], '') AS m,
             array_to_string(u[(greatest(a, b) + 1)::BIGINT:], '') AS e FROM h)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN s < 50 THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN s < 50 THEN '<S>' || e || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || e || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
