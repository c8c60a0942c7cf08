"""Ranked lexical search: an inverted index of each document shard, searched by WAND, and the shards' heaps merged."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, chunks, discard, map_batches, stored, text_bytes, word_bounds, word_hashes

TOP = 10
#: Text bytes of one document shard's index, or one longer text.
SHARD_BYTES = 32 << 20
#: Text bytes of the queries that are searched in one pass; more queries are taken in blocks.
BLOCK_BYTES = 1 << 20
#: Documents that are scored at once from a pivot on; 1 is the textbook algorithm.
WINDOW_DOCS = 128
_FILTER_BITS = 20
_INDEX = [("n", "binary"), ("term", "binary"), ("start", "binary"), ("place", "binary"), ("tf", "binary"), ("n_texts", "long"), ("n_terms", "long")]


def query_terms(text: str | None) -> set[int]:
    """Hashes of a query's terms."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
    return set(word_hashes(data, starts, ends).tolist())


class _Shard:
    """Postings of the terms that are asked for, gathered text by text."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.may = terms, np.zeros(1 << _FILTER_BITS, bool)
        self.may[(terms >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.clear()

    def clear(self) -> None:
        self.bytes, self.rows, self.ids, self.lengths, self.found = 0, 0, [], [], []

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        data = LOWER[data[offsets[0] : offsets[-1]]]
        starts, ends, first = word_bounds(data, offsets - offsets[0], ALNUM)
        hashes = word_hashes(data, starts, ends)
        near = np.flatnonzero(self.may[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, hashes[near]), len(self.terms) - 1)
        hit = self.terms[at] == hashes[near]
        row = np.searchsorted(first, near[hit], side="right") - 1
        key, tf = np.unique(row * len(self.terms) + at[hit], return_counts=True)
        self.found.append((key // len(self.terms) + self.rows, key % len(self.terms), tf))
        self.ids.append(ids)
        self.lengths.append(np.diff(first))
        self.rows += len(ids)
        self.bytes += len(data)

    def record(self, schema: pa.Schema) -> pa.RecordBatch:
        """One row: ids in order, text lengths, and postings by term and place in that order."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, sort_keys=[("", "ascending")]).to_numpy()  # null ids come last
        n = np.concatenate(self.lengths)[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row, term, tf = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        by = np.lexsort((place[row], term))
        held, start = np.unique(term[by], return_index=True)
        blobs = [n.astype(np.int64), held.astype(np.int32), np.append(start, len(by)).astype(np.int64), place[row][by].astype(np.int32), tf[by].astype(np.int32)]
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        return pa.RecordBatch.from_arrays([ids, *[pa.array([b.tobytes()], pa.binary()) for b in blobs], pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], schema=schema)


def shard_indexes(docs: DataFrame, terms: np.ndarray, text: str, doc_id: str) -> DataFrame:
    """One row a document shard: its part of the index for ``terms`` (sorted hashes), and its counts of texts and terms."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("ids", T.ArrayType(kind)), *T._parse_datatype_string(",".join(f"{n} {k}" for n, k in _INDEX)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, arrow = _Shard(terms), None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([("ids", pa.list_(batch.column(0).type)), *[(n, pa.binary() if k == "binary" else pa.int64()) for n, k in _INDEX]])
            data, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets):
                shard.add(batch.column(0).slice(i, j - i), data, offsets[i : j + 1])
                if shard.bytes >= SHARD_BYTES:
                    yield shard.record(arrow)
                    shard.clear()
        if shard.rows:
            yield shard.record(arrow)

    return map_batches(rows, run, schema)


def document_counts(indexes: DataFrame) -> DataFrame:
    """(term, df) summed over the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for term, start in zip(*[batch.column(c).to_pylist() for c in ("term", "start")]):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(term, np.int32)), pa.array(np.diff(np.frombuffer(start, np.int64)))], names=["term", "df"])

    return map_batches(indexes.select("term", "start"), run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def wand(postings: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, top: int = TOP, window: int = WINDOW_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``top`` documents, best first, equal scores by place.

    ``postings``: for each term its documents' places (ascending), impacts (none below 0) and maximum impact. The
    threshold is the least score of a full heap; at first that of the documents of the strongest terms. Terms are
    ordered by their next document; the pivot is the first at which the maxima of all terms up to it reach the
    threshold. No document before the pivot's can, so all cursors jump there. From there on ``window`` documents
    are scored at once. A document whose score equals the threshold may still win by its place.
    """
    postings = [p for p in postings if p[2] > 0]
    heap_at, heap_score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    primed = np.zeros(0, np.int64)
    for places, _, _ in sorted(postings, key=lambda p: -p[2]):
        if len(primed) >= top:
            break
        primed = np.union1d(primed, places[: 4 * top])
    if len(primed) >= top:
        scores = np.zeros(len(primed), np.int64)
        for places, impacts, _ in postings:
            at = np.minimum(np.searchsorted(places, primed), len(places) - 1)
            scores += np.where(places[at] == primed, impacts[at], 0)
        least = max(1, int(np.partition(scores, -top)[-top]))
    most = np.array([p[2] for p in postings], np.int64)
    cursor = [0] * len(postings)
    heads = np.array([int(p[0][0]) for p in postings], np.int64)
    while len(heads):
        order = np.argsort(heads, kind="stable")
        reach = np.cumsum(most[order])
        pivot = int(np.searchsorted(reach, least))
        if pivot == len(order) or (low := int(heads[order[pivot]])) >= n_docs:
            break
        high = low + window
        score = np.zeros(window, np.int64)
        for t in np.flatnonzero(heads < high).tolist():
            places, impacts, _ = postings[t]
            a = cursor[t] + int(np.searchsorted(places[cursor[t] :], low)) if heads[t] < low else cursor[t]
            b = a + int(np.searchsorted(places[a : a + window], high))
            score[places[a:b] - low] += impacts[a:b]
            cursor[t] = b
            heads[t] = places[b] if b < len(places) else n_docs
        good = np.flatnonzero(score >= least)
        if len(good):
            heap_at, heap_score = np.concatenate([heap_at, good + low]), np.concatenate([heap_score, score[good]])
            best = np.lexsort((heap_at, -heap_score))[:top]
            heap_at, heap_score = heap_at[best], heap_score[best]
            if len(best) == top:
                least = max(least, int(heap_score[-1]))
    return heap_at, heap_score


def _searched(indexes: DataFrame, asked: list[np.ndarray], ids: pa.Array, kind: T.DataType, weights: np.ndarray, n_texts: int, n_terms: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): each shard's best documents of each query; ``asked`` has the term numbers of each."""
    doc_kind = indexes.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("doc_id", doc_kind), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("ids").slice(i, 1).flatten()
                n, held, start, place, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("n", np.int64), ("term", np.int32), ("start", np.int64), ("place", np.int32), ("tf", np.int32)))
                if not len(held):
                    continue
                length = 10 + (90 * n * n_texts) // n_terms
                tf = tf.astype(np.int64)
                impact = np.repeat(weights[held], np.diff(start)) * ((1_000_000_000 * tf) // (1_000 * tf + 8 * length[place]))
                most = np.maximum.reduceat(impact, start[:-1])
                for q, terms in enumerate(asked):
                    at = np.searchsorted(held, terms)
                    at = at[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == terms)]
                    found, scores = wand([(place[start[t] : start[t + 1]], impact[start[t] : start[t + 1]], int(most[t])) for t in at], len(n), top)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(found), q))), own.take(pa.array(found)), pa.array(scores)], names=["item_id", "doc_id", "score"])

    return map_batches(indexes, run, schema)


def ranked_search(docs: DataFrame, queries: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each query by summed term weights, equal scores by id.

    Terms are runs of digits, letters and non-ASCII characters, A-Z lower-cased, told apart by 64-bit hashes; a term
    counts once in a query. Rows of one item id are one query; null and empty texts have no terms, and a query of
    none, or without a match, has no row. A null item or document id is an id like any other, the last in order;
    documents that repeat are ranked each for itself. Other columns take no part.

    Every text is indexed whole, once a block of queries (``block_bytes`` of their text, whose terms and weights are
    the only things held by the driver and sent to tasks); the index is a stored table of one row a shard. Each
    shard gives ``top`` rows a query at most, and Spark cuts them to ``top`` again before they meet.
    """
    items = queries.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = []
    for b in range(blocks):
        part = (items if blocks == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        ids = part.column("id").combine_chunks() if part.num_rows else pa.array([], part.schema.field("id").type)
        code = pc.dictionary_encode(ids, null_encoding="encode")
        asked = [set() for _ in range(len(code.dictionary))]
        for q, t in zip(code.indices.to_pylist(), part.column("text").to_pylist()):
            asked[q] |= query_terms(t)
        terms = np.array(sorted(set().union(*asked)), np.uint64)
        if not len(terms):
            continue
        indexes = stored(shard_indexes(docs, terms, text, doc_id), "index")
        total = indexes.agg(F.sum("n_texts").alias("n"), F.sum("n_terms").alias("l")).first()
        weights = np.zeros(len(terms), np.int64)
        for r in document_counts(indexes).collect():  # a row a term of the block at most
            weights[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
        numbers = [np.searchsorted(terms, np.array(sorted(a), np.uint64)).astype(np.int32) for a in asked]
        found.append(stored(_searched(indexes, numbers, code.dictionary, items.schema["id"].dataType, weights, total["n"] or 0, total["l"] or 0, top), "found"))
        discard(indexes)
    if not found:
        found = [docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", items.schema["id"].dataType), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))]
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH lowered AS (SELECT doc_id AS id, 'd' AS side, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT item_id, 'q', translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT id, side, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM lowered),
docs AS (SELECT id, ws, len(ws)::BIGINT AS n FROM words WHERE side = 'd' AND len(ws) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM docs),
tf AS (SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(ws) AS term FROM docs) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
asked AS (SELECT DISTINCT id AS item_id, unnest(ws) AS term FROM words WHERE side = 'q'),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
scored AS (SELECT item_id, tf.id AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * big_n) // l)))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs ON docs.id = tf.id CROSS JOIN total GROUP BY item_id, tf.id)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
