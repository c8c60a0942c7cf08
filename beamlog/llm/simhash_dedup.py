"""SimHash near-dedup: deletion-variant signatures of two half-fingerprints, equality grouping, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NON_SPACE, chunks, map_batches, stored, text_bytes, word_bounds
from .windows import joined_words

SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
#: Distinct fingerprints that one variant's group compares directly; members of larger groups link by two-wildcard variants.
GROUP_LIMIT = 1024
HALF = 32


def _chunk_fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit fingerprint per row."""
    data = LOWER[data]
    bounds = word_bounds(data, offsets, NON_SPACE)
    first = bounds[2]
    words, place = joined_words(data, offsets, bounds=bounds)
    raw, n = words.tobytes(), np.diff(first)
    shingles = np.where(n == 0, 0, np.maximum(1, n - SHINGLE_WORDS + 1))
    row = np.repeat(np.arange(len(n)), shingles)
    begin = np.concatenate([[0], np.cumsum(shingles)])
    at = first[row] + np.arange(len(row)) - begin[row]
    stop = np.minimum(at + SHINGLE_WORDS, first[row + 1])
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(raw[s:e], SEED) for s, e in zip(place[at].tolist(), (place[stop] - 1).tolist())]), np.uint8).reshape(-1, 8)
    out = np.zeros(len(n), np.uint64)
    for r in np.flatnonzero(shingles):
        a, b = begin[r], begin[r + 1]
        ones = np.unpackbits(hashes[a:b], axis=1).sum(axis=0, dtype=np.int64)
        out[r] = np.packbits(2 * ones > b - a).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` columns and fp (the 64 bits as a long). A null text or one without words has fingerprint 0.

    Words are lower-cased (A-Z) runs of other bytes than the six white-space ones; a shingle is 3 words joined
    by a space, or all words of a shorter text. A bit is set if it is set in over half the shingles' XXH64.
    """
    rows = docs.select(*[F.col(c).alias(f"_s_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_s_text"))
    schema = T.StructType([*[rows.schema[f"_s_c{i}"] for i in range(len(carry))], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_s_text"))
            for i, j in chunks(offsets):
                lo, hi = int(offsets[i]), int(offsets[j])
                fp = _chunk_fingerprints(data[lo:hi], offsets[i : j + 1] - lo)
                yield pa.RecordBatch.from_arrays([*[batch.column(f"_s_c{c}").slice(i, j - i) for c in range(len(carry))], pa.array(fp.view(np.int64))], names=schema.names)

    return map_batches(rows, run, schema).toDF(*carry, "fp")


def deletion_variants(fp: Column) -> Column:
    """64 keys: each half-fingerprint with one of its 32 bits deleted, tagged with the half and the bit.

    Two fingerprints within 3 bits differ by at most one bit in one of the halves, and so share the key that
    deletes that bit (or all 32 of the half if it is equal).
    """
    keys = []
    for half in range(2):
        part = F.shiftrightunsigned(fp, HALF * half).bitwiseAND(F.lit((1 << HALF) - 1))
        for bit in range(HALF):
            keys.append(part.bitwiseAND(F.lit(((1 << HALF) - 1) ^ (1 << bit))).bitwiseOR(F.lit((half * HALF + bit) << HALF)))
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE  # of signed numbers it would count the absolute value


def _forest(group: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that span the components of one group under the distance: each member with its component's first."""
    left = np.arange(len(group))
    a, b = [], []
    while len(left):
        front, rest = left[:1], left[1:]
        root = front[0]
        while len(front) and len(rest):
            close = np.zeros(len(rest), bool)
            for i in front:
                close |= _near(group[rest], group[i])
            front, rest = rest[close], rest[~close]
            a += [int(group[root])] * len(front)
            b += [int(x) for x in group[front]]
        left = rest
    return a, b


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp) sorted by key: verified links of each group."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def settle(keys, fps):
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(heads, len(keys)))
        two = heads[sizes == 2]
        two = two[_near(fps[two], fps[two + 1])]
        a, b = fps[two].tolist(), fps[two + 1].tolist()
        for h, n in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = _forest(fps[h : h + n])
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy()])
        if len(keys):
            last = int(np.searchsorted(keys, keys[-1], side="left"))  # the last group may go on
            if last:
                yield settle(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield settle(keys, fps)


def _two_wildcards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under all C(64, 2) masks of two deleted bits; equal (mask, rest) means within 2 bits."""
    pairs = [(i, j) for i in range(64) for j in range(i)]
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for m, (i, j) in enumerate(pairs):
            rest = fps & ~np.uint64((1 << i) | (1 << j))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), m, np.int32)), pa.array(rest.view(np.int64)), batch.column("fp")], names=["mask", "rest", "fp"])


def near_links(distinct: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs within 2 bits.

    Variants that one fingerprint alone has drop out by a grouped count; the others meet by an equality join with
    those counts, which AQE may split. Every link is verified. Within one variant's group only a spanning forest of
    its links is returned, so no group yields all its pairs. The members of groups over ``limit`` never come
    together: equal two-wildcard variants link each of them with the least of its variant, by a grouped minimum.
    """
    variants = distinct.select(F.explode(deletion_variants(F.col("fp"))).alias("key"), "fp")
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark sizes what an explode makes as what goes in, 64 times too low: neither side may be broadcast.
    groups = stored(variants.join(shared.hint("merge"), "key"), "variant-groups")
    small = groups.where(F.col("n") <= limit).select("key", "fp")
    links = stored(map_batches(small.repartition("key").sortWithinPartitions("key"), _group_links, "a long, b long").distinct(), "links")
    members = groups.where(F.col("n") > limit).select("fp").distinct()
    if members.head(1):
        wild = stored(map_batches(members, _two_wildcards, "mask int, rest long, fp long"), "wild")
        least = wild.groupBy("mask", "rest").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        links = links.unionByName(wild.join(least.hint("merge"), ["mask", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct())
    return links


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct ``edges`` (u > v) is either a v, or the u of one edge only: then each v is the least of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("least"))
    return not nodes.agg(F.count_if((F.col("outs") > 1) | ((F.col("outs") > 0) & (F.col("least") == 0)))).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): alternating large-star and small-star rounds.

    Each round is a grouped minimum and an equi-join; a node's neighbours are never gathered in one row. It
    ends when all edges are stars around their least nodes; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _are_stars(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_roots(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As ``simhash_components``, with root: one fingerprint of the component, which names it where ids do not."""
    rows = stored(fingerprints(docs.select(*[F.col(c).alias(f"_h_c{i}") for i, c in enumerate(carry)], F.col(doc_id).alias("_h_id"), F.col(text).alias("_h_text")),
                               [*[f"_h_c{i}" for i in range(len(carry))], "_h_id"], "_h_text"), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("_h_id").alias("least")), "distinct-fingerprints")
    roots = components(near_links(distinct.select("fp")))
    placed = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = stored(placed.join(lowest, "root").select("fp", "component_id", "root"), "fingerprint-components")
    return rows.join(of, "fp").select(*[F.col(f"_h_c{i}").alias(c) for i, c in enumerate(carry)], "fp", "component_id", "root")


def simhash_components(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``carry`` columns, fp and component_id: the least id reachable over links of at most 2 differing bits.

    Rows of one fingerprint are one component, among them all rows without words; ids that are null count as
    larger than any other, and a component of null ids only has a null component_id. Repeated rows repeat.
    """
    return simhash_roots(docs, carry, text, doc_id).drop("root")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, one of each near-duplicate component: the row of its least id, null last (of repeated ids, the least text hash)."""
    names = docs.columns
    key = F.xxhash64(F.col(doc_id), F.col(text))
    marked = docs.select(*[F.col(c).alias(f"_n_c{i}") for i, c in enumerate(names)], F.col(doc_id).alias("_n_id"), key.alias("_n_k"), F.col(text).alias("_n_text"))
    got = simhash_roots(marked, ["_n_id", "_n_k"], "_n_text", "_n_id")
    keep = got.groupBy("root").agg(F.min(F.struct(F.col("_n_id").isNull().alias("none"), F.col("_n_id").alias("id"), F.col("_n_k").alias("k"))).alias("least")).select("least.id", "least.k")
    kept = marked.join(keep, (F.col("_n_k") == F.col("k")) & F.col("_n_id").eqNullSafe(F.col("id")), "left_semi").dropDuplicates(["_n_id", "_n_k"])
    return kept.select(*[F.col(f"_n_c{i}").alias(c) for i, c in enumerate(names)])


def op2_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    got = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
