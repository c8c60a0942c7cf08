"""Fixed-length windows (of words or bytes) that occur more than once: candidates, shards and spans.

Every window is tied to an anchor inside it: the position whose short-gram hash is least (leftmost of equals).
The choice depends on the window's content alone, so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor position form a *stretch*, about 200 bytes or 17 words long plus one window.

1. ``stretches``: one row per stretch with the anchor's hash and a 128-bit hash of the stretch. No text.
2. Anchors that occur once in the whole corpus drop out (a grouped sum, then a semi-join AQE may split).
3. Equal stretches are summed to one, and only these distinct stretches fetch their text.
4. Stretches are dealt to shards of bounded size by anchor hash; the operator's own method decides which
   windows of a stretch recur. Anchors whose stretches exceed a shard are settled window by window in a
   grouped sum instead, which pre-aggregates on the map side and has no large group.
5. Spans go back to the documents by the stretch hash, then by document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NON_SPACE, chunks, discard, map_batches, mix, sliding_min, stored, text_bytes, word_bounds, word_hashes

#: Text bytes of distinct stretches that one shard holds on average.
SHARD_BYTES = 4 << 20
#: An anchor with more than so many shards' bytes has no shard that could hold it and is settled by window.
CROWDED_SHARDS = 4
GRAM_WORDS = 3
GRAM_BYTES = 16
_C = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_HIGH = np.uint64(0xFFFFFFFF00000000)


@dataclass(frozen=True)
class Windows:
    """What a window is: ``length`` words or bytes."""

    unit: str
    length: int


def joined_words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None, bounds=None):
    """Kept words of all rows, one space after each, and for each word its start there (one entry more than words)."""
    starts, ends, first = bounds if bounds is not None else word_bounds(data, offsets, NON_SPACE)
    if keep is not None:
        starts, ends = starts[keep], ends[keep]
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    if len(starts):
        flags = np.zeros(len(data) + 1, np.int8)
        flags[starts] += 1
        flags[ends] -= 1  # where two rows' words touch, the two cancel and the run goes on
        inside = np.cumsum(flags[:-1], dtype=np.int8).astype(bool)
        out[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = data[inside]
    return out, at


def _runs(grams: np.ndarray, width: int, windows: int, row_of: np.ndarray, last: np.ndarray):
    """Stretches: first window, number of windows and anchor position of each, over units numbered through a chunk."""
    none = np.zeros(0, np.int64)
    if windows <= 0 or len(grams) < width:
        return none, none, none
    least = sliding_min((grams & _HIGH) | np.arange(len(grams), dtype=np.uint64), width)[:windows]
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.flatnonzero(np.arange(windows) <= last[row_of[:windows]])
    if not len(at):
        return none, none, none
    picked = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (at[1:] != at[:-1] + 1)
    k = np.flatnonzero(new)
    return at[k], np.diff(np.append(k, len(at))), picked[k]


def _chunk_stretches(kind: Windows, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Stretches of the rows of one chunk; positions are within the row."""
    size = kind.length
    if kind.unit == "word":
        bounds = word_bounds(data, offsets, NON_SPACE)
        starts, ends, first = bounds
        hashes = word_hashes(data, starts, ends)
        n = len(hashes)
        grams = mix(hashes[: n - 2] * _C[0] + hashes[1 : n - 1] * _C[1] + hashes[2:] * _C[2]) if n >= GRAM_WORDS else hashes[:0]
        width = size - GRAM_WORDS + 1
    else:
        first, n = offsets - offsets[0], len(data)
        if n >= GRAM_BYTES:
            eight = np.ndarray((n - 7,), "<u8", buffer=data, strides=(1,))
            grams = mix(eight[: n - 15] * _C[0] + eight[8:] * _C[1])
        else:
            grams = np.zeros(0, np.uint64)
        width = size - GRAM_BYTES + 1
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    at, count, anchor = _runs(grams, width, n - size + 1, row_of, first[1:] - size)
    row = row_of[at] if len(at) else at
    end = at + count - 1 + size
    if kind.unit == "word":
        words, place = joined_words(data, offsets, bounds=bounds)
        raw, s, e = words.tobytes(), place[at].tolist(), (place[end] - 1).tolist()
        b, bl = starts[at] - offsets[row], (ends[end - 1] - starts[at]) if len(at) else at
    else:
        raw, s, e = data.tobytes(), at.tolist(), end.tolist()
        b, bl = at - first[row], end - at
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(raw[i:j]) for i, j in zip(s, e)]), "<i8").reshape(-1, 2)
    return {"row": row, "h": grams[anchor].view(np.int64) if len(at) else at, "c1": both[:, 0], "c2": both[:, 1], "start": at - first[row], "nwin": count, "off": anchor - at, "b": b, "bl": bl}


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
_INTS = ("start", "nwin", "off", "b", "bl")
_SPANS_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def stretches(docs: DataFrame, kind: Windows, text: str, doc_id: str) -> DataFrame:
    """Rows (id, k, h, c1, c2, start, nwin, off, b, bl, n, ivals): k tells rows of one id with different texts apart.

    A stretch that recurs inside its own document is one row with its count and the union of its spans.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("k", T.LongType()), *[T.StructField(x, T.LongType()) for x in ("h", "c1", "c2")],
                           *[T.StructField(x, T.IntegerType()) for x in _INTS], T.StructField("n", T.IntegerType()), T.StructField("ivals", _SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in chunks(offsets):
                lo, hi = int(offsets[i]), int(offsets[j])
                got = _chunk_stretches(kind, data[lo:hi], offsets[i : j + 1] - lo)
                if not len(got["row"]):
                    continue
                one = np.ones(len(got["row"]), np.int32)
                key = got["c1"].view(np.uint64) ^ (got["row"].astype(np.uint64) * _C[0])
                order = np.argsort(key, kind="stable")
                same = np.flatnonzero(key[order][1:] == key[order][:-1])
                single = one.astype(bool)
                again, spans = [], []
                if len(same):
                    cut = np.split(order, np.flatnonzero(np.diff(key[order]) != 0) + 1)
                    for group in (g for g in cut if len(g) > 1):
                        single[group] = False
                        long = int(got["nwin"][group[0]]) - 1 + kind.length
                        s = got["start"][group]
                        breaks = np.flatnonzero(np.diff(s) > long)
                        heads, tails = s[np.append(0, breaks + 1)], s[np.append(breaks, len(s) - 1)] + long
                        again.append(group[0])
                        one[group[0]] = len(group)
                        spans.append([{"s": int(x), "e": int(y)} for x, y in zip(heads, tails)])
                for pick, ivals in ((np.flatnonzero(single), None), (np.array(again, np.int64), spans)):
                    if len(pick):
                        source = pa.array(got["row"][pick] + i)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(source), batch.column("k").take(source), *[pa.array(got[x][pick]) for x in ("h", "c1", "c2")],
                             *[pa.array(got[x][pick].astype(np.int32)) for x in _INTS], pa.array(one[pick]),
                             pa.nulls(len(pick), _SPANS_ARROW) if ivals is None else pa.array(ivals, _SPANS_ARROW)],
                            names=schema.names)

    return map_batches(rows, run, schema)


_CONTENT = T.StructType([*[T.StructField(x, T.LongType()) for x in ("h", "c1", "c2", "n")], T.StructField("crowded", T.BooleanType()), T.StructField("off", T.IntegerType()), T.StructField("nwin", T.IntegerType()), T.StructField("content", T.BinaryType())])
_FOUND = T.StructType([T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("a", T.IntegerType()), T.StructField("z", T.IntegerType())])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the listed stretches out of each text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        want = batch.column("want")
        flat, row = want.flatten(), np.repeat(np.arange(len(want)), np.diff(np.asarray(want.offsets)))
        fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
        lo = offsets[row] + np.asarray(fields["b"])
        hi = lo + np.asarray(fields["bl"])
        for i in range(0, len(lo), 8192):
            part = slice(i, i + 8192)
            content = pa.array([data[s:e].tobytes() for s, e in zip(lo[part], hi[part])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[fields[x].slice(i, 8192) for x in ("h", "c1", "c2", "n", "crowded", "off", "nwin")], content], names=_CONTENT.names)


def _window_rows(kind: Windows) -> Callable:
    """Each window of a stretch as a 128-bit hash of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nwin = batch.column("nwin").to_numpy()
            for i in range(0, len(nwin), 1024):
                keys = []
                for content, windows in zip(batch.column("content").slice(i, 1024).to_pylist(), nwin[i : i + 1024].tolist()):
                    if kind.unit == "word":
                        words = content.split()
                        keys += [xxhash.xxh3_128_digest(b" ".join(words[k : k + kind.length])) for k in range(windows)]
                    else:
                        keys += [xxhash.xxh3_128_digest(content[k : k + kind.length]) for k in range(windows)]
                both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                row = np.repeat(np.arange(i, min(i + 1024, len(nwin))), nwin[i : i + 1024])
                index = np.arange(len(row)) - np.repeat(np.cumsum(nwin[i : i + 1024]) - nwin[i : i + 1024], nwin[i : i + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *[batch.column(c).take(pa.array(row)) for c in ("n", "c1", "c2")], pa.array(index.astype(np.int32))], names=["w1", "w2", "n", "c1", "c2", "i"])

    return run


def repeated_spans(docs: DataFrame, kind: Windows, find: Callable[[pa.Table], pa.Table], text: str = "text", doc_id: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, k, spans): the unit intervals of each document that windows occurring more than once cover.

    ``find`` takes one shard's stretches (h, c1, c2, n, off, nwin, content) and returns (c1, c2, a, z):
    windows a to z, inclusive, of that stretch recur. ``n`` is how often the whole stretch occurs.
    """
    every = stored(stretches(docs, kind, text, doc_id), "stretches")
    often = every.groupBy("h").agg(F.sum("n").alias("m")).where("m > 1").select("h")
    again = stored(every.join(often, "h", "left_semi"), "recurring")
    discard(every)

    least = F.min(F.struct("k", "id", "b", "bl", "off", "nwin"))
    facts = distinct = stored(again.groupBy("h", "c1", "c2").agg(F.sum("n").alias("n"), least.alias("r")), "distinct")
    shards = max(1, -(-(distinct.agg(F.sum("r.bl")).first()[0] or 0) // shard_bytes))
    large = stored(distinct.groupBy("h").agg(F.sum("r.bl").alias("bytes")).where(F.col("bytes") > CROWDED_SHARDS * shard_bytes).select("h", F.lit(True).alias("crowded")), "crowded")
    crowded = bool(large.head(1))
    distinct = distinct.join(large, "h", "left") if crowded else distinct.withColumn("crowded", F.lit(None).cast("boolean"))
    fields = F.struct("h", "c1", "c2", "n", "crowded", F.col("r.off").alias("off"), F.col("r.nwin").alias("nwin"), F.col("r.b").alias("b"), F.col("r.bl").alias("bl"))
    texts = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("tk"), F.col(doc_id).alias("tid"), F.col(text).alias("text"))

    wanted = distinct.groupBy(F.col("r.k").alias("k"), F.col("r.id").alias("id")).agg(F.collect_list(fields).alias("want"))
    asked = texts.join(wanted, (F.col("tk") == F.col("k")) & F.col("tid").eqNullSafe(F.col("id"))).select("text", "want")
    # Stretches overlap, so a document's take little room one after the other in a compressed file.
    contents = stored(map_batches(asked, _slices, _CONTENT), "contents")
    discard(facts)

    def shard(table: pa.Table) -> pa.Table:
        return find(_first_of_each(table.drop_columns("shard")))

    dealt = contents.where("crowded is null").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    found = stored(dealt.groupBy("shard").applyInArrow(shard, _FOUND), "found")
    if crowded:
        windows = stored(map_batches(contents.where("crowded").dropDuplicates(["h", "c1", "c2"]), _window_rows(kind), "w1 long, w2 long, n long, c1 long, c2 long, i int"), "windows")
        repeats = windows.groupBy("w1", "w2").agg(F.sum("n").alias("m")).where("m > 1").select("w1", "w2")
        found = found.unionByName(stored(windows.join(repeats, ["w1", "w2"], "left_semi").select("c1", "c2", F.col("i").alias("a"), F.col("i").alias("z")), "found"))

    discard(contents)
    spans = again.where("ivals is null").select("id", "k", "c1", "c2", "start").join(found, ["c1", "c2"]).select("id", "k", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("z") + kind.length).alias("e"))
    inner = again.where("ivals is not null").select("id", "k", F.explode("ivals").alias("x")).select("id", "k", "x.s", "x.e")
    return spans.unionByName(inner).groupBy("id", "k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _first_of_each(table: pa.Table) -> pa.Table:
    """Fully repeated documents fetch a stretch once each; one copy is enough."""
    c1, c2, h = (table.column(x).to_numpy() for x in ("c1", "c2", "h"))
    order = np.lexsort((h, c2, c1))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(c1[order]) != 0) | (np.diff(c2[order]) != 0) | (np.diff(h[order]) != 0)
    return table if fresh.all() else table.take(pa.array(order[fresh]))


def with_spans(docs: DataFrame, spans: DataFrame, carry: list[str], text: str, doc_id: str) -> DataFrame:
    """``carry`` columns as _w_c0.., the text as _w_text, and the document's spans (null where it has none)."""
    rows = docs.select(*[F.col(c).alias(f"_w_c{i}") for i, c in enumerate(carry)], F.col(doc_id).alias("_w_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_w_k"), F.col(text).alias("_w_text"))
    return rows.join(spans, (F.col("_w_k") == F.col("k")) & F.col("_w_id").eqNullSafe(F.col("id")), "left").select(*[f"_w_c{i}" for i in range(len(carry))], "_w_text", "spans")


def covered(spans: pa.Array, first: np.ndarray, i: int, units: int) -> np.ndarray:
    """Which of a chunk's units the spans of its rows cover; ``first``: each row's first unit, ``i``: the chunk's first row."""
    change = np.zeros(units + 1, np.int32)
    part = spans.slice(i, len(first) - 1)
    offsets = np.asarray(part.offsets)
    flat = part.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    if len(flat):
        base = np.repeat(first[:-1], np.diff(offsets))
        np.add.at(change, base + flat.field("s").to_numpy(), 1)
        np.add.at(change, base + flat.field("e").to_numpy(), -1)
    return np.cumsum(change[:-1]) > 0
