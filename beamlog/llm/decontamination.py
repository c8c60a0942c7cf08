"""Benchmark decontamination: a generalised suffix automaton of normalised test items, streamed over training words."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, chunks, map_batches, merged, mix, stored, text_bytes, word_bounds, word_hashes

WINDOW_WORDS = 10
#: Text bytes of the items of one automaton; a larger benchmark is taken in blocks, one after the other.
BLOCK_BYTES = 1 << 20
_FILTER_BITS = 22
_C0, _C1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def item_words(text: str | None) -> list[bytes]:
    """Words of one text: A-Z lower-cased, runs of digits, letters and non-ASCII characters."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends)]


class ItemAutomaton:
    """Generalised suffix automaton over words, with the items each state's strings occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._add(last, w)
        self.items: list[set[str]] = [set() for _ in self.next]
        self.whole: list[list[tuple[int, set[str]]]] = [[] for _ in self.next]
        for item, words in items:
            v = 0
            for w in words:
                v = self.next[v][w]
                u = v
                while u > 0 and item not in self.items[u]:
                    self.items[u].add(item)
                    u = self.link[u]
            if 0 < len(words) < window:
                entry = next((ids for n, ids in self.whole[v] if n == len(words)), None)
                if entry is None:
                    self.whole[v].append((len(words), {item}))
                else:
                    entry.add(item)
        order = sorted(range(len(self.next)), key=self.len.__getitem__)
        self.short = [-1] * len(self.next)  # nearest suffix state, itself included, that holds a whole short item
        for v in order[1:]:
            self.short[v] = v if self.whole[v] else self.short[self.link[v]]
        sizes = [min(len(words), window) for _, words in items if words]
        self.least = min(sizes, default=0)
        pairs = [list(zip(words, words[1:])) for _, words in items]
        self.filter = self._filter([w for _, words in items for w in words], [p for ps in pairs for p in ps])

    def _add(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: bytes) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _filter(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Bit table of the hashes of all item words (where an item is one word long) or word pairs."""
        table = np.zeros(1 << _FILTER_BITS, bool)
        hashed = lambda ws: word_hashes(np.frombuffer(b"".join(ws), np.uint8), *(lambda e: (e - np.array([len(w) for w in ws]), e))(np.cumsum([len(w) for w in ws])))
        if self.least == 1 and words:
            table[hashed(words) >> np.uint64(64 - _FILTER_BITS)] = True
        elif pairs:
            table[pair_hashes(hashed([a for a, _ in pairs]), hashed([b for _, b in pairs])) >> np.uint64(64 - _FILTER_BITS)] = True
        return table

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Occurrences of windows as word intervals, the items they are of, and the longest match length."""
        v = length = longest = 0
        spans, found = [], set()
        nxt, link, size, window = self.next, self.link, self.len, self.window
        for t, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                length = size[v]
            if w in nxt[v]:
                v = nxt[v][w]
                length += 1
            else:
                length = 0
                continue
            longest = max(longest, length)
            if length >= window:
                u = v
                while size[link[u]] >= window:
                    u = link[u]
                spans.append((t + 1 - window, t + 1))
                found |= self.items[u]
            u = self.short[v]
            while u > 0:
                for n, ids in self.whole[u]:
                    if u != v or length >= n:
                        spans.append((t + 1 - n, t + 1))
                        found |= ids
                u = self.short[link[u]]
        return merged(spans), found, longest


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _C0 + b * _C1)


def _matches(automaton: ItemAutomaton, data: np.ndarray, offsets: np.ndarray):
    """Words of a chunk, and per row with matches: spans, items, longest match."""
    data = LOWER[data]
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    out: dict[int, tuple] = {}
    if automaton.least and len(starts):
        hashes = word_hashes(data, starts, ends)
        shift = np.uint64(64 - _FILTER_BITS)
        if automaton.least == 1:
            maybe, more, need = automaton.filter[hashes >> shift], 0, 1
        else:
            maybe, more, need = np.append(automaton.filter[pair_hashes(hashes[:-1], hashes[1:]) >> shift], False), 1, automaton.least - 1
            inner = first[1:]
            maybe[inner[(inner > 0)] - 1] = False
        edge = np.diff(np.concatenate([[False], maybe, [False]]).astype(np.int8))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= need
        # With one-word items a run may go on into the next row; rows are cut apart below.
        for lo, hi in zip(a[long].tolist(), (b[long] + more).tolist()):
            row = int(np.searchsorted(first, lo, side="right")) - 1
            while lo < hi:
                stop = min(hi, int(first[row + 1]))
                if stop > lo:
                    spans, items, longest = automaton.stream([data[s:e].tobytes() for s, e in zip(starts[lo:stop].tolist(), ends[lo:stop].tolist())])
                    if spans:
                        base = lo - int(first[row])
                        have = out.setdefault(row, ([], set(), 0))
                        out[row] = (have[0] + [(s + base, e + base) for s, e in spans], have[1] | items, max(have[2], longest))
                lo, row = max(lo, stop), row + 1
    return starts, ends, first, out


#: Of a matched passage: its words, and its code points in the text.
_SPAN = ("start", "end", "at", "to")
_SPANS = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in _SPAN]))
_SPANS_ARROW = pa.list_(pa.struct([(x, pa.int32()) for x in _SPAN]))


def _placed(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, row_at: np.ndarray, found: dict[int, tuple]) -> dict[int, list[dict]]:
    """The spans of each row with matches, with their code points."""
    if not found:
        return {}
    points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    out = {}
    for r, (spans, _, _) in found.items():
        base, zero = int(first[r]), int(points[row_at[r]])
        out[r] = [{"start": s, "end": e, "at": int(points[starts[base + s]]) - zero, "to": int(points[ends[base + e - 1]]) - zero} for s, e in merged(spans)]
    return out


def _scan(docs: DataFrame, carry: list[str], text: str, shared: Broadcast) -> DataFrame:
    """``shared``: an automaton on the executors."""
    rows = docs.select(*[F.col(c).alias(f"_d_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_d_text"))
    fields = [rows.schema[f"_d_c{i}"] for i in range(len(carry))]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column("_d_text"))
            for i, j in chunks(offsets):
                at, part = offsets[i : j + 1] - offsets[i], data[int(offsets[i]) : int(offsets[j])]
                starts, ends, first, found = _matches(machine, part, at)
                placed, none = _placed(part, starts, ends, first, at, found), ([], (), 0)
                per = [found.get(r, none) for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f"_d_c{c}").slice(i, j - i) for c in range(len(carry))], pa.array(np.diff(first)),
                     pa.array([placed.get(r, []) for r in range(j - i)], _SPANS_ARROW), pa.array([sorted(p[1]) for p in per], pa.list_(pa.string())), pa.array([p[2] for p in per], pa.int32())],
                    names=schema.names)

    return map_batches(rows, run, schema)


def benchmark_blocks(bench: DataFrame, text: str, item_id: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of about ``block_bytes`` of text; only one block is on the driver at a time."""
    items = bench.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null and i is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        yield [(r["i"], item_words(r["t"])) for r in part.collect()]


def benchmark_matches(docs: DataFrame, bench: DataFrame, carry: list[str], text: str = "text", item_text: str = "text", item_id: str = "item_id", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``carry`` columns, n_words, spans, items (ids, sorted) and longest match per document.

    A span is a word interval (start, end) and the code points (at, to) of it; both are end-exclusive.

    An item of ``window`` words or more matches by any ``window`` consecutive words of it, a shorter one only
    as a whole; items without words or without an id never match, and rows of one id count as one item. Null
    or empty texts have no words. Word pairs of the items pre-select stretches of a document in numpy; the
    automaton, of at most ``block_bytes`` of items, decides on the words themselves. Rows are independent
    and nothing is shuffled for a benchmark of one block; with more blocks each row's parts are merged.
    """
    automata = (ItemAutomaton(items, window) for items in benchmark_blocks(bench, item_text, item_id, block_bytes))
    first, second = next(automata), next(automata, None)
    share = docs.sparkSession.sparkContext.broadcast
    if second is None:
        out = _scan(docs, carry, text, share(first))
    else:
        out = _merged_scan(docs, carry, text, share(first), itertools.chain([second], automata))
    return out.select(*[F.col(f"_d_c{i}").alias(c) for i, c in enumerate(carry)], "n_words", "spans", "items", "longest")


def _merged_scan(docs: DataFrame, carry: list[str], text: str, first: Broadcast, rest: Iterable[ItemAutomaton]) -> DataFrame:
    """Every block over every text, one pass a block and one automaton at a time; what a text matches is joined to its rows.

    Matches depend on the text alone, so 128 bits of its hash are the key and only texts with matches are kept.
    """
    own = [f"_e_c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(own, carry)], F.xxhash64(text).alias("_e_k1"), F.xxhash64(F.lit(1), text).alias("_e_k2"), F.col(text).alias("_e_text"))
    keys, parts = ["_e_k1", "_e_k2"], []
    for automaton in rest:
        shared = docs.sparkSession.sparkContext.broadcast(automaton)
        got = _scan(rows, keys, "_e_text", shared).where(F.size("spans") > 0)
        parts.append(stored(got.select(F.col("_d_c0").alias("k1"), F.col("_d_c1").alias("k2"), "spans", "items", "longest").dropDuplicates(["k1", "k2"]), "block-matches"))
        shared.destroy()
    lists = [F.flatten(F.collect_list(c)).alias(f"_m_{c}") for c in ("spans", "items")]  # one entry a block at most
    more = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(*lists, F.max("longest").alias("_m_longest"))
    main = _scan(rows, [*own, *keys], "_e_text", first)
    at = len(own)
    both = main.join(more, (F.col(f"_d_c{at}") == F.col("k1")) & (F.col(f"_d_c{at + 1}") == F.col("k2")), "left")
    joined = lambda c, kind: F.concat(c, F.coalesce(f"_m_{c}", F.array().cast(kind)))
    return both.select(*[f"_d_c{i}" for i in range(at)], "n_words", _union_of(joined("spans", _SPANS)).alias("spans"), F.array_sort(F.array_distinct(joined("items", "array<string>"))).alias("items"), F.greatest("longest", "_m_longest").alias("longest"))


def _union_of(spans: Column) -> Column:
    """Merged intervals of an array of (start, end)."""
    start = F.array().cast(_SPANS)

    def add(done, x):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (x["start"] <= last["end"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["at"].alias("at"), F.greatest(last["to"], x["to"]).alias("to"))
        return F.when(joins, F.array_append(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), wider)).otherwise(F.array_append(done, x))

    return F.aggregate(F.array_sort(spans), start, lambda done, x: F.when(F.size(done) == 0, F.array(x)).otherwise(add(done, x)))


def hit_words(spans: str = "spans"):
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", window: int = WINDOW_WORDS, max_coverage: float = 0.5) -> DataFrame:
    """The documents without benchmark passages, in their own columns.

    Words of matched spans are cut from the text together with what stands between them; a document whose
    matched words exceed ``max_coverage`` of its words is dropped, others keep the rest of their text
    unchanged. Documents without a match, null texts included, pass as they are.
    """
    names = docs.columns
    own = docs.select(*[F.col(c).alias(f"_p_{c}") for c in names])  # so that no column clashes with the result's
    got = benchmark_matches(own, bench, own.columns, f"_p_{text}", window=window)
    keep = got.where((F.col("n_words") == 0) | (hit_words() <= max_coverage * F.col("n_words")))
    return keep.select(*[without_spans(F.col(f"_p_{text}"), F.col("spans")).alias(c) if c == text else F.col(f"_p_{c}").alias(c) for c in names])


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the code points of its spans, which are sorted and apart."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    left = F.aggregate(spans, start, lambda s, x: F.struct(x["to"].alias("at"), F.concat(s["out"], piece(s["at"], x["at"])).alias("out")),
                       lambda s: F.concat(s["out"], piece(s["at"], F.length(text))))
    return F.when(F.size(spans) > 0, left).otherwise(text)


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = benchmark_matches(docs, bench, ["doc_id"])
    return got.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit_words() > 0).alias("contaminated"),
    )


OP1_SQL = rf"""
WITH lowered AS (SELECT 'd' AS side, doc_id::VARCHAR AS id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id::VARCHAR, NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
bench AS (SELECT id, ws, least(len(ws), {WINDOW_WORDS}) AS n FROM words WHERE side = 'b' AND len(ws) > 0),
windows AS (SELECT DISTINCT id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM bench)),
docs AS (SELECT doc_id, ws FROM words WHERE side = 'd'),
placed AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows))),
hits AS (SELECT a.doc_id, a.n, a.i, w.id FROM placed a JOIN windows w ON a.k = w.k AND a.n = w.n),
per AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS ids FROM hits GROUP BY doc_id),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN per USING (doc_id) LEFT JOIN hit_words USING (doc_id)
"""
