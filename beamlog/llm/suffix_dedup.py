"""Suffix-array dedup of byte strings, the array built by linear grouping over Lyndon prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, map_batches, mix, text_bytes
from .windows import SHARD_BYTES, Windows, covered, repeated_spans, with_spans

WINDOW_BYTES = 400
#: Suffixes start at every ``BLOCK`` bytes, counted from the anchor of their stretch.
BLOCK = 32


def lyndon_groups(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """Group of each suffix by its longest Lyndon prefix (as the group's first rank), and previous-smaller pointers.

    Groups are finished from the highest down. The members of a finished group point to the nearest earlier
    suffix of a lower group; those pointed to have their prefix grown by as many copies of the group's prefix
    as members point to them, so each such class splits off at the upper end of its old group.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    sizes = np.diff(np.append(heads, n))
    group_of = np.empty(n, np.int64)
    group_of[order] = np.repeat(heads, sizes)
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    sa, place, group = order.tolist(), place_of.tolist(), group_of.tolist()
    size = [0] * n
    for h, s in zip(heads.tolist(), sizes.tolist()):
        size[h] = s
    prev = [-1] * n
    end = n
    while end:
        head = group[sa[end - 1]]
        members = sa[head:end]
        if len(members) > 1:
            members.sort()
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= head:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        end = head
        if not count:
            continue
        most = max(count.values())
        if most == 1:
            classes = [list(count)]
        else:
            by_count: dict[int, list[int]] = {}
            for p, c in count.items():
                by_count.setdefault(c, []).append(p)
            classes = [by_count[c] for c in sorted(by_count, reverse=True)]
        for chosen in classes:
            for p in chosen:
                g = group[p]
                size[g] -= 1
                to, at = g + size[g], place[p]
                other = sa[to]
                sa[to], sa[at] = p, other
                place[p], place[other] = to, at
            fresh = [group[p] + size[group[p]] for p in chosen]
            for p, g in zip(chosen, fresh):
                group[p] = g
                size[g] += 1
    return group, prev


def suffix_order(symbols: np.ndarray) -> list[int]:
    """Suffix array of ``symbols``, whose last entry must be its only least one.

    From the least suffix up, each placed suffix places those whose Lyndon prefix ends where it begins, at the
    next free rank of their groups; they form a chain of previous-smaller pointers.
    """
    group, prev = lyndon_groups(symbols)
    n = len(group)
    out = [-1] * n
    free = list(range(n))
    done = [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return out


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def recurring(table: pa.Table, length: int = WINDOW_BYTES, block: int = BLOCK) -> pa.Table:
    """One shard: suffix-sort the blocks of its stretches, then settle the windows around equal block runs by byte.

    Equal windows lie at equal offsets from equal anchors, so they hold the same whole blocks: at least
    ``deep`` of them. Suffixes that agree on ``deep`` blocks are neighbours in the suffix array; a window
    belongs to the first whole block in it and recurs if a window of that neighbourhood has the same bytes
    on both sides.
    """
    n_of = table.column("n").to_numpy()
    off, nwin = table.column("off").to_numpy().astype(np.int64), table.column("nwin").to_numpy().astype(np.int64)
    data, at = text_bytes(table.column("content"))
    data, at = data[int(at[0]) : int(at[-1])], at - at[0]
    rows = len(n_of)
    deep = (length - block + 1) // block
    lead = off % block
    blocks = (np.diff(at) - lead) // block
    row = np.repeat(np.arange(rows), blocks)
    first = np.concatenate([[0], np.cumsum(blocks)])
    x = at[row] + lead[row] + block * (np.arange(len(row)) - first[row])  # byte position of each block

    # Exact block symbols from 2 on; 1 ends a stretch, 0 ends the shard.
    lanes = np.stack([np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))[x + 8 * k] for k in range(block // 8)])
    by = np.lexsort(lanes)
    fresh = np.append(True, (lanes[:, by[1:]] != lanes[:, by[:-1]]).any(axis=0))
    symbol = np.empty(len(row), np.int64)
    symbol[by] = np.cumsum(fresh) + 1
    total = len(row) + rows + 1
    text = np.ones(total, np.int64)
    slot = np.arange(len(row)) + row  # a separator after each stretch
    text[slot] = symbol
    text[-1] = 0
    block_at = np.full(total, -1, np.int64)
    block_at[slot] = np.arange(len(row))

    sa = np.array(suffix_order(text))
    ahead = np.zeros(total, np.int64)
    ahead[slot] = first[row + 1] - np.arange(len(row))
    sa = sa[ahead[sa] >= deep]  # suffixes shorter than that never lie between equal longer ones
    same = np.ones(max(0, len(sa) - 1), bool)
    for k in range(deep):
        same &= text[sa[1:] + k] == text[sa[:-1] + k]
    klass = np.cumsum(np.append(True, ~same)) if len(sa) else np.zeros(0, np.int64)
    member = block_at[sa]
    weight = np.bincount(klass, n_of[row[member]]) if len(sa) else np.zeros(0)
    live = weight[klass] > 1
    klass, member = klass[live], member[live]

    base = 0x9E3779B97F4A7C15
    power, inverse = _powers(base, len(data)), _powers(pow(base, -1, 1 << 64), len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    hit = np.zeros(int(nwin.sum()), bool)
    window_at = np.concatenate([[0], np.cumsum(nwin)])
    r, pos = row[member], x[member]
    for shift in range(block):
        p = pos - shift
        fits = np.flatnonzero((p >= at[r]) & (p + length <= at[r + 1]))
        if not len(fits):
            continue
        q, k = p[fits], klass[fits]
        key = mix((sums[q + length] - sums[q]) * inverse[q]) ^ mix(k.astype(np.uint64) + np.uint64(1))
        by = np.argsort(key, kind="stable")
        equal = key[by[1:]] == key[by[:-1]]
        pair = np.flatnonzero(equal)
        if len(pair):  # by byte, whatever the hashes say
            for t in range(-(-length // 8)):
                o = min(8 * t, length - 8)
                eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
                pair = pair[eight[q[by[pair]] + o] == eight[q[by[pair + 1]] + o]]
            equal = np.zeros(len(equal), bool)
            equal[pair] = True
        runs = np.cumsum(np.append(True, ~equal)) - 1
        again = np.bincount(runs, n_of[r[fits[by]]])[runs] > 1
        won = fits[by[again]]
        hit[window_at[r[won]] + (p[won] - at[r[won]])] = True

    # Maximal runs of recurring windows inside each stretch.
    owner = np.repeat(np.arange(rows), nwin)
    begins = hit & np.append(True, ~hit[:-1] | (owner[1:] != owner[:-1]))
    ends = hit & np.append(~hit[1:] | (owner[1:] != owner[:-1]), True)
    a, z = np.flatnonzero(begins), np.flatnonzero(ends)
    own = owner[a]
    c1, c2 = table.column("c1").to_numpy(), table.column("c2").to_numpy()
    return pa.table({"c1": pa.array(c1[own]), "c2": pa.array(c2[own]), "a": pa.array((a - window_at[own]).astype(np.int32)), "z": pa.array((z - window_at[own]).astype(np.int32))})


def suffix_dedup(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", length: int = WINDOW_BYTES, digest: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``carry`` columns, n_bytes, n_removed, n_spans and kept (binary; or kept_sha256 with ``digest``).

    Removes every UTF-8 byte that a string of ``length`` bytes covers which also starts anywhere else, in the
    same document or another; overlaps count and strings are judged on the input. What is kept may break
    inside a character, so it is binary. A null or empty text has no bytes. Rows repeated in full count as
    two occurrences. Extra columns play no part. ``length`` is 64 at least.
    """
    spans = repeated_spans(docs, Windows("byte", length), lambda t: recurring(t, length), text, doc_id, shard_bytes)
    rows = with_spans(docs, spans, carry, text, doc_id)
    fields = [T.StructField(c, rows.schema[f"_w_c{i}"].dataType) for i, c in enumerate(carry)]
    last = T.StructField("kept_sha256", T.StringType()) if digest else T.StructField("kept", T.BinaryType())
    schema = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], last])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_w_text"))
            for i, j in chunks(offsets):
                part, first = data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i]
                gone = covered(batch.column("spans"), first, i, len(part))
                edge = np.zeros(len(part) + 1, bool)
                edge[:-1] = gone
                edge[1:-1] &= ~gone[:-1]
                inner = first[(first > 0) & (first < len(part))]
                edge[inner] = gone[inner]  # a run ends with its document
                starts = np.concatenate([[0], np.cumsum(edge[:-1])])[first]
                removed = np.concatenate([[0], np.cumsum(gone)])[first]
                raw, at = part[~gone].tobytes(), first - removed
                texts = [raw[a:b] for a, b in zip(at[:-1], at[1:])]
                values = pa.array([hashlib.sha256(t).hexdigest() for t in texts]) if digest else pa.array(texts, pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(f"_w_c{c}").slice(i, j - i) for c in range(len(carry))], pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array(np.diff(starts)), values], names=schema.names)

    return map_batches(rows, finish, schema)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], digest=True)
