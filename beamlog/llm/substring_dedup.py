"""Substring dedup by repeated-phrase automata: recurring word passages, sharded Aho-Corasick, every occurrence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import NON_SPACE, chunks, map_batches, mix, power_tables, text_bytes, word_bounds
from .windows import SHARD_BYTES, Windows, covered, joined_words, repeated_spans, with_spans

WINDOW_WORDS = 35
#: Words of a shard are numbered and written as one character each (two where one plane of code points is too few).
_SURROGATES, _PLANE = 0xD800, 0x10F7FE


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers from 1 on of the words of all texts, each text's first word (one entry more than texts), and how many numbers there are."""
    numbers: dict[bytes, int] = {}
    words = [t.split() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.array([numbers.setdefault(w, len(numbers) + 1) for ws in words for w in ws], np.int64), first, len(numbers)


def _spelled(numbers: np.ndarray, width: int) -> str:
    """One code point a number, surrogates left out; two where ``width`` is 2."""
    parts = numbers[:, None] if width == 1 else np.stack([numbers // 0x8000, numbers % 0x8000], axis=1)
    points = parts.ravel()
    return np.where(points < _SURROGATES, points, points + 0x800).astype("<u4").tobytes().decode("utf-32-le")


def confirmed_passages(words: np.ndarray, first: np.ndarray, weights: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Recurring passages, each once, as (first word, end) in the first text that has it.

    Windows are sorted by a hash and equal neighbours compared word by word. Windows of one text after the other
    are one passage as long as each occurs wherever the one before it does and nowhere else, so that an occurrence
    of any window of a passage lies in an occurrence of the whole passage, and no passage lies in another.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    per = np.maximum(0, np.diff(first) - length + 1)
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())  # word position of each window
    if not len(at):
        return none
    owner = np.repeat(np.arange(len(per)), per)
    power, inverse = power_tables(len(words) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.astype(np.uint64) * power[: len(words)])])
    key = mix((sums[at + length] - sums[at]) * inverse[at])
    by = np.argsort(key, kind="stable")
    same = key[by[1:]] == key[by[:-1]]
    pair = np.flatnonzero(same)
    left, right = at[by[pair]], at[by[pair + 1]]
    equal = np.ones(len(pair), bool)
    for k in range(length):
        equal &= words[left + k] == words[right + k]
    same[pair] = equal
    group = np.empty(len(by), np.int64)
    heads = np.append(True, ~same)
    group[by] = np.cumsum(heads) - 1
    again = np.bincount(group, weights[owner]) > 1

    # The group of the window after and before each one in its text; -1 where there is none or it does not recur.
    known = np.where(again[group], group, -1)
    follows = np.append(owner[1:] == owner[:-1], False)
    after = np.where(follows, np.append(known[1:], -1), -1)
    before = np.where(np.append(False, follows[:-1]), np.append(-1, known[:-1]), -1)
    starts = np.flatnonzero(heads)
    only = lambda x: np.where((low := np.minimum.reduceat(x[by], starts)) == np.maximum.reduceat(x[by], starts), low, -1)
    next_of, back_of = only(after), only(before)
    grows = (next_of >= 0) & (back_of[next_of] == np.arange(len(starts)))  # and so the group after it, from below
    first_seen = np.zeros(len(by), bool)
    first_seen[by[starts]] = True
    rep = np.flatnonzero(first_seen & again[group])
    opens = ~((back_of[group[rep]] >= 0) & grows[back_of[group[rep]]])
    closes = ~grows[group[rep]]
    return at[rep[opens]], at[rep[closes]] + length


def locate(table: pa.Table, length: int = WINDOW_WORDS) -> pa.Table:
    """One shard: confirm its recurring passages, compile them, and stream all its stretches of documents through the automaton.

    The automaton alone knows where passages occur: confirming keeps one place of each.
    """
    words, first, kinds = _numbered(table.column("content").to_pylist())
    low, high = confirmed_passages(words, first, table.column("n").to_numpy(), length)
    out = np.zeros((3, 0), np.int64)
    if len(low):
        width = 1 if kinds < _PLANE else 2
        automaton = ahocorasick.Automaton()
        spelled = _spelled(words, width)
        for a, b in zip(low.tolist(), high.tolist()):
            automaton.add_word(spelled[a * width : b * width], b - a)
        automaton.make_automaton()
        # All stretches in one string, with the number 0 between them, which no passage has.
        stream = _spelled(np.insert(words, first[1:-1], 0), width)
        hits = np.array([(end + 1, size) for end, size in automaton.iter(stream) if (end + 1) % width == 0], np.int64).reshape(-1, 2)
        end, begin = hits[:, 0] // width, hits[:, 0] // width - hits[:, 1]
        row = np.searchsorted(first + np.arange(len(first)), begin, side="right") - 1
        a, z = begin - first[row] - row, end - first[row] - row - length
        order = np.lexsort((a, row))
        row, a, z = row[order], a[order], z[order]
        fresh = np.append(True, (row[1:] != row[:-1]) | (a[1:] > z[:-1] + 1))  # passages of a text do not lie in each other
        last = np.append(np.flatnonzero(fresh)[1:] - 1, len(a) - 1)
        out = np.stack([row[fresh], a[fresh], z[last]])
    row, a, z = out
    c1, c2 = (table.column(c).to_numpy()[row] for c in ("c1", "c2"))
    return pa.table({"c1": pa.array(c1, pa.int64()), "c2": pa.array(c2, pa.int64()), "a": pa.array(a.astype(np.int32)), "z": pa.array(z.astype(np.int32))})


def substring_dedup(docs: DataFrame, carry: list[str], text: str = "text", doc_id: str = "doc_id", length: int = WINDOW_WORDS, digest: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``carry`` columns, n_words, n_removed and kept_text (or kept_sha256 with ``digest``).

    Removes every word that a window of ``length`` words covers whose words also start anywhere else, in the
    same document or another; windows are judged on the input. Words are runs of other bytes than the six
    white-space ones, unchanged; kept words are joined by one space. A null or empty text has no words and
    keeps an empty text. Rows repeated in full count as two occurrences. Extra columns play no part.
    """
    spans = repeated_spans(docs, Windows("word", length), lambda t: locate(t, length), text, doc_id, shard_bytes)
    rows = with_spans(docs, spans, carry, text, doc_id)
    fields = [T.StructField(c, rows.schema[f"_w_c{i}"].dataType) for i, c in enumerate(carry)]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256" if digest else "kept_text", T.StringType())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_w_text"))
            for i, j in chunks(offsets):
                part, at = data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i]
                bounds = word_bounds(part, at, NON_SPACE)
                first = bounds[2]
                keep = ~covered(batch.column("spans"), first, i, len(bounds[0]))
                out, place = joined_words(part, at, keep, bounds)
                before = np.concatenate([[0], np.cumsum(keep)])[first]
                raw = out.tobytes()
                texts = [raw[place[a] : place[b] - 1] if b > a else b"" for a, b in zip(before[:-1], before[1:])]
                values = pa.array([hashlib.sha256(x).hexdigest() for x in texts]) if digest else pa.array(texts, pa.binary()).cast(pa.string())
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([*[batch.column(f"_w_c{c}").slice(i, j - i) for c in range(len(carry))], pa.array(n), pa.array(n - np.diff(before)), values], names=schema.names)

    return map_batches(rows, finish, schema)


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], digest=True)


OP3_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW_WORDS} + 2)) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW_WORDS - 1}], ' ')) AS k FROM p),
r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, list(DISTINCT j) AS js
        FROM (SELECT doc_id, unnest(range(i, i + {WINDOW_WORDS})) AS j FROM h WHERE k IN (SELECT k FROM r)) GROUP BY doc_id),
f AS (SELECT w.doc_id, ws, coalesce(js, []) AS js FROM w LEFT JOIN hit USING (doc_id))
SELECT doc_id, len(ws) AS n_words, len(js) AS n_removed,
       sha256(array_to_string(CASE WHEN len(js) = 0 THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' ')) AS kept_sha256
FROM f
"""
