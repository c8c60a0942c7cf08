"""Ranked search against a plain loop: ties, repeated rows, blocks, odd rows, and WAND against full scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from beamlog.llm import ranked_search as rs


def terms(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c, sum(c.values())) for i, c in bags if c]
    n_all, total = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c, n in bags:
            m = 10 + 90 * n * n_all // total
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if score > 0:
                found.append((-score, i is None, i, score))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return out


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(2000)] + ["Über", "naïve", "x-ray", "A1"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(15)] + [(5, docs[5][1]), (n + 50, None), (n + 51, ""), (n + 52, "... !"), (None, docs[4][1]), (n + 53, text(40_000))]
    return docs, [(100 + i, text(rng.randint(1, 30))) for i in range(20)] + [(100, "w1 w2 extra"), (200, None), (201, ""), (202, "unseenword"), (None, docs[7][1]), (203, docs[3][1])]


@pytest.mark.parametrize("shard_bytes,block_bytes,window", [(32 << 20, 1 << 20, 128), (2_000, 300, 1), (20_000, 100, 7)])
def test_equals_full_scoring(spark, monkeypatch, shard_bytes, block_bytes, window):
    monkeypatch.setattr(rs, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(rs, "WINDOW_DOCS", window)
    docs, items = corpus(shard_bytes)
    df = spark.createDataFrame([(t, i, 9, "x") for i, t in docs], "text string, doc_id long, rank int, SCORE string").repartition(3)
    queries = spark.createDataFrame([(t, i, 1) for i, t in items], "text string, item_id long, doc_id int")
    got = rs.ranked_search(df, queries, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_wand_equals_full_scoring_whatever_the_window():
    rng = np.random.default_rng(2)
    for trial in range(60):
        n = int(rng.integers(1, 400))
        postings = []
        for _ in range(int(rng.integers(0, 12))):
            places = np.flatnonzero(rng.random(n) < rng.random() ** 3)
            if len(places):
                impacts = rng.integers(0, 6 if trial % 2 else 10**9, len(places))  # many ties in every second trial
                postings.append((places.astype(np.int32), impacts, int(impacts.max())))
        full = np.zeros(n, np.int64)
        for places, impacts, _ in postings:
            full[places] += impacts
        order = np.lexsort((np.arange(n), -full))[:10]
        want = [(int(d), int(full[d])) for d in order if full[d] > 0]
        for window in (1, 5, 128):
            at, score = rs.wand(postings, n, 10, window)
            assert list(zip(at.tolist(), score.tolist())) == want


def test_documents_that_cannot_win_are_skipped():
    n, seen = 100_000, []

    class Places(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.start is not None and key.stop is not None:
                seen.append(key.stop - key.start)
            return np.asarray(super().__getitem__(key))

    common = (np.arange(n, dtype=np.int32).view(Places), np.ones(n, np.int64), 1)
    rare = (np.arange(0, n, 5_000, dtype=np.int32), np.full(20, 100), 100)
    at, score = rs.wand([common, rare], n)
    assert list(score) == [101] * 10 and at.tolist() == list(range(0, 50_000, 5_000)) and sum(seen) < 20_000


def test_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "Two three")], "item_id string, text string")
    assert [(r.doc_id, r["rank"]) for r in rs.ranked_search(docs, items).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert rs.ranked_search(docs.limit(0), items).collect() == [] and rs.ranked_search(docs, items.limit(0)).collect() == []
    assert rs.ranked_search(docs.where("doc_id is null"), items).collect() == []
