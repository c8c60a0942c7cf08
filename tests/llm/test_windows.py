import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from beamlog.llm.substring_dedup import substring_dedup
from beamlog.llm.suffix_dedup import suffix_dedup, suffix_order


def test_suffix_order_matches_sorting():
    rng = random.Random(1)
    for trial in range(400):
        n = rng.randint(1, 60)
        s = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(n)] + [0]
        assert suffix_order(np.array(s)) == sorted(range(len(s)), key=lambda i: s[i:]), s


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared = [words(n) for n in (34, 35, 36, 60, 120, 300)]
    docs = [None, "", "  \n", " ".join(["und"] * 200), " ".join((["ab", "cd"] * 90)), "x" * 1500, " ".join(words(2000)) ]
    for k in range(60):
        parts = words(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            s = list(rng.choice(shared))
            if rng.random() < 0.5 and len(s) > 50:
                s[rng.randrange(len(s))] = "EDIT"
            if rng.random() < 0.3:
                s = s[rng.randint(0, 10) :]
            parts += s + words(rng.randint(0, 40))
        docs.append(rng.choice([" ", "\n", "\t "]).join(parts))
    docs += docs[10:14]
    return [(i, t) for i, t in enumerate(docs)]


def brute(docs, units, length):
    seen = Counter()
    split = {i: units(t or "") for i, t in docs}
    for u in split.values():
        for k in range(len(u) - length + 1):
            seen[tuple(u[k : k + length]) if isinstance(u, list) else u[k : k + length]] += 1
    out = {}
    for i, u in split.items():
        gone = [False] * len(u)
        for k in range(len(u) - length + 1):
            if seen[tuple(u[k : k + length]) if isinstance(u, list) else u[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out[i] = (u, gone)
    return out


@pytest.mark.parametrize("shard_bytes", [4 << 20, 2000])
def test_substring_dedup_matches_brute_force(spark, shard_bytes):
    docs = corpus()
    want = {i: (len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g) if not x).encode()).hexdigest()) for i, (u, g) in brute(docs, str.split, 35).items()}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(df, ["doc_id"], digest=True, shard_bytes=shard_bytes).collect()}
    assert got == want


@pytest.mark.parametrize("shard_bytes", [4 << 20, 6000])
def test_suffix_dedup_matches_brute_force(spark, shard_bytes):
    docs = corpus(5)
    want = {}
    for i, (u, g) in brute(docs, lambda t: t.encode(), 400).items():
        n_spans = sum(x and not y for x, y in zip(g, [False, *g[:-1]]))
        want[i] = (len(u), sum(g), n_spans, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup(df, ["doc_id"], digest=True, shard_bytes=shard_bytes).collect()}
    assert got == want


def test_empty_table_and_clashing_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, h string, id int, spans string, k int")
    assert substring_dedup(none, ["doc_id", "spans"]).count() == 0 and suffix_dedup(none, ["h"]).count() == 0
    one = spark.createDataFrame([(None, "a " * 50, "h", 1, "s", 2), (1, None, "h", 1, "s", 2)], none.schema)
    assert sorted(substring_dedup(one, ["doc_id", "spans"]).collect(), key=str) == [(1, "s", 0, 0, ""), (None, "s", 50, 50, "")]
