import random
import re

import pytest
import xxhash

from beamlog.llm import simhash_dedup
from beamlog.llm.simhash_dedup import components, near_dedup, near_links, op2_simhash_near_dedup, simhash_components


def fingerprint(text):
    words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(fps):
    """Least label reachable over links of at most 2 bits."""
    label = {f: f for f in fps}
    todo = set(fps)
    while todo:
        seen, front = set(), [todo.pop()]
        while front:
            x = front.pop()
            seen.add(x)
            near = [y for y in todo if bin(x ^ y).count("1") <= 2]
            todo.difference_update(near)
            front += near
        for x in seen:
            label[x] = min(seen)
    return label


signed = lambda x: x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("limit", [1024, 4])
def test_links_connect_all_pairs_within_two_bits(spark, limit):
    rng = random.Random(limit)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 8)):
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    links = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in near_links(df, limit).collect()]
    if limit == 1024:
        assert all(x in fps and y in fps for x, y in links)
    got = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in components(near_links(df, limit)).collect()}
    want = roots(fps)
    group = lambda of: sorted(sorted(x for x in fps if of(x) == r) for r in {of(x) for x in fps})
    assert group(lambda x: got.get(x, x)) == group(want.get)


def test_long_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.root for r in components(df).collect()} == {0}


def test_fingerprints_and_components(spark, tmp_path):
    rng = random.Random(2)
    vocab = [f"Wört{i}" for i in range(500)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "One two"), (5, "a b c")]
    for i in range(6, 60, 3):
        words = [rng.choice(vocab) for _ in range(400)]
        docs += [(i, " ".join(words)), (i + 1, "\n".join(words)), (i + 2, " ".join(words[:-1]))]
    docs.append(docs[-1])
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, fp string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op2_simhash_near_dedup(spark, str(tmp_path)).collect()
    fps = {d: fingerprint(t) for d, t in docs}
    label = roots(set(fps.values()))
    want = {d: (f"{fps[d]:016x}", min(x for x in fps if label[fps[x]] == label[fps[d]])) for d in fps}
    assert len(got) == len(docs) and {r[0]: tuple(r)[1:] for r in got} == want
    kept = near_dedup(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want.values()}) and {r.fp for r in kept} == {"x"}
    assert simhash_components(df.limit(0), ["doc_id"]).count() == 0


def test_near_dedup_keeps_one_of_each_component_whatever_its_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(2000)}" for _ in range(300))
    nulls, shared, twin = [text() for _ in range(4)], [text() for _ in range(3)], text()
    docs = [(None, t) for t in nulls] + [(7, t) for t in shared] + [(7, shared[0]), (None, twin), (9, twin + "\n")]
    kept = near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(kept) == 8 and {tuple(r) for r in kept} == {(None, t) for t in nulls} | {(7, t) for t in shared} | {(9, twin + "\n")}


def test_star_rounds_end_when_all_edges_are_stars(spark, monkeypatch):
    """No round follows the one that leaves stars, so few links take few jobs of the driver."""
    seen, store = [], simhash_dedup.stored
    monkeypatch.setattr(simhash_dedup, "stored", lambda df, label: (seen.append(label), store(df, label))[1])
    stars = spark.createDataFrame([(1, 5), (7, 1), (9, 20), (3, 3)], "a long, b long")
    assert {(r.node, r.root) for r in components(stars).collect()} == {(5, 1), (7, 1), (20, 9)} and seen == ["edges"]
    chain = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(-4, 40), (40, -9)], "a long, b long")
    assert {(r.node, r.root) for r in components(chain).collect()} == {*((i, 0) for i in range(1, 7)), (-4, -9), (40, -9)}


def test_variants_are_not_broadcast(spark, monkeypatch, tmp_path):
    """Spark sizes exploded variants as the fingerprints they come from: a table of 1 MB was 64 MB as it was broadcast."""
    plans = {}

    def seen(df, label="table"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return df.localCheckpoint()

    monkeypatch.setattr(simhash_dedup, "stored", seen)
    fps = [random.Random(5).getrandbits(40) for _ in range(5)]
    spark.createDataFrame([(f ^ 1 << k,) for f in fps for k in (60, 61)], "fp long").write.parquet(f"{tmp_path}/fps")
    near_links(spark.read.parquet(f"{tmp_path}/fps"), limit=1).count()
    assert "SortMergeJoin" in plans["variant-groups"] and "BroadcastHashJoin" not in plans["variant-groups"]
