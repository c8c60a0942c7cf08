import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from beamlog.llm import near_copies


def shingles(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_keeps_one_of_each_component_at_jaccard_0_8(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"Wört{i}" for i in range(3000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, boiler = [None, "", " \n", "One two", "one  TWO", "one two three"], prose(60)
    for k in range(80):
        base = prose(rng.randint(40, 300)) + (boiler if k % 3 == 0 else [])
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            for at in rng.sample(range(len(base)), max(1, len(base) // rng.randint(30, 70))):
                base = [*base[:at], rng.choice(vocab), *base[at + 1 :]]
            docs.append("\n".join(base))
    docs += [" ".join([*boiler, *prose(13)]) for _ in range(40)]  # share most words with each other, yet below 0.8
    sets = [shingles(t) for t in docs]
    label, close = list(range(len(docs))), []
    for i in range(len(docs)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if not either or both / either >= 0.8:
                close.append(both / either if either else 1)
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert sum(0.8 <= x < 0.9 for x in close) > 10
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(docs)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, str(tmp_path))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert dict(corpus_pipeline.STAGES)["near_dedup"](spark, df.limit(0), str(tmp_path)).count() == 0
    stray = [(None, t, "en", "s", 0) for t in docs[-3:]] + [(7, t, "en", "s", 0) for t in docs[-6:-3]]  # ids that do not tell components apart
    assert dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(stray, df.schema), str(tmp_path)).count() == 6


def test_stage_has_operator_2s_links(spark, tmp_path):
    """Texts that repeat one phrase and end apart: their SimHashes are equal, their shingle sets far below 0.8. A link of either kind joins components."""
    words = lambda a, b: [f"w{i}" for i in range(a, b)]
    docs = [" ".join(words(0, 13) * 60 + words(100 * k, 100 * k + 30)) for k in range(1, 4)]  # 1, 2, 3 by SimHash
    edited = docs[1].split()
    docs.append(" ".join([*edited[:-1], "other"]))  # 4: near 2 by both
    docs.append(" ".join(words(5_000, 5_200)))  # 5: alone
    sets = [shingles(t) for t in docs]
    assert all(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8 for i in range(3) for j in range(i))
    df = spark.createDataFrame([(i + 1, t, "en", "s", 0) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_every_similar_pair_of_a_band_is_joined(spark, tmp_path, monkeypatch):
    """Edits of one text, most pairs of them a little below 0.8: a similar pair need not be similar to its groups' least members."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for _ in range(120):
        words = list(base)
        for at in rng.sample(range(5, 195, 7), 3):
            words[at] = f"x{rng.randrange(10**9)}"
        docs.append(" ".join(words))
    sets = [shingles(t) for t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    monkeypatch.setattr(near_copies, "simhash_links", lambda prints: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(near_copies, "BLOCK_NODES", 16, raising=False)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and 1 < len(set(label)) < 60


def test_members_of_bands_are_not_broadcast(spark, tmp_path, monkeypatch):
    plans = {}

    def seen(df, label="table"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return df.localCheckpoint()

    monkeypatch.setattr(near_copies, "stored", seen)
    spark.createDataFrame([(k, 3, [9]) for k in range(3)], "node long, n long, bands array<long>").write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    sets_of = lambda some: some.select("node", F.array(F.lit(1), F.lit(2), F.lit(3)).cast("array<long>").alias("shingles"))
    assert near_copies.copy_links(nodes, sets_of, spark.createDataFrame([], "a long, b long")).count() == 2
    assert "SortMergeJoin" in plans["band-members"] and "BroadcastHashJoin" not in plans["band-members"]
