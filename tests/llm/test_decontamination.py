import random

import pytest

from beamlog.llm.decontamination import benchmark_matches, decontaminate, hit_words, item_words


def brute(docs, items):
    out = {}
    for d, text in docs:
        words, hit, found = item_words(text), set(), set()
        for i, t in items:
            own = item_words(t)
            n = min(10, len(own))
            for k in range(len(own) - n + 1) if n else []:
                for a in range(len(words) - n + 1):
                    if words[a : a + n] == own[k : k + n]:
                        hit |= set(range(a, a + n))
                        found.add(str(i))
        out[d] = (len(words), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("short,block_bytes", [(1, 1 << 20), (3, 1 << 20), (10, 1 << 20), (2, 150)])
def test_matches_brute_force(spark, short, block_bytes):
    rng = random.Random(short)
    words = lambda n: " ".join(rng.choice(["Ab", "c", "dé", "e1", "f"]) for _ in range(n))
    items = [(i, words(rng.randint(short, 25))) for i in range(12)] + [(50, None), (51, " !"), (3, words(12))]
    docs = [(0, None), (1, ""), (2, "...")]
    for d in range(3, 40):
        parts = [words(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split()
            parts += [", ".join(own[rng.randint(0, 5) :]).upper(), words(rng.randint(0, 9))]
        docs.append((d, "\n".join(parts)))
    docs.append(docs[5])
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = benchmark_matches(df, bench, ["doc_id"], block_bytes=block_bytes).select("doc_id", "n_words", hit_words().alias("n"), "items").collect()
    assert len(got) == len(docs)
    assert {r[0]: tuple(r)[1:] for r in got} == brute(docs, items)


def test_decontaminate_cuts_and_drops(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"Start here. {item.upper()}! And on with {'more ' * 30}", "x"), (2, item, "x"), (3, "clean Text", "x"), (4, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in decontaminate(df, spark.createDataFrame([("a", item)], "item_id string, text string")).collect()}
    assert sorted(got) == [1, 3, 4]
    assert got[1]["text"] == "Start here. ! And on with " + "more " * 30
    assert got[3]["text"] == "clean Text" and got[4]["text"] is None and got[1]["spans"] == "x"
    assert decontaminate(df.limit(0), spark.createDataFrame([], "item_id string, text string")).count() == 0
