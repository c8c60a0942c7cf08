"""Fill-in-the-middle against a plain loop: cuts, forms, round trips, odd rows and columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from beamlog.llm import fill_in_middle as fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text, seed=7, rate=100, suffix_first=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows(seed=3):
    rng = random.Random(seed)
    pieces = ["\n", "a", "é", "\U0001f600", "<", "<P", ">", " ", "\r", "\x0b", "line", "M>", " "]
    made = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    odd = [(None, "a\nb\nc"), (None, None), (400, None), (401, ""), (402, "\n\n\n"), (403, "has <M> in it\nx"), (404, "no end"), (404, "no end"), (405, "x<P>y"), (406, "<S>"), (407, "<\n<\n<")]
    return made + odd + [(-5, "neg\native\n"), (500, "word \n" * 60_000), (501, "x" * 1_000_000)]


def test_equals_a_plain_loop(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    for seed, rate, first in ((7, 100, 50), (8, 40, 10)):
        got = fim.fill_in_middle(df, {r: r for r in fim.RESULTS}, seed, rate, first).collect()
        assert len(got) == len(rows())
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text, seed, rate, first)
            assert r.restored == (r.text or "") and r.restored_sha256 == sha(r.text or "") and r.output_sha256 == sha(r.output)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_slices_keep_rows_and_columns_together(spark, monkeypatch):
    monkeypatch.setattr(fim, "SLICE_BYTES", 64)
    df = spark.createDataFrame(rows(4)[:200], "doc_id long, text string").select(
        "*", F.lit(1).alias("N"), F.lit("x").alias("form"), F.lit("y").alias("fim_text"), F.create_map(F.lit("k"), F.array(F.col("doc_id"))).alias("tags"), F.current_timestamp().alias("at"))
    got = fim.fill_in_middle(df, {"n": "n", "form": "form", "output": "output"})
    assert got.columns == [*df.columns, "_n", "_form", "output"]
    for r in got.collect():
        want = plain(r.doc_id, r.text)
        assert (r._n, r._form, r.output) == (want[0], want[1], want[4]) and r.tags == {"k": [r.doc_id]} and (r.N, r.form) == (1, "x")


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert fim.fill_in_middle(empty, fim.DIGESTS).collect() == []
    with pytest.raises(ValueError):
        fim.fill_in_middle(empty, {"other": "x"})
    got = fim.fill_in_middle(spark.createDataFrame([("k-1", "a\nb\n")], "doc_id string, text string"), {"output": "o"}).first()
    assert got.o == plain("k-1", "a\nb\n")[4]
