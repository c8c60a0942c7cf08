"""Planted keys of each class, and the edge cases that other files leave out."""

import base64
import hashlib
import random
import uuid

from pyspark.sql import functions as F

from beamlog.llm import exact_dedup, language, mixing, near_copies
from beamlog.llm.common import CHUNK_BYTES
from beamlog.llm.secrets import KINDS, secret_spans
from beamlog.llm.substring_dedup import substring_dedup
from beamlog.llm.suffix_dedup import suffix_dedup
from beamlog.llm.warc import resolve_revisits

from ..oracle_tools import SF_DIR


def planted(kind, rng):
    raw = bytes(rng.randrange(256) for _ in range(rng.randint(18, 40)))
    return {"entropy_hex": lambda: raw.hex(), "entropy_upper": lambda: raw.hex().upper(), "entropy_b64": lambda: base64.b64encode(raw).decode().rstrip("=")}[kind]()


def test_planted_keys_are_found_and_clean_texts_left_alone(spark):
    """Recall and false alarms of the entropy spans: at least 0.95 of each class, and at most 1 in 100 clean texts."""
    rng = random.Random(17)
    kinds = ("entropy_hex", "entropy_b64", "entropy_upper")
    prose = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").where("lang is not null").select("text").collect() if r.text]
    bare = spark.createDataFrame([(i, t) for i, t in enumerate(prose)], "doc_id long, text string")
    clean = {r.doc_id for r in secret_spans(bare, ["doc_id"]).collect() if not any(r[k] for k in KINDS)}
    texts = [prose[i] for i in sorted(clean)]
    rows, at = [], []
    for n in range(300):
        kind, text = kinds[n % 3], rng.choice(texts)
        cut, key = rng.randint(0, min(len(text), 2_000)), planted(kinds[n % 3], rng)
        rows.append((n, f"{text[:cut]} {key} {text[cut:]}"))
        at.append((kind, cut + 1, cut + 1 + len(key)))
    found = dict.fromkeys(kinds, 0)
    for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect():
        kind, s, e = at[r.doc_id]
        found[kind] += any(x.s < e and s < x.e for k in KINDS for x in r[k])
    assert all(found[k] >= 95 for k in kinds), found
    harmless = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(50)] + ["a_long_name_of_some_function", "SomeLongCamelCaseIdentifierName", "https://example.org/a/long/path/to/some/page", "1234567890" * 4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = [(i, f"{rng.choice(texts)[:300]} {h} end") for i, h in enumerate(harmless)]
    alarms = [r.doc_id for r in secret_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect() if any(r[k] for k in kinds)]
    assert len(alarms) <= 1, [harmless[i] for i in alarms]
    assert len(prose) - len(clean) <= 0.4 * len(prose)  # the tables hold secrets of their own


def test_a_text_longer_than_a_chunk(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(60_000)) + " password=hunter2hunter2"
    assert len(long) > CHUNK_BYTES
    rows = [(1, long, "a"), (2, long.replace(" ", "\n"), "a"), (3, long[:-1] + "3", "b"), (4, "short text of some words", "b"), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, {"doc_id": F.col("doc_id")}).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1), 5: (5, 1)}
    spans = {r.doc_id: [(x.s, x.e) for x in r.assign] for r in secret_spans(df, ["doc_id"]).collect()}
    assert spans[1] == [(len(long) - len("password=hunter2hunter2"), len(long))] and spans[4] == spans[5] == []
    mixed = mixing.mix_sources(df, carry=["doc_id"]).collect()
    assert {r["doc_id"]: r["size"] for r in mixed}[1] == 60_001 and all(r["taken"] <= 3 * r["size"] for r in mixed)
    kept = {r.doc_id for r in near_copies.drop_near_copies(df).collect()}
    assert len(kept & {1, 2, 3}) == 1 and {4, 5} <= kept
    model = language.fit_languages(["the cat and the dog of the house"] * 5 + ["der hund und die katze des hauses"] * 5, ["en"] * 5 + ["de"] * 5)
    told = spark.createDataFrame([(1, "the dog and the house of cats " * 12_000), (2, "die katze und der hund " * 16_000), (3, None), (4, "123 456")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.language_predictions(told, ["doc_id"], model).collect()} == {1: "en", 2: "de", 3: "und", 4: "und"}


def test_languages_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    texts, langs = language.language_sample(empty, F.lit(True))
    assert (texts, langs) == ([], []) and language.language_predictions(empty, ["doc_id"], language.fit_languages(texts, langs)).count() == 0


def test_many_rows_of_the_same_id_and_text(spark):
    """Repeated rows are copies like any other: 3,000 rows of one id and text lose all their windows."""
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(7, text)] * 3_000 + [(8, "other words " * 3), (9, text + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    words = substring_dedup(df, ["doc_id"], digest=True).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.doc_id: (r.n_words, r.n_removed, r["count"]) for r in words} == {7: (120, 120, 3_000), 8: (6, 0, 1), 9: (121, 120, 1)}
    assert {r.doc_id: r.kept_sha256 for r in words}[7] == empty
    bytes_of = {r.doc_id: (r.n_removed, r["count"]) for r in suffix_dedup(df, ["doc_id"], digest=True).groupBy("doc_id", "n_removed").count().collect()}
    assert bytes_of == {7: (len(text), 3_000), 8: (0, 1), 9: (len(text), 1)}


def test_revisits_with_clashing_columns(spark):
    rows = [("r1", "http://a/x", "2024-01-01 00:00:00", 200, {"ETag": "1"}, "d1"), ("r2", "http://a/x", "2024-01-02 00:00:00", 304, {"etag": "1"}, None)]
    df = spark.createDataFrame(rows, "record_id string, url string, captured_at string, status int, headers map<string,string>, digest string").withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    plain = resolve_revisits(df).collect()
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("canonical_url", "at", "full", "own", "moment", "slice", "latest", "ref_id", "outcome", "OWN_DIGEST")])
    assert [tuple(map(str, r)) for r in resolve_revisits(odd).collect()] == [tuple(map(str, r)) for r in plain] and plain[0].outcome == "resolved"
