"""Toxicity by subword-bag embeddings: averaged n-gram vectors of a word into a linear softmax, trained jointly."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_batches, stored, text_bytes
from .subword import counts_of, ngrams, word_buffer, word_sums

SIZES = (3, 4, 5, 6)
BITS = 17
DIM = 8
#: Labelled rows of each class that the model is fitted on, at most; taken in order of a hash of the id.
SAMPLE_ROWS = 1_000
#: Text bytes of each class in the sample, at most; the driver holds them.
SAMPLE_BYTES = 32 << 20
EPOCHS = 120
#: Words whose n-grams are laid out at once; bounds the driver's memory.
SLICE_WORDS = 20_000
#: Weight of an edited spelling against a labelled text.
EDIT_WEIGHT = 1.0
RATE = 0.15


@dataclass
class ToxicityModel:
    """``weights``: what each n-gram bucket adds to a word's logit (its vector times the softmax difference)."""

    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def chunk_scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Highest word-bag probability of each row; a row without words gets the lowest score."""
        buffer, place, first = word_buffer(data, offsets)
        best = np.full(len(first) - 1, -30.0)
        if len(place) > 1:
            logits = word_sums(buffer, place, self.weights, SIZES, BITS) / np.maximum(1, counts_of(place, SIZES)) + self.bias
            some = np.flatnonzero(np.diff(first))
            best[some] = np.maximum.reduceat(logits, first[some])
        return _sigmoid(self.scale * best + self.shift)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _edited(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one byte dropped, doubled, swapped with the next, or replaced by a look-alike digit or letter."""
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    if kind == 0:
        return word[:i] + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i : i + 1] + word[i:]
    if kind == 2:
        return word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]
    alike = {b"o": b"0", b"i": b"1", b"e": b"3", b"a": b"4", b"s": b"5", b"t": b"7"}
    return word[:i] + alike.get(word[i : i + 1], b"x") + word[i + 1 :]


def fit_toxicity(texts: list[str], labels: list[int], seed: int = 7) -> ToxicityModel:
    """Fits n-gram vectors and the softmax jointly on whole texts with one label each.

    A text is toxic if one of its words is (noisy-or over its distinct words), so a few toxic words in a long
    text are not averaged away. A word's vector is the mean of its n-gram vectors. After a third and two
    thirds of the epochs, edited spellings of the words found toxic, and of as many others, join the training
    words. The last fifth
    of the texts is held out to calibrate the text score. With one class only, scores are constant.
    """
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << BITS, np.float32), 0.0, 0.0, -4.0 if len(y) == 0 or y.max() == 0 else 4.0)
    blobs = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    vocab: dict[bytes, int] = {}
    docs: list[np.ndarray] = []
    for i, j in chunks(offsets):
        buffer, place, first = word_buffer(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        raw, at = buffer.tobytes(), place.tolist()
        for a, b in zip(first[:-1], first[1:]):
            own = sorted({raw[at[k] + 1 : at[k + 1]] for k in range(a, b)})
            docs.append(np.array([vocab.setdefault(w, len(vocab)) for w in own], np.int32))
    words = list(vocab)
    rng = np.random.default_rng(seed)
    train = np.arange(len(y)) % 5 != 4
    if len(set(y[train])) < 2 or len(set(y[~train])) < 2:
        train[:] = True

    def table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words' n-grams, word by word, and how many each word has."""
        buckets, sizes = [], []
        for i in range(0, len(words), SLICE_WORDS):
            joined = b" ".join(words[i : i + SLICE_WORDS])
            buffer, place, _ = word_buffer(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
            word_at = np.repeat(np.arange(len(place) - 1), np.diff(place))
            got = [(word_at[valid], bucket[valid].astype(np.int32)) for _, bucket, valid in ngrams(buffer, place, SIZES, BITS)]
            owner, bucket = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            buckets.append(bucket[np.argsort(owner, kind="stable")])
            sizes.append(np.bincount(owner, minlength=len(place) - 1))
        return np.concatenate(buckets), np.concatenate(sizes)

    E = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    u, bias = rng.normal(0, 0.5, DIM).astype(np.float32), -5.0
    GE, gu, gb = np.full(1 << BITS, 1e-6, np.float32), np.full(DIM, 1e-6), 1e-6
    picked = [docs[i] for i in np.flatnonzero(train)]
    target = y[train]
    weight = np.where(target == 1, len(target) / (2 * target.sum()), len(target) / (2 * (len(target) - target.sum())))
    bucket, n = table(words)
    for epoch in range(EPOCHS):
        if epoch in (EPOCHS // 3, 2 * EPOCHS // 3):
            z = np.add.reduceat((E @ u)[bucket], np.concatenate([[0], np.cumsum(n)[:-1]])) / n + bias
            toxic = np.flatnonzero(z[: len(vocab)] > 0)
            calm = np.flatnonzero(z[: len(vocab)] <= -1)
            clean = rng.choice(calm, min(len(calm), max(1_000, len(toxic))), replace=False)
            more = [(_edited(words[v], rng), lab) for ids, lab in ((np.repeat(toxic, 6), 1.0), (np.repeat(clean, 6), 0.0)) for v in ids]
            fresh = list({w: (w, lab) for w, lab in more if w not in vocab}.values())
            if fresh:
                base = len(words)
                words = words + [w for w, _ in fresh]
                GE[:], gu[:], gb = 1e-6, 1e-6, 1e-6  # the step sizes start again
                bucket, n = table(words)
                picked = picked + [np.array([base + k]) for k in range(len(fresh))]
                target = np.concatenate([target, [lab for _, lab in fresh]])
                weight = np.concatenate([weight, np.full(len(fresh), EDIT_WEIGHT)])
        sizes = np.array([len(p) for p in picked])
        flat, owner = np.concatenate(picked), np.repeat(np.arange(len(picked)), sizes)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        z = np.add.reduceat((E @ u)[bucket], starts) / n + bias
        soft = np.logaddexp(0, z)
        none = np.bincount(owner, soft[flat], minlength=len(picked))  # -log of the chance that no word is toxic
        p = -np.expm1(-np.maximum(none, 1e-9))
        pull = np.where(target == 1, -(1 - p) / np.maximum(p, 1e-9), 1.0) * weight
        grad = np.bincount(flat, pull[owner], minlength=len(words)) * _sigmoid(z) / len(picked)
        active = np.flatnonzero(np.abs(grad) > 1e-5 * np.abs(grad).max())  # clean words soon pull on nothing
        on_bucket = np.zeros(1 << BITS)
        for i in range(0, len(active), SLICE_WORDS):
            some = active[i : i + SLICE_WORDS]
            span = n[some]
            ids = np.repeat(starts[some] - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(span.sum())
            on_bucket += np.bincount(bucket[ids], np.repeat(grad[some] / span, span), minlength=1 << BITS)
        on_bucket = on_bucket.astype(np.float32)
        hit = np.flatnonzero(on_bucket)
        du = on_bucket[hit] @ E[hit]
        GE[hit] += on_bucket[hit] ** 2 * float(u @ u)
        E[hit] -= (RATE * 3 * on_bucket[hit] / np.sqrt(GE[hit]))[:, None] * u
        gu += du**2
        u -= (RATE * 0.3 * du / np.sqrt(gu)).astype(np.float32)
        db = grad.sum()
        gb += db**2
        bias -= RATE * db / np.sqrt(gb)
    model = ToxicityModel((E @ u).astype(np.float32), float(bias), 1.0, 0.0)
    raw = _best_logits(model, data, offsets)
    check = ~train if (~train).any() else train
    model.scale, model.shift = _calibrated(raw[check], y[check])
    return model


def _best_logits(model: ToxicityModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = [model.chunk_scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
    p = np.clip(np.concatenate(out), 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic fit of the label on the text logit; class-balanced, with a small ridge, by Newton steps."""
    a, b = 1.0, 0.0
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        g = np.array([(w * (p - y) * z).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
        s = w * p * (1 - p)
        H = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-3]])
        step = np.linalg.solve(H, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)


def held_out_by_id(doc_id: str, parts: int, left_out: int) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == left_out, F.lit(False))


def within_bytes(ranked: DataFrame, limit: int, by: str) -> DataFrame:
    """Rows (_l_rank, _l_bytes) of each ``by`` in order of rank until their texts together exceed ``limit`` bytes; the first always."""
    so_far = F.sum("_l_bytes").over(Window.partitionBy(by).orderBy("_l_rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_l_sum", so_far).where((F.col("_l_sum") <= limit) | (F.col("_l_rank") == 1)).drop("_l_sum")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, eligible: Column, rows: int = SAMPLE_ROWS, text: str = "text", doc_id: str = "doc_id", size: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of at most ``rows`` eligible rows and ``size`` bytes of each class, in order of a hash of the id.

    Of rows that share an id, the text of the least hash counts; an id with both labels has the greater one. Ids are
    picked without their texts; at most 2 x ``rows`` of them are broadcast to the scan of the texts.
    """
    of = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_l_id")).agg(F.max((F.col(label) > 0).cast("int")).alias("_l_y"))
    hashed = F.struct(F.xxhash64(F.col(text)).alias("key"), F.octet_length(F.col(text)).alias("bytes"))
    texts = docs.where(eligible & F.col(text).isNotNull()).select(F.col(doc_id).alias("_l_id"), hashed.alias("_l_of"))
    known = stored(texts.join(of, "_l_id").groupBy("_l_id", "_l_y").agg(F.min("_l_of").alias("_l_of")).select("_l_id", "_l_y", F.col("_l_of.key").alias("_l_key"), F.col("_l_of.bytes").cast("long").alias("_l_bytes")), "labelled")
    by_hash = lambda y: known.where(F.col("_l_y") == y).orderBy(F.xxhash64("_l_id"), "_l_id").limit(rows)
    first = by_hash(0).unionByName(by_hash(1)).withColumn("_l_rank", F.row_number().over(Window.partitionBy("_l_y").orderBy(F.xxhash64("_l_id"), "_l_id")))
    ids = stored(within_bytes(first, size, "_l_y").select("_l_id", "_l_y", "_l_key"), "sample-ids")
    got = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_l_id"), F.xxhash64(F.col(text)).alias("_l_key"), F.col(text).alias("_l_text")).join(F.broadcast(ids), ["_l_id", "_l_key"])
    pairs = {(zlib.crc32(str(r["_l_id"]).encode()), str(r["_l_id"]), r["_l_y"], r["_l_text"]) for r in got.dropDuplicates(["_l_id", "_l_key"]).collect()}
    ordered = sorted(pairs)  # classes mixed, the same every run
    return [t for *_, t in ordered], [y for *_, y, _ in ordered]


def toxicity_scores(docs: DataFrame, carry: list[str], model: ToxicityModel, text: str = "text") -> DataFrame:
    """``carry`` columns and score (0 to 1) of each whole text; null and empty texts score like texts without any toxic word."""
    rows = docs.select(*[F.col(c).alias(f"_t_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_t_text"))
    schema = T.StructType([*[rows.schema[f"_t_c{i}"] for i in range(len(carry))], T.StructField("_t_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS floats, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_t_text"))
            for i, j in chunks(offsets):
                score = shared.value.chunk_scores(data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*[batch.column(f"_t_c{c}").slice(i, j - i) for c in range(len(carry))], pa.array(score)], names=schema.names)

    return map_batches(rows, run, schema).toDF(*carry, "score")


def fitted_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    return fit_toxicity(*labelled_sample(docs, labels, "toxic", ~held_out_by_id(doc_id, 5, 0), text=text, doc_id=doc_id))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = toxicity_scores(docs, ["doc_id"], fitted_toxicity(docs, labels))
    return got.select("doc_id", held_out_by_id("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
