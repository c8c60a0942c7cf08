"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, map_batches, stored, text_bytes
from .subword import ngrams, word_buffer
from .toxicity import held_out_by_id, within_bytes

SIZES = (2, 3, 4)
BITS = 16
#: Rows of each language that the machines are fitted on, at most; taken in order of a hash of the id.
SAMPLE_ROWS = 600
#: Rows of all languages together, which so many languages share that each has fewer than SAMPLE_ROWS; each keeps LEAST_ROWS.
SAMPLE_TOTAL, LEAST_ROWS = 60_000, 20
#: Text bytes of the sample, at most; the driver holds them.
SAMPLE_BYTES = 64 << 20
#: Names that one vote tells apart, at most; more are put in groups of at most GROUP that resemble each other.
WIDEST, GROUP = 12, 4
EPOCHS = 60
RIDGE = 1e-4

# Language families. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
}


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower() in members), lang)


def chunk_sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: sums of the n-grams' weight rows, and the number of n-grams."""
    buffer, place, first = word_buffer(data, offsets)
    rows = len(first) - 1
    sums, count = np.zeros((rows, weights.shape[1])), np.zeros(rows)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        at = place[first[some]]
        for _, bucket, valid in ngrams(buffer, place, SIZES, BITS):
            bucket = np.where(valid, bucket, np.uint64(1 << BITS)).astype(np.int64)  # the last weight row is zero
            for k in range(weights.shape[1]):
                sums[some, k] += np.add.reduceat(weights[bucket, k], at)
            count[some] += np.add.reduceat(valid.astype(np.int64), at)
    return sums, count


@dataclass
class Vote:
    """A one-versus-one vote among ``below``: languages, or votes among more. ``first`` is its first machine's column."""

    below: list[Vote | str]
    first: int

    @property
    def columns(self) -> slice:
        return slice(self.first, self.first + len(self.below) * (len(self.below) - 1) // 2)


@dataclass
class LanguageModel:
    """Machines in layers: between families (or groups of them), then between the languages of one family.

    ``weights`` has a column per machine and a zero row at the end; positive margins vote for the earlier name.
    """

    families: list[str]
    top: Vote | str | None
    weights: np.ndarray
    bias: np.ndarray

    @staticmethod
    def winners(names: int, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner by one-versus-one votes, ties by summed margins, and a confidence from 0 to 1."""
        votes, total, least = (np.zeros((len(margins), names)) for _ in range(3))
        least[:] = np.inf
        for k, (i, j) in enumerate(combinations(range(names), 2)):
            m = margins[:, k]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            total[:, i] += m
            total[:, j] -= m
            least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = np.argmax(votes + 1e-3 * np.tanh(total), axis=1)
        return best, 1 / (1 + np.exp(-2 * np.clip(least[np.arange(len(best)), best], -30, 30)))

    def chunk_predictions(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if self.top is None:
            return ["und"] * n, np.zeros(n)
        out, sure = np.empty(n, object), np.ones(n)
        todo = [(self.top, np.arange(n))]
        while todo:
            vote, mine = todo.pop()
            if isinstance(vote, str):
                out[mine] = vote
            elif len(mine):
                size = offsets[mine + 1] - offsets[mine]
                own = np.concatenate([[0], np.cumsum(size)])
                part = data if len(mine) == n else data[np.repeat(offsets[mine] - own[:-1], size) + np.arange(own[-1])]
                sums, count = chunk_sums(part, own, self.weights[:, vote.columns])
                best, also = self.winners(len(vote.below), sums / np.maximum(1, count)[:, None] + self.bias[vote.columns])
                sure[mine] *= also
                todo += [(b, mine[best == k]) for k, b in enumerate(vote.below)]
        return list(out), np.clip(sure, 0, 1)


def linear_svm(owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM with ridge on sparse rows, classes weighted alike; accelerated gradient steps."""
    n, d = len(sign), 1 << BITS
    share = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    squared = np.bincount(owner, value**2, minlength=n)
    step = 1 / (2 * (squared.max() + 1) + RIDGE)
    w, b, v, c = np.zeros(d), 0.0, np.zeros(d), 0.0
    for t in range(EPOCHS):
        margin = np.bincount(owner, value * v[bucket], minlength=n) + c
        pull = -2 * share * sign * np.maximum(0, 1 - sign * margin)
        nw, nb = v - step * (np.bincount(bucket, value * pull[owner], minlength=d) + RIDGE * v), c - step * pull.sum()
        m = t / (t + 3)
        v, c, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    return w, b


def fit_languages(texts: list[str], langs: list[str]) -> LanguageModel:
    """Fits on whole texts with one language each. Features are n-gram frequencies of whole texts, scaled to about unit norm."""
    present = sorted(set(langs))
    if not present:
        return LanguageModel([], None, np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0))
    families = sorted({family_of(x) for x in present})
    blobs = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(blobs), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in blobs])])
    parts = []
    for i, j in chunks(offsets):
        buffer, place, first = word_buffer(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if len(place) < 2:
            continue
        row = np.repeat(np.repeat(np.arange(j - i), np.diff(first)), np.diff(place)) + i
        keys = [(row[valid] << BITS) | bucket[valid].astype(np.int64) for _, bucket, valid in ngrams(buffer, place, SIZES, BITS)]
        parts.append(np.unique(np.concatenate(keys), return_counts=True))
    key = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    n = np.concatenate([p[1] for p in parts]).astype(float) if parts else np.zeros(0)
    owner, bucket = key >> BITS, key & ((1 << BITS) - 1)
    value = n / np.maximum(1, np.bincount(owner, n, minlength=len(texts)))[owner]
    scale = 1 / max(1e-9, float(np.sqrt(np.bincount(owner, value**2, minlength=len(texts)).mean())))  # rows of about unit norm
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))  # owners ascend
    rows_of = {x: [] for x in present}
    for r, x in enumerate(langs):
        rows_of[x].append(r)
    weights, bias = [], []

    def voted(items: list[tuple[np.ndarray, Vote | str]]) -> Vote | str:
        """A vote among (rows, below) items; a single one needs none."""
        if len(items) == 1:
            return items[0][1]
        vote = Vote([below for _, below in items], len(weights))
        weights.extend([None] * (len(items) * (len(items) - 1) // 2))
        bias.extend([0.0] * (len(items) * (len(items) - 1) // 2))
        for k, ((a, _), (b, _)) in enumerate(combinations(items, 2), vote.first):
            rows = np.sort(np.concatenate([a, b]))
            held = ends[rows + 1] - ends[rows]
            mine = np.repeat(ends[rows] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            w, bias[k] = linear_svm(np.repeat(np.arange(len(rows)), held), bucket[mine], value[mine] * scale, np.where(np.isin(rows, a), 1.0, -1.0))
            weights[k] = (w * scale).astype(np.float32)
        return vote

    def grouped(items: list[tuple[np.ndarray, Vote | str]]) -> Vote | str:
        """A vote of at most WIDEST items; more of them first go into groups of neighbours in a chain of similar profiles."""
        while len(items) > WIDEST:
            profile = np.zeros((len(items), 1 << 12), np.float32)
            for k, (rows, _) in enumerate(items):
                for r in rows:
                    np.add.at(profile[k], bucket[ends[r] : ends[r + 1]] & 0xFFF, value[ends[r] : ends[r + 1]])
            profile /= np.maximum(1e-9, np.linalg.norm(profile, axis=1))[:, None]
            chain, free = [0], np.ones(len(items), bool)
            free[0] = False
            while free.any():
                chain.append(int(np.argmax(np.where(free, profile @ profile[chain[-1]], -np.inf))))
                free[chain[-1]] = False
            runs = np.array_split(chain, -(-len(items) // GROUP))
            items = [(np.concatenate([items[k][0] for k in run]), voted([items[k] for k in run])) for run in runs]
        return voted(items)

    kin = [[x for x in present if family_of(x) == f] for f in families]
    rows = {x: np.array(r) for x, r in rows_of.items()}
    top = grouped([(np.concatenate([rows[x] for x in own]), grouped([(rows[x], x) for x in own])) for own in kin])
    table = np.zeros(((1 << BITS) + 1, len(weights)), np.float32)
    for k, w in enumerate(weights):
        table[:-1, k] = w
    return LanguageModel(families, top, table, np.array(bias))


def language_sample(docs: DataFrame, eligible: Column, rows: int = SAMPLE_ROWS, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", size: int = SAMPLE_BYTES) -> tuple[list[str], list[str]]:
    """Whole texts and languages of at most ``rows`` eligible rows of every language, in order of a hash of the id.

    All languages together take ``size`` bytes of text at most, each an equal share of them (its first row always).
    Of rows that share id and language, the text of the least hash counts.
    """
    hashed = F.struct(F.xxhash64(F.col(text)).alias("key"), F.octet_length(F.col(text)).alias("bytes"))
    texts = docs.where(eligible & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}")).select(F.col(doc_id).alias("_l_id"), F.col(lang).alias("_l_lang"), hashed.alias("_l_of"))
    known = texts.groupBy("_l_id", "_l_lang").agg(F.min("_l_of").alias("_l_of")).select("_l_id", "_l_lang", F.col("_l_of.key").alias("_l_key"), F.col("_l_of.bytes").cast("long").alias("_l_bytes"))
    known = stored(known, "eligible")  # one scan of the texts, whatever the number of languages
    names = max(1, known.select("_l_lang").distinct().count())
    rows = min(rows, max(LEAST_ROWS, SAMPLE_TOTAL // names))
    # Spark keeps the first rows of each language before the shuffle already (WindowGroupLimit), so a large one does not skew it.
    ranked = known.withColumn("_l_rank", F.row_number().over(Window.partitionBy("_l_lang").orderBy(F.xxhash64("_l_id"), "_l_id"))).where(F.col("_l_rank") <= rows)
    ids = stored(within_bytes(ranked, size // names, "_l_lang").select("_l_id", "_l_lang", "_l_key"), "sample-ids")
    got = docs.select(F.col(doc_id).alias("_l_id"), F.col(lang).alias("_l_lang"), F.xxhash64(F.col(text)).alias("_l_key"), F.col(text).alias("_l_text")).join(F.broadcast(ids), ["_l_id", "_l_lang", "_l_key"]).dropDuplicates(["_l_id", "_l_lang", "_l_key"])
    triples = sorted((r["_l_lang"], str(r["_l_id"]), r["_l_text"]) for r in got.collect())
    return [t for *_, t in triples], [name for name, *_ in triples]


def language_predictions(docs: DataFrame, carry: list[str], model: LanguageModel, text: str = "text") -> DataFrame:
    """``carry`` columns, lang_pred and score of each whole text; ``und`` with score 0 where it is null or has no letter."""
    rows = docs.select(*[F.col(c).alias(f"_g_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_g_text"), F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("_g_ok"))
    schema = T.StructType([*[rows.schema[f"_g_c{i}"] for i in range(len(carry))], T.StructField("_g_lang", T.StringType()), T.StructField("_g_score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows of one float a machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_g_text"))
            ok = batch.column("_g_ok").to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                lang, score = shared.value.chunk_predictions(data[int(offsets[i]) : int(offsets[j])], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f"_g_c{c}").slice(i, j - i) for c in range(len(carry))], pa.array([x if y else "und" for x, y in zip(lang, ok[i:j])], pa.string()), pa.array(np.where(ok[i:j], score, 0.0))],
                    names=schema.names)

    return map_batches(rows, run, schema).toDF(*carry, "lang_pred", "score")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(*language_sample(docs, ~held_out_by_id("doc_id", 4, 2)))
    got = language_predictions(docs, ["doc_id"], model)
    return got.select("doc_id", held_out_by_id("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
