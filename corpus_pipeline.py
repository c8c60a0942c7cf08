"""The training-data pipeline: each stage works on all that the one before it kept.

Stages write nothing themselves; whoever runs them writes each result as Parquet and reads it back as the
next stage's documents, as ``run`` does in the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamlog.llm.common import stored
from beamlog.llm.decontamination import decontaminate
from beamlog.llm.exact_dedup import deduplicated
from beamlog.llm.mixing import mixed_documents
from beamlog.llm.near_copies import drop_near_copies
from beamlog.llm.toxicity import fitted_toxicity, toxicity_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the model is fitted on the labelled ones.

    Null and empty texts score like texts without a toxic word. Labels of one class only, or none, keep or
    reject all alike (none: all stay). Repeated rows share their fate; an empty table stays empty.
    """
    model = fitted_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity_scores(docs.select([F.col(c).alias(f"d_{c}") for c in docs.columns]), [f"d_{c}" for c in docs.columns], model, "d_text")
    return scored.where("score < 0.5").select([F.col(f"d_{c}").alias(c) for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id.

    Null and blank texts are one group; of repeated rows one stays.
    """
    return deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest id.

    Near copies are texts that operator 2 links (SimHash within 2 bits), and those with a five-word shingle Jaccard of 0.8 or more.

    Texts without words, null ones among them, are one component; of repeated rows one stays.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut, with n_chars counted anew; a document that is mostly benchmark goes.

    Null and empty texts and documents without a passage pass as they are, repeated rows alike.
    """
    marked = docs.withColumn("_old_text", F.col("text")) if "n_chars" in docs.columns else docs
    left = decontaminate(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" not in docs.columns:
        return left
    of = docs.schema["n_chars"].dataType
    return left.withColumn("n_chars", F.when(F.col("text") != F.col("_old_text"), F.length("text").cast(of)).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their copies and their source's target.

    Documents without words are kept as one copy that takes nothing; a null source is a source of its own.
    """
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The first stage scores with a trained model, which SQL cannot express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
