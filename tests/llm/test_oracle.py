import pytest

from beamlog.llm.queries import oracle_sql, queries

from ..oracle_tools import SF_DIR, database, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    assert rows_of(queries()[name](spark, SF_DIR)) == rows_of_sql(database(), oracle_sql()[name])


def test_held_out_documents(spark):
    """Languages of documents that were not learned from, by name; toxicity against the labels."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = queries()["op5_language_id"](spark, SF_DIR).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = queries()["op4_toxicity"](spark, SF_DIR).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.85 * len(scored)
