"""Registered queries against their SQL, and the pipeline as a whole."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from factloom.llm import shared
from factloom.llm.queries import ORACLES, QUERIES
from tests.llm.helpers import SF_DIR
from tests.oracle import connect, differences

needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@needs_tables
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(name, spark):
    assert differences(QUERIES[name](spark, SF_DIR), ORACLES[name], connect(SF_DIR)) == []


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(queries())


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF_DIR), "stage")
        rows = docs.collect()
        left = [r["doc_id"] for r in rows]
        assert len(set(left)) == len(left) and set(left) <= ids, name
        assert name == "pieces" or docs.columns == names, name
        assert len(left) > 0.7 * len(ids), name
        ids = set(left)
    assert all(r["round_trip"] for r in rows)


@needs_tables
def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF_DIR), "stage")
    assert docs.count() == 0
