"""Registered corpus queries against SQL where there is one, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, compare
from tillwise.llm.queries import ORACLES, QUERIES

DIRECTORY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{DIRECTORY}/{table}.parquet'")
    assert compare(QUERIES[name](spark, DIRECTORY).toPandas(), duck.execute(ORACLES[name]).df()).startswith("ok")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written_once(stage(spark, docs, DIRECTORY), name)
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and after <= before and len(after) > 0.7 * len(before)
        before = after
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, DIRECTORY).collect()} <= before
