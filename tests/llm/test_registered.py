"""Every registered query of this folder runs; those with SQL agree with DuckDB value by value."""

import importlib
import os

import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from labelpool.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem, rows, _ = compare(spark, con, SF, *QUERIES[name])
    assert problem is None, problem
    assert rows


def test_entry_module_has_all(spark):
    module = importlib.import_module("__spark_entry__")
    assert set(QUERIES) | {"pipeline"} <= set(module.queries())


def test_pipeline_stages(spark):
    """Each stage passes on rows of its input unchanged, and what it decides takes effect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(0)).withColumn("n", F.lit(0))
    odd = [(9001, None, None, None, None, 0, 0), (9002, "", "en", "s", 0, 0, 0), (9003, "12 34", "en", "s", 5, 0, 0)]
    copy = docs.orderBy(F.desc("n_chars")).limit(1).withColumn("doc_id", F.lit(9100).cast("bigint"))
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(copy)
    columns = docs.columns
    twin = docs.join(copy.select("text"), "text").agg(F.min("doc_id")).first()[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = docs.collect()
        assert docs.columns == columns
        assert set(after) <= set(before) and after
        ids = {r.doc_id for r in after}
        if name == "language_id":
            assert not ids & {9001, 9002, 9003}
        if name == "exact_dedup":
            assert 9100 in ids and twin not in ids
            assert len({r.text for r in after}) == len(after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
