"""The pipeline's stages and its registered queries on the smallest data."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_points.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_keeps_the_right_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).select((F.col("doc_id") + 100000).alias("doc_id"), "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(200000, None, "en", "src0", 0), (200001, "12 34", None, None, None), (None, None, None, None, None)], docs.schema)
    kept, step = docs.unionByName(extra).unionByName(odd).unionByName(docs.limit(2)), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).persist()
        step[name] = kept.count()
        if name != "shards":
            assert kept.columns == docs.columns
    assert step["language"] == docs.count() + 5
    assert step["near_duplicates"] <= docs.count() and step["benchmark"] < step["near_duplicates"]
    assert step["shards"] == step["mixture"] < step["benchmark"]
    assert kept.select("doc_id").distinct().count() == step["shards"]


def test_stages_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name != "benchmark" or os.path.isdir(SF):
            assert stage(spark, empty, SF).collect() == []
