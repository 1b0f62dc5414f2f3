"""The corpus queries against their SQL twins, and the pipeline stage by stage."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import order_minhash, queries, secrets


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, duck, same, name):
    same(queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df())


def test_pipeline_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes[name] = (before, docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = sizes["near_dedup"]
    classes = order_minhash.near_duplicates(before)
    assert after.count() == classes.select("class_id").distinct().count()
    assert order_minhash.near_duplicates(after).where("doc_id <> class_id").count() == 0
    before, after = sizes["secrets"]
    assert after.count() == before.count()
    assert after.where(F.size(secrets.base_spans(F.col("text"))) > 0).count() == 0
    before, after = sizes["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SMALL).count() == after.count()


def test_pipeline_on_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
