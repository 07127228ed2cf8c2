"""The corpus pipeline, stage by stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from depotlens.llm import decontamination, mixing, near_dedup
from depotlens.sources.scratch import materialise

from .conftest import SCHEMA


@pytest.fixture(scope="module")
def stages(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, small), name)
        out[name] = (before, docs)
    return out


def test_stages_return_the_columns_of_documents(spark, small, stages):
    columns = set(spark.read.parquet(f"{small}/documents.parquet").columns)
    names = list(stages)
    assert all(set(stages[n][1].columns) == columns for n in names[:-1])
    assert names == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_files"]


def test_quality_keeps_good_documents(spark, small, stages):
    before, after = stages["quality_classifier"]
    labels = spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").select("doc_id")
    good = before.join(labels, "doc_id", "left_semi").count()
    assert after.join(labels, "doc_id", "left_semi").count() >= 0.97 * good
    assert after.exceptAll(before).isEmpty() and after.count() < before.count()


def test_one_document_of_each_class(stages):
    before, after = stages["minhash_near_dedup"]
    classes = near_dedup.near_duplicates(before)
    assert after.count() == classes.select("class_id").distinct().count()
    assert {r.doc_id for r in after.collect()} == {r.class_id for r in classes.collect()}
    assert after.exceptAll(before).isEmpty()


def test_no_benchmark_window_is_left(spark, small, stages):
    before, after = stages["benchmark_decontamination"]
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    clean = decontamination.contamination(before, items).where("not contaminated").select("doc_id")
    assert decontamination.contamination(after, items).where("contaminated").count() == 0
    assert before.join(clean, "doc_id", "left_semi").exceptAll(after.select(before.columns)).isEmpty()
    assert after.count() == before.count()


def test_the_mix_takes_what_the_operator_says(stages):
    before, after = stages["source_mixing"]
    want = mixing.mix(before).select("doc_id", "copies").where("copies > 0")
    assert after.groupBy("doc_id").agg(F.count("*").alias("copies")).exceptAll(want).isEmpty()


def test_files_hold_every_copy(stages):
    before, after = stages["token_files"]
    assert after.count() == before.count()
    assert after.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    rows = after.orderBy("start").collect()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_run_gives_the_same(spark, small, stages):
    assert corpus_pipeline.run(spark, small).exceptAll(stages["token_files"][1]).isEmpty()


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_and_empty_rows(spark, small, odd, number):
    name, stage = corpus_pipeline.STAGES[number]
    none = spark.createDataFrame([], SCHEMA)
    assert stage(spark, none, small).count() == 0
    result = stage(spark, odd, small)
    assert result.count() >= 0
    if number < 4:
        assert set(result.columns) == set(odd.columns)
