"""Registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, duck
from confwarden.llm.oracles import ORACLES
from confwarden.llm.queries import QUERIES
from confwarden.session import land, work_folder

SF = "/root/testdata/sf0.001"


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    _, _, problems = compare(spark, duck(SF), name, SF)
    assert not problems


@pytest.mark.parametrize("name", ["op2_quality_divergence", "op6_license_scan", "op10_language_id"])
def test_one_row_per_document(spark, name):
    got = queries()[name](spark, SF)
    assert got.select("doc_id").distinct().count() == got.count() == 200


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = land(stage(spark, before, SF), work_folder(spark, name))
        assert after.columns == columns
        assert after.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    run = corpus_pipeline.run(spark, SF)
    assert run.count() == before.count() and run.columns == last.columns
    assert run.exceptAll(last).isEmpty()


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None,) * 5, (9001, "", None, None, 0), (9001, "", None, None, 0)], docs.schema)
    for rows in (docs.limit(0), odd, docs.union(odd)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SF).count() <= rows.count()
