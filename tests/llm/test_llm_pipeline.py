"""The corpus pipeline, stage by stage and as a query."""

import corpus_pipeline as C
import pytest
from cases import DOC, rows
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as E
from tiergate.llm import line_dedup, quality_classifier, simhash_dedup, source_mixing
from tiergate.llm.common import stage

OPERATORS = (
    "op1_simhash_dedup", "op2_topk_search", "op3_license_scan", "op4_quality_classifier", "op5_url_filter",
    "op6_host_quality_rules", "op7_line_dedup", "op8_pii", "op9_best_fit_packing", "op10_source_mixing",
)


def test_queries_are_registered():
    q = E.queries()
    assert set(OPERATORS) <= set(q) and "pipeline" in q
    assert {"op2_topk_search", "op6_host_quality_rules", "op7_line_dedup"} <= set(E.oracle_sql())
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "line_dedup", "simhash_dedup", "source_mixing", "best_fit_packing"]


def test_stages_decide(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = {}
    for name, function in C.STAGES:
        out = stage(function(spark, docs, SF_SMALL), "test-stage")
        seen[name] = (docs, out)
        if name != "best_fit_packing":
            assert out.dtypes == docs.dtypes
        docs = out
    before, after = seen["quality_classifier"]
    marks = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    scores = quality_classifier.classify(before, marks)
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.filter("predicted = 1").collect()}
    before, after = seen["line_dedup"]
    report = {r.doc_id: r.kept_md5 for r in line_dedup.line_report(before).collect()}
    assert {r.doc_id: r.m for r in after.select("doc_id", F.md5("text").alias("m")).collect()} == report
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
    before, after = seen["simhash_dedup"]
    groups = {r.component_id for r in simhash_dedup.near_duplicates(before).collect()}
    assert sorted(r.doc_id for r in after.collect()) == sorted(groups)
    before, after = seen["source_mixing"]
    taken = {r.doc_id: r.taken for r in source_mixing.mix_counts(before).collect() if r.taken}
    got = {r[0]: r[1] for r in after.groupBy("doc_id").agg(F.sum(source_mixing.n_words(F.col("text")))).collect()}
    assert got == taken
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_run_agrees_with_itself(spark):
    pieces = lambda: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in C.run(spark, SF_SMALL).collect())
    first = pieces()
    assert first and first == pieces()


@pytest.mark.parametrize("extra", [False, True])
def test_awkward_documents(spark, extra, tmp_path):
    docs = spark.createDataFrame(rows(), DOC)
    docs = docs.selectExpr("*", "1 AS size", "'x' AS tie", "2 AS num") if extra else docs
    spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, function in C.STAGES:
        out = stage(function(spark, docs, str(tmp_path)), "test-stage")
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        docs = out
