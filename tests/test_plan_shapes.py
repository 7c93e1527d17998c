"""The physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from papercorpus.operators import cleaning, collection, overlap, quality, sampling
from papercorpus.plans import catalog
from papercorpus.plans.prepare import prepare
from papercorpus.sources.shared import stored


def plan(df):
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return re.sub(r"#\d+L?", "", text)


@pytest.fixture(scope="module")
def papers(spark, folder):
    """Parquet papers without the step that deals a small file out to all cores."""
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"), F.col("lang").alias("primary_topic"), F.col("doc_id").alias("seq"))


def test_cleaning_makes_each_text_once(papers):
    assert plan(cleaning.clean_papers(papers)).count("translate(") == 2  # title and abstract


def test_split_labels_do_not_move_the_texts(papers):
    shown = plan(sampling.split_rows(papers))
    assert "Exchange hashpartitioning" not in shown and "SinglePartition" not in shown
    assert shown.count("BroadcastHashJoin") == 2


def test_prepared_papers_do_not_move_the_texts(papers):
    shown = plan(prepare(papers))
    assert "Exchange hashpartitioning" not in shown and "SortMergeJoin" not in shown


def test_first_rows_are_merged_before_the_shuffle(papers):
    assert "partial_min_by" in plan(cleaning.keep_first(papers, ["title", "abstract"]))


def test_samples_filter_the_rows_in_place(papers):
    for n, by in ((5, "primary_topic"), (5, None), (1_001, None), (10_000, "primary_topic")):
        shown = plan(sampling.sample_rows(papers, n, 1, "x", F.col("id"), by))
        assert "Exchange hashpartitioning" not in shown and "TakeOrdered" not in shown


def test_metrics_shuffle_sums_only(papers):
    rows = papers.select("id", "primary_topic", F.col("title").alias("prediction"),
                         F.col("title").alias("reference"), "abstract")
    for df in (overlap.text_metrics(rows, ["primary_topic"], ["rouge", "bleu"]),
               quality.row_metrics(rows, ["primary_topic"], 4, 15, None)):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_unused_metrics_stay_out_of_the_plan(papers):
    rows = papers.select(F.col("title").alias("prediction"), F.col("title").alias("reference"))
    assert "ArrowEvalPython" not in plan(overlap.text_metrics(rows, [], ["bleu"]))


def test_scans_read_only_what_is_needed(papers):
    table = stored(papers, "papers")
    shown = plan(sampling.stratum_counts(table, "primary_topic"))
    assert "ReadSchema: struct<primary_topic:string>" in shown
    assert "PushedFilters: [IsNotNull(id), Not(EqualTo(id,))]" in plan(collection.with_id(table))


def test_dates_are_pushed_to_the_scan(spark, folder):
    works = stored(catalog.inputs.works(spark, folder), "works")
    shown = plan(works.filter(collection.works_predicate("2019-03-01", "2020-01-01")))
    assert "GreaterThanOrEqual(publication_date,2019-03-01)" in shown


