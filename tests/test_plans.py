"""Physical plans of the operators that matter at scale."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from chatterlake.operators import cleaning, labels, language, stats, topics, validate


@pytest.fixture
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_language_filter_reaches_the_scan(documents):
    plan = plan_of(language.keep_english(documents.select("doc_id", "lang"), "lang"))
    assert "EqualTo(lang,en)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_topics_read_two_columns_and_cut_per_task(documents):
    plan = plan_of(topics.topics_by_language(documents, 5, 10, "text", "lang"))
    assert "ReadSchema: struct<text:string,lang:string>" in plan and "ReadSchema: struct<lang:string>" in plan
    assert plan.count("WindowGroupLimit") == 2 and "SortMergeJoin" not in plan
    assert "partial_count" in plan


def test_labels_and_cleaning_need_no_shuffle(documents):
    plan = plan_of(labels.with_label(cleaning.keep_clean(documents, "text", ["spam"]), "tourism", "text"))
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_totals_need_no_cross_join(documents):
    plan = plan_of(stats.language_distribution(documents, "lang"))
    assert "Subquery" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "ReadSchema: struct<lang:string>" in plan


def test_comparison_shuffles_once(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    plan = plan_of(validate.table_differences(part, part.withColumn("p_size", F.col("p_size") + 0)))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_small_sample_is_a_top_n(documents):
    plan = plan_of(stats.sample_exact(documents.select("doc_id"), 10, "doc_id"))
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_profile_is_one_aggregation(documents):
    plan = plan_of(validate.profile_table(documents))
    assert plan.count("Exchange") == 1 and "Expand" not in plan
