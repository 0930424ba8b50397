"""Every registered query runs and, where there is SQL, gives the same rows."""

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry
from chatterlake.plans import oracle
from chatterlake.plans.queries import registered
from check import TABLES, normalise

QUERIES, ORACLE = registered(), oracle.statements()

# Queries that apply the sentence rule, whose last part is an Arrow function.
WITH_ARROW_FUNCTION = {
    "spam_repeat_sentences", "spam_reasons", "clean_comments", "clean_column", "drop_missing", "removal_stats", "filter_english",
    "clean_topics",
}

# Queries that read CSV files whose records span lines, cut by `sources.records`, and the model hook.
WITH_MAP_FUNCTION = {"csv_roundtrip", "csv_quotes", "csv_edges", "json_to_csv", "job_analyze", "job_filter", "score_hook"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def test_names():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = QUERIES[name](spark, DATA)
    plan = result._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    assert ("ArrowEvalPython" in plan) == (name in WITH_ARROW_FUNCTION)
    assert ("MapInArrow" in plan) == (name in WITH_MAP_FUNCTION)
    got = result.toPandas()
    if name in ORACLE:
        want = con.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normalise(got) == normalise(want)
    else:
        assert len(got)
