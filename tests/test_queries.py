"""Every registered query of the engine against its SQL, over whole tables."""

import pytest

from quern.plans import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    assert_same(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["scan_pushdown"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(l_quantity,45.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_structured_condition_runs_before_the_model(spark):
    plan = catalog.QUERIES["hybrid_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and plan.index("ArrowEvalPython") < plan.index("EqualTo(lang,en)")


@pytest.mark.parametrize("name", ["similarity_filter", "hybrid_filter", "vector_search_clause", "routed_search"])
def test_the_model_runs_once_a_row(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
