import pytest

import __spark_entry__ as spec
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", list(spec.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = spec.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    result, rows = compare(df, db, name)
    assert result == "ok" and rows > 0, result


def test_entry(spark):
    assert spec.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(spec.oracle_sql()) <= set(spec.queries())
