"""What the physical plans must look like at scale."""

import re

import __spark_entry__ as spec
from conformance.adapters import functions, scored
from defectlens.operators import answers as A, features as E, ranking as R
from defectlens.plans.scoring import score_rows

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_limited_before_the_shuffle(spark):
    rows = functions(spark, SF)
    for df in (E.keep_first(rows, ["file_id"], ["start_line"]), R.label_heads(rows.selectExpr("*", "'High' AS risk_label", "1 AS rank"))):
        assert re.search(r"WindowGroupLimit .*Partial", plan_of(df))


def test_one_shuffle_ranks_explains_and_digests_a_file(spark):
    plan = plan_of(A.file_digest(score_rows(functions(spark, SF))))
    assert plan.count("Exchange hashpartitioning") == 1


def test_bands_read_only_what_they_need(spark):
    plan = plan_of(R.risk_bands(scored(spark, SF)).select("file", "rank"))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema == "o_orderkey:bigint,o_custkey:bigint,o_totalprice:double"


def test_filters_reach_the_scan(spark):
    plan = plan_of(spec.queries()["f1_file_history"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts)]" in plan
    assert plan.count("lambdafunction") == plan.count("filter(array(named_struct")  # the file list is made once


def test_history_takes_two_shuffles(spark):
    plan = plan_of(spec.queries()["f1_file_history"](spark, SF))
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("partial_sum(added") == 2  # both are summed up before they shuffle
