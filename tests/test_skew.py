"""Few classes don't make few tasks."""

from kerbside.plans import operator_queries


def test_report_is_not_dealt_by_class(spark):
    """No exchange deals all boxes by their class."""
    df = operator_queries.QUERIES["build_report"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(class" not in plan and "hashpartitioning(cctv_id" not in plan and "hashpartitioning(l_returnflag" not in plan
