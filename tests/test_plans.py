"""Plan-shape checks: pruning reaches the scan, no Python in the hot path, bounded shuffles."""

from conftest import SF_SMALL

import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alerts_scan_reads_only_needed_columns(spark):
    p = _plan(E.queries()["alerts"](spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in p
    assert "l_extendedprice" not in p and "c_name" not in p
    assert "PythonUDF" not in p and "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_kpi_summary_is_one_aggregate_over_the_source(spark):
    spark.catalog.clearCache()  # cached fixtures of other tests would show their own plans here
    p = _plan(E.queries()["kpi_summary"](spark, SF_SMALL))
    # fixture: one shuffle for the line summary; KPIs: one single-partition merge
    assert p.count("Exchange hashpartitioning") <= 1
    assert p.count("Exchange SinglePartition") <= 1


def test_split_and_overview_read_their_inputs_once(spark):
    p = _plan(E.queries()["stratified_split"](spark, SF_SMALL))
    assert p.count("FileScan") == 3  # orders, lineitem, customer
    p = _plan(E.queries()["prep_onehot"](spark, SF_SMALL))
    assert p.count("FileScan") == 3


def test_no_python_udf_anywhere(spark):
    for name in ("recommendations", "dq_violations", "predictions_enriched", "rule_triggers_long", "kpi_volume"):
        p = _plan(E.queries()[name](spark, SF_SMALL))
        assert "PythonUDF" not in p and "BatchEvalPython" not in p, name
