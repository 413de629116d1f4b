import math

from conftest import row
from pyspark.sql import functions as F

from opsrisk.operators.features import engineer_features, prepare_feature_frame
from opsrisk.schema import ENGINEERED_COLUMNS, FEATURE_COLUMNS


def _eng(make_df, **kw):
    return engineer_features(make_df([row(**kw)])).first()


def test_ratios_exact(make_df):
    r = _eng(make_df, sla_hours=100.0, elapsed_hours=80.0, manual_steps=3, automated_steps=7, error_count=2,
             rework_count=1, transaction_volume=50, pending_items=10)
    assert r["sla_utilization"] == 0.8
    assert r["manual_step_ratio"] == 0.3
    assert r["error_rate"] == 0.04
    assert r["rework_rate"] == 0.02
    assert r["backlog_pressure"] == 0.2


def test_zero_or_missing_denominators_give_zero(make_df):
    assert _eng(make_df, sla_hours=0.0)["sla_utilization"] == 0.0
    assert _eng(make_df, transaction_volume=0)["error_rate"] == 0.0
    assert _eng(make_df, manual_steps=0, automated_steps=0)["manual_step_ratio"] == 0.0
    assert _eng(make_df, sla_hours=None)["sla_utilization"] == 0.0
    assert _eng(make_df, elapsed_hours=None)["sla_utilization"] == 0.0


def test_nan_and_inf_give_zero(make_df):
    assert _eng(make_df, elapsed_hours=float("nan"))["sla_utilization"] == 0.0
    assert _eng(make_df, elapsed_hours=float("inf"))["sla_utilization"] == 0.0
    assert _eng(make_df, sla_hours=float("inf"))["sla_utilization"] == 0.0


def test_engineer_keeps_input_and_adds_ratios(make_df):
    df = make_df([row()])
    out = engineer_features(df)
    assert out.columns[: len(df.columns)] == df.columns
    assert set(ENGINEERED_COLUMNS) <= set(out.columns)
    assert out.collect() == engineer_features(df).collect()


def test_feature_frame_order_and_no_leakage(make_df):
    out = prepare_feature_frame(make_df([row()]))
    assert tuple(out.columns) == FEATURE_COLUMNS
    assert "workflow_id" not in out.columns and "risk_label" not in out.columns


def test_no_python_udf_in_plan(make_df):
    plan = engineer_features(make_df([row()]))._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
