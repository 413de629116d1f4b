from conftest import row
from pyspark.sql import functions as F

from opsrisk.functions.text import percent_text
from opsrisk.operators.features import engineer_features
from opsrisk.operators.rules import risk_factors, rule_triggers, with_triggers
from opsrisk.schema import NO_TRIGGERS_MESSAGE, RuleConfig


def _types(make_df, cfg=RuleConfig(), **kw):
    t = with_triggers(make_df([row(**kw)]), cfg).first()["triggers"]
    return [x["rule_type"] for x in t], t


def test_safe_row_fires_nothing(make_df):
    assert _types(make_df)[0] == []


def test_sla_breach_and_approaching_are_exclusive(make_df):
    assert _types(make_df, elapsed_hours=100.0)[0] == ["sla_breach"]
    assert _types(make_df, elapsed_hours=120.0)[0] == ["sla_breach"]
    assert _types(make_df, elapsed_hours=80.0)[0] == ["approaching_sla"]
    assert _types(make_df, elapsed_hours=79.0)[0] == []


def test_messages_and_severities(make_df):
    _, t = _types(make_df, elapsed_hours=120.0)
    assert t[0]["severity"] == "critical"
    assert t[0]["message"] == "SLA breached: utilization at 120% of the allotted window"
    _, t = _types(make_df, elapsed_hours=85.0)
    assert t[0]["message"] == "SLA utilization 85% at or above the 80% warning threshold"


def test_thresholds_inclusive(make_df):
    assert _types(make_df, error_count=5)[0] == ["high_error"]
    assert _types(make_df, error_count=4)[0] == []
    assert _types(make_df, transaction_volume=100, rework_count=10)[0] == ["high_rework"]
    assert _types(make_df, transaction_volume=100, rework_count=9)[0] == []
    assert _types(make_df, manual_steps=7, automated_steps=3)[0] == ["manual_automation_opportunity"]
    assert _types(make_df, automation_score=0.30)[0] == ["manual_automation_opportunity"]
    assert _types(make_df, pending_items=100)[0] == ["backlog_pressure"]
    assert _types(make_df, pending_items=99)[0] == []


def test_rule_order_and_texts(make_df):
    types, t = _types(make_df, elapsed_hours=100.0, error_count=10, pending_items=200)
    assert types == ["sla_breach", "high_error", "backlog_pressure"]
    assert t[1]["message"] == "Error count 10 at or above threshold 5"
    assert t[2]["message"] == "Pending items 200 at or above backlog threshold 100"


def test_missing_values_never_fire(make_df):
    assert _types(make_df, automation_score=None, error_count=None, pending_items=None)[0] == []
    assert _types(make_df, automation_score=float("nan"))[0] == []


def test_automation_message_prints_nan(make_df):
    _, t = _types(make_df, manual_steps=8, automated_steps=2, automation_score=None)
    assert t[0]["message"] == "Manual step ratio 80% / automation score nan% indicate an automation opportunity"


def test_custom_config(make_df):
    cfg = RuleConfig(high_error_threshold=1, backlog_threshold=5)
    types, t = _types(make_df, cfg)
    assert types == ["high_error", "backlog_pressure"]
    assert t[0]["message"] == "Error count 1 at or above threshold 1"


def test_percent_rounds_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.285,), (1.005,), (None,), (float("inf"),), (-0.001,)], "x double")
    got = [r[0] for r in df.select(percent_text(F.col("x"))).collect()]
    want = [format(0.125, ".0%"), format(0.135, ".0%"), format(0.285, ".0%"), format(1.005, ".0%"), "nan%", "inf%",
            format(-0.001, ".0%")]
    assert got == want


def test_risk_factors_never_empty(make_df):
    out = engineer_features(make_df([row(), row(workflow_id="WF-2", pending_items=150)]))
    got = {r[0]: r[1] for r in out.select("workflow_id", risk_factors()).collect()}
    assert got["WF-1"] == [NO_TRIGGERS_MESSAGE]
    assert got["WF-2"] == ["Pending items 150 at or above backlog threshold 100"]


def test_huge_percent_never_null(spark):
    df = spark.createDataFrame([(1.1992571331987051e49,), (1e300,)], "x double")
    got = [r[0] for r in df.select(percent_text(F.col("x"))).collect()]
    assert got[0] == "1199257133198705000000000000000000000000000000000000%"
    assert got[1].startswith("1000000000000") and got[1].endswith("%")


def test_int_text_exact_for_large_longs(spark):
    from opsrisk.functions.text import int_text

    df = spark.createDataFrame([(2**60 + 1, 5.9), (-7, -5.9), (None, 1e30)], "n long, x double")
    got = [(r[0], r[1]) for r in df.select(int_text(F.col("n")), int_text(F.col("x"))).collect()]
    assert got[0] == (str(2**60 + 1), "5") and got[1] == ("-7", "-5")
    assert got[2][0] is None and got[2][1] == "1000000000000000000000000000000"
