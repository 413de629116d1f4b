import pytest
from conftest import row
from pyspark.sql import functions as F

from opsrisk.operators.alerts import generate_alerts, generate_recommendations
from opsrisk.schema import ALERT_COLUMNS, RECOMMENDATION_COLUMNS

STAMP = "2026-01-01T00:00:00+00:00"


def test_alert_fields(make_df):
    a = generate_alerts(make_df([row(pending_items=200)]), generated_at=STAMP).collect()
    assert len(a) == 1
    r = a[0].asDict()
    assert tuple(r) == ALERT_COLUMNS
    assert r["alert_id"] == "ALT-WF-1-backlog_pressure"
    assert r["severity"] == "warning" and r["type"] == "backlog_pressure" and r["generated_at"] == STAMP


def test_escalation_from_prediction_column(make_df):
    df = make_df([row()]).withColumn("predicted_risk", F.lit("high"))
    a = generate_alerts(df, "predicted_risk", generated_at=STAMP).collect()
    assert [x["type"] for x in a] == ["high_risk_escalation"]
    assert a[0]["severity"] == "critical"


def test_prediction_lookup_last_wins_and_missing_id(spark, make_df):
    preds = spark.createDataFrame([("WF-1", "high", 0), ("WF-1", "low", 1), ("WF-9", "high", 0)],
                                  "workflow_id string, predicted_risk string, pos int")
    a = generate_alerts(make_df([row()]), preds, generated_at=STAMP, order_col="pos").collect()
    assert a == []


def test_dedup_first_row_wins(make_df):
    df = make_df([row(pending_items=200), row(pending_items=300, elapsed_hours=120.0)]).withColumn(
        "pos", F.monotonically_increasing_id())
    a = generate_alerts(df, generated_at=STAMP, order_col="pos").collect()
    got = {x["type"]: x["message"] for x in a}
    assert len(a) == 2
    assert got["backlog_pressure"] == "Pending items 200 at or above backlog threshold 100"
    assert "sla_breach" in got


def test_multiple_alerts_per_row(make_df):
    a = generate_alerts(make_df([row(elapsed_hours=100.0, error_count=10)]), generated_at=STAMP, dedup=False)
    assert sorted(x["type"] for x in a.collect()) == ["high_error", "sla_breach"]


def test_recommendations(make_df):
    df = make_df([row(workflow_id="A", elapsed_hours=100.0), row(workflow_id="B"), row(workflow_id="C")])
    df = df.withColumn("predicted_risk", F.when(F.col("workflow_id") == "B", "medium").otherwise("low"))
    recs = generate_recommendations(df, "predicted_risk").collect()
    assert tuple(recs[0].asDict()) == RECOMMENDATION_COLUMNS
    by = {r["workflow_id"]: r for r in recs}
    assert by["A"]["category"] == "escalate"
    assert by["A"]["signal"].startswith("SLA breached")
    assert by["B"]["category"] == "monitor"
    assert by["B"]["message"] == "Continue monitoring; no immediate action required"
    assert by["C"]["category"] == "no_action"
    assert len(recs) == 3


def test_recommendation_categories_cover_all_rules(make_df):
    df = make_df([row(elapsed_hours=90.0, error_count=9, rework_count=10, manual_steps=9, automated_steps=1,
                      pending_items=500)]).withColumn("predicted_risk", F.lit("high"))
    cats = [r["category"] for r in generate_recommendations(df, "predicted_risk").collect()]
    assert cats == ["review_sla", "investigate_errors", "reduce_rework", "assess_automation", "rebalance_workload",
                    "escalate"]


def test_lookup_without_order_column(spark, make_df):
    one = spark.createDataFrame([("WF-1", "high")], "workflow_id string, predicted_risk string")
    assert [x["type"] for x in generate_alerts(make_df([row()]), one, generated_at=STAMP).collect()] == ["high_risk_escalation"]
    with pytest.raises(Exception, match="several predictions and no order column"):
        generate_alerts(make_df([row()]), one.unionByName(one), generated_at=STAMP).collect()
