"""A hot key holding a third of all rows: results stay exact (checked against brute force on
the collected fixture) and the plans fold the hot key map-side before any shuffle."""

import pandas as pd
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from opsrisk.operators import quality as Q
from opsrisk.operators.alerts import alerts_from_scored, latest_prediction
from opsrisk.operators.rules import with_triggers
from opsrisk.sources import tables


@pytest.fixture(scope="module")
def hot(spark):
    w = tables.workflows(spark, SF_SMALL)
    k = tables.workflow_key(w)
    return w.withColumn("pos", k).withColumn(
        "workflow_id", F.when(k % 3 == 0, F.lit("HOT")).otherwise(F.col("workflow_id"))
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_duplicates_exact_and_partial(hot):
    pdf = hot.select("workflow_id").toPandas()
    want = pdf.value_counts("workflow_id")
    want = {k: int(v) for k, v in want.items() if v > 1}
    got = {r["workflow_id"]: r["n"] for r in Q.duplicate_ids(hot).collect()}
    assert got == want and got["HOT"] > len(pdf) // 4
    assert "partial_count" in _plan(Q.duplicate_ids(hot))


def test_alert_dedup_keeps_first_of_hot_id(hot):
    scored = with_triggers(hot)
    alerts = alerts_from_scored(scored, "t", dedup=True, order_col="pos")
    got = alerts.where(F.col("workflow_id") == "HOT").select("type", "message").toPandas()
    # brute force: first row (by pos) per rule type among the hot rows
    rows = scored.where(F.col("workflow_id") == "HOT").select("pos", F.explode("triggers").alias("t")).select(
        "pos", "t.rule_type", "t.message").toPandas()
    first = rows.sort_values("pos").groupby("rule_type", sort=False).first()
    assert dict(zip(got["type"], got["message"])) == dict(zip(first.index, first["message"]))
    assert "partial_min_by" in _plan(alerts)


def test_latest_prediction_on_hot_id(spark, hot):
    preds = hot.select("workflow_id", "pos", F.when(F.col("pos") % 2 == 0, "high").otherwise("low").alias("predicted_risk"))
    got = {r[0]: r[1] for r in latest_prediction(preds, "pos").collect()}
    pdf = preds.toPandas().sort_values("pos").groupby("workflow_id").last()
    assert got == pdf["predicted_risk"].to_dict()
