from conftest import SF_SMALL, row
from pyspark.sql import functions as F

from opsrisk.operators import views as V
from opsrisk.operators.evaluation import confusion_long


def _preds(spark):
    return spark.createDataFrame(
        [("1", "high", 0.1, 0.2, 0.7, "a"), ("2", "low", 0.8, 0.1, 0.1, "b"), ("3", "medium", 0.2, 0.5, 0.3, "c"),
         ("4", "high", 0.0, 0.1, None, "d"), ("9", "high", 0.1, 0.1, 0.8, "e")],
        "workflow_id string, predicted_risk string, risk_probability_low double, risk_probability_medium double, "
        "risk_probability_high double, risk_factors string",
    )


def _workflows(make_df):
    return make_df([row(workflow_id="1", department="Finance"), row(workflow_id="2", department="IT"),
                    row(workflow_id="3", department="IT", priority="high"), row(workflow_id="4", department=None)])


def test_enrich_left_join(spark, make_df):
    e = V.enrich_predictions(_preds(spark), _workflows(make_df))
    got = {r["workflow_id"]: r["department"] for r in e.collect()}
    assert got == {"1": "Finance", "2": "IT", "3": "IT", "4": None, "9": None}
    assert V.enrich_predictions(_preds(spark), None).columns == _preds(spark).columns


def test_filter_semantics(spark, make_df):
    e = V.enrich_predictions(_preds(spark), _workflows(make_df))
    # default selection excludes rows whose dimension is missing (they match no option)
    assert sorted(r[0] for r in V.filter_predictions(e).select("workflow_id").collect()) == ["1", "2", "3"]
    assert V.filter_predictions(e, risk=[]).count() == 0
    got = V.filter_predictions(e, risk=["high", "medium"], department=["IT"]).select("workflow_id").collect()
    assert [r[0] for r in got] == ["3"]


def test_filter_options_sorted(spark, make_df):
    opts = V.filter_options(V.enrich_predictions(_preds(spark), _workflows(make_df))).collect()
    dept = [r["value"] for r in opts if r["column"] == "department"]
    assert dept == ["Finance", "IT"]


def test_restrict_and_monitor_order(spark, make_df):
    preds = _preds(spark)
    ids = preds.where(F.col("predicted_risk") == "high")
    assert V.restrict_to_ids(preds, ids).count() == 3
    order = [r["workflow_id"] for r in V.risk_monitor(preds).collect()]
    assert order == ["9", "1", "3", "2", "4"]  # high probability desc, null last
    assert [r["workflow_id"] for r in V.risk_monitor(preds, top_k=2).collect()] == ["9", "1"]
    assert V.risk_monitor(preds).columns == [c for c in V.MONITOR_COLUMNS if c in preds.columns]


def test_counts_and_confusion(spark):
    scored = spark.createDataFrame([("low", "low"), ("low", "high"), ("high", "high")], "y string, p string")
    cm = {r["actual"]: (r["low"], r["medium"], r["high"]) for r in V.confusion_matrix_view(confusion_long(scored, "y", "p")).collect()}
    assert cm == {"low": (1, 0, 1), "medium": (0, 0, 0), "high": (0, 0, 1)}


def test_model_comparison_rows(spark):
    md = {"baseline_comparison": {"logistic_regression": {"accuracy": 0.4, "f1_macro": 0.3, "f1_weighted": 0.35},
                                  "dummy": {"accuracy": 0.3, "f1_macro": 0.2, "f1_weighted": 0.25}},
          "test_metrics": {"accuracy": 0.5, "f1_macro": 0.45, "f1_weighted": 0.48}}
    rows = V.model_comparison(spark, md).collect()
    assert [r["model"] for r in rows] == ["logistic_regression", "dummy", "random_forest (primary)"]


def test_alerts_sorted_by_severity_text(spark):
    a = spark.createDataFrame([("1", "warning"), ("2", "critical"), ("3", "info")], "workflow_id string, severity string")
    assert [r["severity"] for r in V.alerts_by_severity(a).collect()] == ["critical", "info", "warning"]
    got = {r["severity"]: r["n"] for r in V.alert_severity_counts(a).collect()}
    assert got == {"critical": 1, "info": 1, "warning": 1}
