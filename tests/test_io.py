import os
import tempfile

import pytest
from conftest import row

from opsrisk.operators.alerts import generate_alerts
from opsrisk.sources import files as IO

CSV = """workflow_id,workflow_name,department,status,priority,sla_hours,elapsed_hours,manual_steps,automated_steps,automation_score,error_count,rework_count,transaction_volume,avg_handling_time_minutes,pending_items,completion_rate,created_at,updated_at,risk_label
WF-1000,Purchase Order Approval,Operations,in_progress,medium,38.58,39.83,5,2,0.219,8,7,69,106.8,124,0.601,2026-06-18,2026-06-19 15:49:34.251852453,high
WF-1001,Vendor Approval,Finance,open,low,NA,abc,3,,nan,1,0,10,5.0,null,0.5,not-a-date,2026-06-19,low
"""


def _tmp(text, name="w.csv"):
    d = tempfile.mkdtemp(prefix="opsrisk-test-", dir="/tmp")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_types_and_lenient_values(spark):
    df = IO.load_workflow_data(spark, _tmp(CSV))
    types = dict(df.dtypes)
    assert types["sla_hours"] == "double" and types["manual_steps"] == "double"
    assert types["created_at"] == "timestamp_ntz" and types["risk_label"] == "string"
    r = {x["workflow_id"]: x for x in df.collect()}
    assert r["WF-1000"]["updated_at"].microsecond == 251852  # ns truncated to µs
    bad = r["WF-1001"]
    assert bad["sla_hours"] is None and bad["elapsed_hours"] is None  # NA and garbage
    assert bad["automated_steps"] is None and bad["automation_score"] is None and bad["pending_items"] is None
    assert bad["created_at"] is None
    assert df.count() == 2  # never drops rows


def test_missing_file(spark):
    with pytest.raises(FileNotFoundError):
        IO.load_workflow_data(spark, "/tmp/does-not-exist-opsrisk.csv")
    with pytest.raises(FileNotFoundError):
        IO.load_model(spark, "/tmp/does-not-exist-opsrisk-model")


def test_empty_alerts_keep_header(spark, make_df):
    d = tempfile.mkdtemp(prefix="opsrisk-test-", dir="/tmp")
    alerts = generate_alerts(make_df([row()]), generated_at="x")
    assert alerts.count() == 0
    IO.save_alerts(alerts, f"{d}/alerts")
    back = spark.read.option("header", True).csv(f"{d}/alerts")
    assert back.columns == IO.ALERTS_SCHEMA.fieldNames()


def test_json_roundtrip_and_reload(spark, make_df):
    d = tempfile.mkdtemp(prefix="opsrisk-test-", dir="/tmp")
    paths = {"predictions": f"{d}/p", "alerts": f"{d}/a", "recommendations": f"{d}/r", "kpi_summary": f"{d}/k.json"}
    assert IO.load_outputs(spark, paths) is None
    IO.save_json(spark, {"a": [1, 2], "b": {"c": "x"}}, paths["kpi_summary"])
    assert IO.load_json(spark, paths["kpi_summary"]) == {"a": [1, 2], "b": {"c": "x"}}
    with open(paths["kpi_summary"]) as f:
        assert f.read().startswith("{\n  \"a\"")


def test_predictions_flat_missing_class_is_null(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("WF-1", "high", ["a", "b"])], "workflow_id string, predicted_risk string, f array<string>")
    df = df.select("workflow_id", "predicted_risk",
                   F.create_map(F.lit("high"), F.lit(0.7), F.lit("low"), F.lit(0.3)).alias("risk_probability"),
                   F.col("f").alias("risk_factors"))
    r = IO.predictions_flat(df).first()
    assert r["risk_probability_medium"] is None and r["risk_probability_high"] == 0.7
    assert r["risk_factors"] == "a; b"


def test_unparsed_text_is_kept(spark):
    df = IO.load_workflow_data(spark, _tmp(CSV))
    r = {x["workflow_id"]: x for x in df.collect()}
    assert r["WF-1000"][IO.UNPARSED] is None
    assert r["WF-1001"][IO.UNPARSED] == {"elapsed_hours": "abc"}  # NA / nan / null tokens are missing, not text


def test_garbage_numeric_passes_null_check_like_reference(spark):
    from opsrisk.operators.quality import validate_workflow_data

    df = IO.load_workflow_data(spark, _tmp(CSV))
    checks = {(i.check, i.column): i.n for i in validate_workflow_data(df).issues}
    # 'abc' in elapsed_hours is text, not missing; 'NA' in sla_hours is missing
    assert ("null_critical_field", "elapsed_hours") not in checks
    assert checks[("null_critical_field", "sla_hours")] == 1
    assert checks[("null_critical_field", "created_at")] == 1  # unparsable date is missing (coerced at load)


def test_csv_quotes_line_ends_and_fractions(spark):
    from opsrisk.operators.alerts import generate_alerts
    from opsrisk.operators.quality import validate_workflow_data

    head = CSV.strip().split("\n")[0]
    names = head.split(",")
    base = dict(zip(names, CSV.strip().split("\n")[1].split(",")))

    def line(**kw):
        return ",".join({**base, **kw}[c] for c in names)

    text = "\n".join([head, line(workflow_id="A", workflow_name='"say ""hi"", now"'), line(workflow_id="B", workflow_name='"two\nlines, one name"'),
                      line(workflow_id="C", manual_steps="-1.5", error_count="7.5"), line(workflow_id="D") + ",extra"])
    rows = {r["workflow_id"]: r for r in IO.load_workflow_data(spark, _tmp(text)).collect()}
    assert set(rows) == {"A", "B", "C", "D"}
    assert rows["A"]["workflow_name"] == 'say "hi", now' and rows["B"]["workflow_name"] == "two\nlines, one name"
    assert rows["C"]["manual_steps"] == -1.5 and rows["C"]["error_count"] == 7.5
    assert rows["D"][IO.UNPARSED]["_row_text"].endswith(",extra") and rows["A"][IO.UNPARSED] is None
    df = IO.load_workflow_data(spark, _tmp(text)).where("workflow_id = 'C'")
    assert ("negative_value", "manual_steps") in {(i.check, i.column) for i in validate_workflow_data(df).issues}
    assert "high_error" in {r["type"] for r in generate_alerts(df, generated_at="t").collect()}


def test_unfinished_outputs_are_not_loaded(spark):
    import os
    import tempfile

    d = tempfile.mkdtemp(prefix="opsrisk-out-", dir="/tmp")
    for k in ("p", "a", "r"):
        os.makedirs(f"{d}/{k}")
    IO.save_json(spark, {}, f"{d}/k.json")
    assert IO.load_outputs(spark, {"predictions": f"{d}/p", "alerts": f"{d}/a", "recommendations": f"{d}/r", "kpi_summary": f"{d}/k.json"}) is None
