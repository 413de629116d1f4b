import pytest
from conftest import row

from opsrisk.operators.quality import issue_values, validate_or_raise, validate_workflow_data


def _checks(result):
    return [(i.check, i.column) for i in result.issues]


def test_valid(make_df):
    r = validate_workflow_data(make_df([row()]))
    assert r.is_valid and r.issues == [] and r.summary() == "No validation issues found."


def test_missing_column_short_circuits(make_df):
    r = validate_workflow_data(make_df([row(sla_hours=-5.0)], drop=("sla_hours",)))
    assert _checks(r) == [("required_columns", None)]
    assert r.issues[0].message == "Missing required columns: ['sla_hours']"


def test_duplicate_ids(make_df):
    r = validate_workflow_data(make_df([row(), row()]))
    assert r.errors[0].check == "duplicate_workflow_id"
    assert r.errors[0].message == "Duplicate workflow_id values found: 1 id(s)"


@pytest.mark.parametrize("col", ["elapsed_hours", "manual_steps", "error_count", "rework_count", "pending_items",
                                 "avg_handling_time_minutes"])
def test_negative(make_df, col):
    r = validate_workflow_data(make_df([row(**{col: -1 if col not in ("elapsed_hours", "avg_handling_time_minutes") else -1.0})]))
    assert ("negative_value", col) in _checks(r)
    assert f"Column '{col}' has 1 negative value(s)" in r.summary()


def test_negative_sla_is_two_errors(make_df):
    r = validate_workflow_data(make_df([row(sla_hours=-10.0)]))
    assert {"negative_value", "impossible_sla"} <= {i.check for i in r.errors}


def test_unit_interval_and_scale_hint(make_df):
    r = validate_workflow_data(make_df([row(completion_rate=1.5), row(workflow_id="2", automation_score=-0.1)]))
    msgs = [i.message for i in r.errors if i.check == "unit_interval_bounds"]
    assert msgs[0].startswith("Column 'completion_rate' has 1 value(s) outside [0, 1] (1 value(s) exceed 1")
    assert msgs[1] == "Column 'automation_score' has 1 value(s) outside [0, 1]"


def test_timestamps_nulls_status(make_df):
    import datetime as dt

    r = validate_workflow_data(make_df([
        row(workflow_id="1", updated_at=dt.datetime(2025, 12, 31)),
        row(workflow_id=None),
        row(workflow_id="3", status="mystery_status"),
        row(workflow_id="4", sla_hours=0.0),
    ]))
    checks = _checks(r)
    assert ("inconsistent_timestamps", None) in checks
    assert ("null_critical_field", "workflow_id") in checks
    assert ("impossible_sla", "sla_hours") in checks
    assert r.warnings[0].message == "Unrecognized status value(s) in 1 row(s)"
    assert [x[0] for x in r.workflow_ids("inconsistent_timestamps").collect()] == ["1"]
    assert [x[0] for x in r.workflow_ids("null_critical_field", "workflow_id").collect()] == ["nan"]


def test_null_status_is_error_and_warning(make_df):
    r = validate_workflow_data(make_df([row(status=None)]))
    assert ("null_critical_field", "status") in _checks(r)
    assert r.warnings[0].message == "Unrecognized status value(s) in 1 row(s)"


def test_gate_raises_with_summary(make_df):
    with pytest.raises(ValueError, match=r"ERROR \[impossible_sla\]"):
        validate_or_raise(make_df([row(sla_hours=0.0)]))
    df = make_df([row(status="mystery_status")])
    assert validate_or_raise(df) is df  # warnings do not block


def test_values_are_complete_at_any_size(make_df):
    rows = [row(workflow_id=f"W{i % 1500}", status=f"s{i % 1200}") for i in range(3000)]
    df = make_df(rows)
    r = validate_workflow_data(df)
    assert r.errors[0].message == "Duplicate workflow_id values found: 1500 id(s)"
    assert r.warnings[0].message == "Unrecognized status value(s) in 3000 row(s)"
    assert r.workflow_ids("duplicate_workflow_id").count() == 1500
    got = {(x["check"], x["value"]): x["n"] for x in issue_values(df).collect()}
    assert got == {("duplicate_workflow_id", f"W{i}"): 2 for i in range(1500)} | {("unknown_status", f"s{i}"): 2 + (i < 600) for i in range(1200)}
