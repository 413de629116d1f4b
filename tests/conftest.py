from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from opsrisk.schema import LABELED_WORKFLOW_SCHEMA, REQUIRED_COLUMNS  # noqa: E402
from opsrisk.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"

# A workflow on which no rule fires.
SAFE_ROW = {
    "workflow_id": "WF-1",
    "workflow_name": "Invoice Processing",
    "department": "Finance",
    "status": "open",
    "priority": "medium",
    "sla_hours": 100.0,
    "elapsed_hours": 40.0,
    "manual_steps": 2,
    "automated_steps": 8,
    "automation_score": 0.8,
    "error_count": 1,
    "rework_count": 1,
    "transaction_volume": 50,
    "avg_handling_time_minutes": 25.0,
    "pending_items": 5,
    "completion_rate": 0.9,
    "created_at": dt.datetime(2026, 1, 1),
    "updated_at": dt.datetime(2026, 1, 2),
    "risk_label": "low",
}


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 8, app="opsrisk-tests")
    yield s
    s.stop()


def row(**overrides):
    r = dict(SAFE_ROW)
    r.update(overrides)
    return r


@pytest.fixture
def make_df(spark):
    def _make(rows, drop=(), schema=LABELED_WORKFLOW_SCHEMA):
        cols = [f.name for f in schema.fields]
        data = [tuple(r.get(c) for c in cols) for r in rows]
        df = spark.createDataFrame(data, schema)
        return df.drop(*drop) if drop else df

    return _make


__all__ = ["row", "SAFE_ROW", "REQUIRED_COLUMNS", "SF_SMALL"]
