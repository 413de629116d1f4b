"""Workflow table contract, column groups, rule thresholds and fixed texts.

Everything in the "fixed values" blocks must stay exactly as written: the
column orders define feature-vector layout and issue order, and the texts are
part of the output contract (alerts, recommendations, risk factors).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# fixed values: identifiers, labels and column groups
# ---------------------------------------------------------------------------
WORKFLOW_ID = "workflow_id"
TARGET = "risk_label"
RISK_LABELS = ("low", "medium", "high")
RANDOM_SEED = 42
DEFAULT_TEST_SIZE = 0.2

REQUIRED_COLUMNS = (
    "workflow_id",
    "workflow_name",
    "department",
    "status",
    "priority",
    "sla_hours",
    "elapsed_hours",
    "manual_steps",
    "automated_steps",
    "automation_score",
    "error_count",
    "rework_count",
    "transaction_volume",
    "avg_handling_time_minutes",
    "pending_items",
    "completion_rate",
    "created_at",
    "updated_at",
)
CRITICAL_COLUMNS = ("workflow_id", "sla_hours", "elapsed_hours", "status", "created_at", "updated_at")
DATETIME_COLUMNS = ("created_at", "updated_at")
NON_NEGATIVE_COLUMNS = (
    "sla_hours",
    "elapsed_hours",
    "manual_steps",
    "automated_steps",
    "error_count",
    "rework_count",
    "transaction_volume",
    "avg_handling_time_minutes",
    "pending_items",
)
UNIT_INTERVAL_COLUMNS = ("completion_rate", "automation_score")
VALID_STATUSES = ("open", "in_progress", "on_hold", "completed", "cancelled")
NUMERIC_FEATURES = (
    "sla_hours",
    "elapsed_hours",
    "manual_steps",
    "automated_steps",
    "automation_score",
    "error_count",
    "rework_count",
    "transaction_volume",
    "avg_handling_time_minutes",
    "pending_items",
    "completion_rate",
    "sla_utilization",
    "manual_step_ratio",
    "error_rate",
    "rework_rate",
    "backlog_pressure",
)
CATEGORICAL_FEATURES = ("department", "status", "priority")
LEAKAGE_COLUMNS = ("risk_label", "workflow_id", "workflow_name", "created_at", "updated_at")
FEATURE_COLUMNS = NUMERIC_FEATURES + CATEGORICAL_FEATURES
ENGINEERED_COLUMNS = ("sla_utilization", "manual_step_ratio", "error_rate", "rework_rate", "backlog_pressure")

# SLA window fully consumed at or above this utilisation (not configurable).
SLA_BREACH_UTILIZATION = 1.0

# ---------------------------------------------------------------------------
# Physical types of the contract. Integer-like columns are LongType, the rest
# DoubleType; timestamps are NTZ (the inputs carry no zone).
# ---------------------------------------------------------------------------
LONG_COLUMNS = (
    "manual_steps",
    "automated_steps",
    "error_count",
    "rework_count",
    "transaction_volume",
    "pending_items",
)
DOUBLE_COLUMNS = (
    "sla_hours",
    "elapsed_hours",
    "automation_score",
    "avg_handling_time_minutes",
    "completion_rate",
)


def spark_type(column: str) -> T.DataType:
    if column in LONG_COLUMNS:
        return T.LongType()
    if column in DOUBLE_COLUMNS:
        return T.DoubleType()
    if column in DATETIME_COLUMNS:
        return T.TimestampNTZType()
    return T.StringType()


WORKFLOW_SCHEMA = T.StructType([T.StructField(c, spark_type(c), True) for c in REQUIRED_COLUMNS])
LABELED_WORKFLOW_SCHEMA = T.StructType(WORKFLOW_SCHEMA.fields + [T.StructField(TARGET, T.StringType(), True)])


@dataclass(frozen=True)
class RuleConfig:
    """Rule thresholds; every rule, KPI and alert takes one."""

    # fixed values: default thresholds
    sla_warning_threshold: float = 0.80
    high_error_threshold: int = 5
    high_rework_rate: float = 0.10
    high_manual_ratio: float = 0.70
    low_automation_threshold: float = 0.30
    backlog_threshold: int = 100


DEFAULT_RULE_CONFIG = RuleConfig()

# ---------------------------------------------------------------------------
# fixed values: rule types, severities, texts, recommendation categories
# ---------------------------------------------------------------------------
SLA_BREACH = "sla_breach"
APPROACHING_SLA = "approaching_sla"
HIGH_ERROR = "high_error"
HIGH_REWORK = "high_rework"
MANUAL_AUTOMATION_OPPORTUNITY = "manual_automation_opportunity"
BACKLOG_PRESSURE = "backlog_pressure"
HIGH_RISK_ESCALATION = "high_risk_escalation"

RECOMMENDED_ACTIONS = {
    SLA_BREACH: "Escalate to the process owner and expedite remaining steps immediately",
    APPROACHING_SLA: "Monitor closely and prioritize remaining steps before the SLA is breached",
    HIGH_ERROR: "Investigate the root cause of the elevated error count",
    HIGH_REWORK: "Review rework triggers and quality checkpoints",
    MANUAL_AUTOMATION_OPPORTUNITY: "Assess this workflow for automation to reduce manual effort",
    BACKLOG_PRESSURE: "Rebalance workload to reduce the pending item backlog",
    HIGH_RISK_ESCALATION: "Escalate to an operations manager for review",
}

NO_TRIGGERS_MESSAGE = "No individual risk thresholds exceeded"
ESCALATION_MESSAGE = "Model predicts high risk for this workflow"

CATEGORY_BY_RULE = {
    SLA_BREACH: "escalate",
    HIGH_RISK_ESCALATION: "escalate",
    APPROACHING_SLA: "review_sla",
    HIGH_ERROR: "investigate_errors",
    HIGH_REWORK: "reduce_rework",
    MANUAL_AUTOMATION_OPPORTUNITY: "assess_automation",
    BACKLOG_PRESSURE: "rebalance_workload",
}
MONITOR = "monitor"
NO_ACTION = "no_action"
MONITOR_ACTION = "Continue monitoring; no immediate action required"
MONITOR_SIGNAL = "No rule thresholds triggered, but the model predicts medium risk"
NO_ACTION_ACTION = "No action needed at this time"
NO_ACTION_SIGNAL = "No rule thresholds triggered and no elevated predicted risk"

# Output column orders of the file sinks.
ALERT_COLUMNS = ("alert_id", "workflow_id", "severity", "type", "message", "recommended_action", "generated_at")
RECOMMENDATION_COLUMNS = ("workflow_id", "category", "message", "signal")
PREDICTION_COLUMNS = (
    "workflow_id",
    "predicted_risk",
    "risk_probability_low",
    "risk_probability_medium",
    "risk_probability_high",
    "risk_factors",
)
