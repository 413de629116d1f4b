"""Deterministic rules (R1-R10) as one array-of-struct Column.

``rule_triggers(cfg)`` evaluates the six row rules in fixed order and keeps
the ones that fire; ``escalation_trigger(col)`` is the seventh (model) rule.
Every condition is null-safe: a missing or NaN value never fires a rule.
The whole thing is a narrow projection, codegen'd with the rest of the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.memo import cached_column
from ..functions.ratios import as_double
from ..functions.text import int_text, percent_text, python_percent
from ..schema import (
    APPROACHING_SLA,
    BACKLOG_PRESSURE,
    DEFAULT_RULE_CONFIG,
    ESCALATION_MESSAGE,
    HIGH_ERROR,
    HIGH_REWORK,
    HIGH_RISK_ESCALATION,
    MANUAL_AUTOMATION_OPPORTUNITY,
    NO_TRIGGERS_MESSAGE,
    RECOMMENDED_ACTIONS,
    SLA_BREACH,
    SLA_BREACH_UTILIZATION,
    RuleConfig,
)
from .features import ensure_features

RULE_RANK = {r: i + 1 for i, r in enumerate(
    (SLA_BREACH, APPROACHING_SLA, HIGH_ERROR, HIGH_REWORK, MANUAL_AUTOMATION_OPPORTUNITY, BACKLOG_PRESSURE, HIGH_RISK_ESCALATION)
)}
SEVERITY = {
    SLA_BREACH: "critical",
    APPROACHING_SLA: "warning",
    HIGH_ERROR: "warning",
    HIGH_REWORK: "warning",
    MANUAL_AUTOMATION_OPPORTUNITY: "info",
    BACKLOG_PRESSURE: "warning",
    HIGH_RISK_ESCALATION: "critical",
}


def _is(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def _trigger(rule: str, message: Column) -> Column:
    return F.struct(
        F.lit(RULE_RANK[rule]).alias("rule_rank"),
        F.lit(rule).alias("rule_type"),
        F.lit(SEVERITY[rule]).alias("severity"),
        message.alias("message"),
        F.lit(RECOMMENDED_ACTIONS[rule]).alias("recommended_action"),
    )


def rule_conditions(cfg: RuleConfig = DEFAULT_RULE_CONFIG) -> dict[str, Column]:
    """Boolean (never null) firing condition of each row rule."""
    u = as_double("sla_utilization")
    breach = _is(u >= F.lit(SLA_BREACH_UTILIZATION))
    return {
        SLA_BREACH: breach,
        APPROACHING_SLA: ~breach & _is(u >= F.lit(float(cfg.sla_warning_threshold))),
        HIGH_ERROR: _is(as_double("error_count") >= F.lit(float(cfg.high_error_threshold))),
        HIGH_REWORK: _is(as_double("rework_rate") >= F.lit(float(cfg.high_rework_rate))),
        MANUAL_AUTOMATION_OPPORTUNITY: _is(as_double("manual_step_ratio") >= F.lit(float(cfg.high_manual_ratio)))
        | _is(as_double("automation_score") <= F.lit(float(cfg.low_automation_threshold))),
        BACKLOG_PRESSURE: _is(as_double("pending_items") >= F.lit(float(cfg.backlog_threshold))),
    }


def rule_messages(cfg: RuleConfig = DEFAULT_RULE_CONFIG) -> dict[str, Column]:
    """Message text of each row rule (evaluated whether or not it fires)."""
    u = as_double("sla_utilization")
    return {
        SLA_BREACH: F.concat(F.lit("SLA breached: utilization at "), percent_text(u), F.lit(" of the allotted window")),
        APPROACHING_SLA: F.concat(
            F.lit("SLA utilization "),
            percent_text(u),
            F.lit(f" at or above the {python_percent(cfg.sla_warning_threshold)} warning threshold"),
        ),
        HIGH_ERROR: F.concat(
            F.lit("Error count "), int_text(F.col("error_count")), F.lit(f" at or above threshold {cfg.high_error_threshold}")
        ),
        HIGH_REWORK: F.concat(
            F.lit("Rework rate "),
            percent_text(as_double("rework_rate")),
            F.lit(f" at or above the {python_percent(cfg.high_rework_rate)} threshold"),
        ),
        MANUAL_AUTOMATION_OPPORTUNITY: F.concat(
            F.lit("Manual step ratio "),
            percent_text(as_double("manual_step_ratio")),
            F.lit(" / automation score "),
            percent_text(as_double("automation_score")),
            F.lit(" indicate an automation opportunity"),
        ),
        BACKLOG_PRESSURE: F.concat(
            F.lit("Pending items "),
            int_text(F.col("pending_items")),
            F.lit(f" at or above backlog threshold {cfg.backlog_threshold}"),
        ),
    }


def rule_triggers(cfg: RuleConfig = DEFAULT_RULE_CONFIG) -> Column:
    """Ordered array of the row rules that fire (empty when none)."""

    def build() -> Column:
        conds = rule_conditions(cfg)
        msgs = rule_messages(cfg)
        items = [F.when(conds[r], _trigger(r, msgs[r])) for r in conds]
        return F.filter(F.array(*items), lambda t: t.isNotNull())

    return cached_column(("rule_triggers", cfg), build)


def escalation_trigger(predicted_risk: Column) -> Column:
    """A trigger when the prediction is exactly 'high' (null never escalates)."""
    return F.when(
        predicted_risk.eqNullSafe(F.lit("high")), _trigger(HIGH_RISK_ESCALATION, F.lit(ESCALATION_MESSAGE))
    )


def all_triggers(cfg: RuleConfig = DEFAULT_RULE_CONFIG, predicted_risk: Column | None = None) -> Column:
    """Row rules, then escalation appended last."""
    row = rule_triggers(cfg)
    if predicted_risk is None:
        return row
    esc = escalation_trigger(predicted_risk)
    return F.when(esc.isNull(), row).otherwise(F.concat(row, F.array(esc)))


def risk_factors(cfg: RuleConfig = DEFAULT_RULE_CONFIG) -> Column:
    """R9 (U1 default): messages of the firing row rules, or the no-trigger sentence."""
    msgs = F.transform(rule_triggers(cfg), lambda t: t["message"])
    return F.when(F.size(msgs) == 0, F.array(F.lit(NO_TRIGGERS_MESSAGE))).otherwise(msgs)


# A risk-factor function maps a RuleConfig to an ARRAY<STRING> Column.
RiskFactorFn = Callable[[RuleConfig], Column]


def with_triggers(df: DataFrame, cfg: RuleConfig = DEFAULT_RULE_CONFIG, predicted_risk: str | None = None) -> DataFrame:
    """Engineered frame plus a ``triggers`` column (R1-R6, and R7 when a prediction column is named)."""
    eng = ensure_features(df)
    pred = F.col(predicted_risk) if predicted_risk else None
    return eng.withColumn("triggers", all_triggers(cfg, pred))


def triggers_long(df: DataFrame, cfg: RuleConfig = DEFAULT_RULE_CONFIG, predicted_risk: str | None = None) -> DataFrame:
    """One row per (workflow, fired rule) with its position in the ordered list.

    The ``_outer`` generator plus an explicit null filter keeps Catalyst from
    inferring a ``size(triggers) > 0`` filter below the generator: that filter
    would copy the whole rule expression and make constraint propagation blow
    up on wide plans."""
    t = with_triggers(df, cfg, predicted_risk)
    return (
        t.select("workflow_id", F.posexplode_outer("triggers").alias("pos", "t"))
        .where(F.col("t").isNotNull())
        .select("workflow_id", F.col("pos").cast("bigint").alias("pos"), "t.*")
    )
