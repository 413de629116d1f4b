"""Registry of named queries (Spark DataFrames) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpi_state, kpis
from ..operators.features import engineer_features, prepare_feature_frame
from ..sources import tables
from . import oracle as O

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


# --- P7, P8, K8 ----------------------------------------------------------------


@register(
    "engineer_features",
    O.with_ctes("select * from eng", engineered="workflows"),
)
def q_engineer_features(spark, sf):
    return engineer_features(tables.workflows(spark, sf))


@register(
    "feature_frame",
    O.with_ctes(
        "select sla_hours, elapsed_hours, manual_steps, automated_steps, automation_score, error_count, "
        "rework_count, transaction_volume, avg_handling_time_minutes, pending_items, completion_rate, "
        "sla_utilization, manual_step_ratio, error_rate, rework_rate, backlog_pressure, department, status, priority "
        "from eng",
        engineered="workflows",
    ),
)
def q_feature_frame(spark, sf):
    return prepare_feature_frame(tables.workflows(spark, sf))


@register(
    "kpi_department",
    O.with_ctes(
        "select department, count(*) as workflow_count, round(avg(sla_utilization), 6) as avg_sla_utilization, "
        "round(avg(error_rate), 6) as avg_error_rate from eng where department is not null group by department",
        engineered="workflows",
    ),
)
def q_kpi_department(spark, sf):
    d = kpis.department_breakdown(tables.workflows(spark, sf))
    return d.select("department", "workflow_count", _r("avg_sla_utilization"), _r("avg_error_rate"))


# --- rules (R1-R10, P9) -----------------------------------------------------------

from ..operators import alerts as A  # noqa: E402
from ..operators import rules as R  # noqa: E402
from ..schema import DEFAULT_RULE_CONFIG, RuleConfig  # noqa: E402

FIXED_STAMP = "2026-01-01T00:00:00+00:00"
CUSTOM_CONFIG = RuleConfig(
    sla_warning_threshold=0.9,
    high_error_threshold=3,
    high_rework_rate=0.05,
    high_manual_ratio=0.6,
    low_automation_threshold=0.4,
    backlog_threshold=50,
)
TRIG_COLS = "workflow_id, rule_rank, rule_type, severity, message, recommended_action"


def _labeled_as_predicted(spark, sf):
    """Labeled fixture with its label standing in for the model's prediction."""
    return tables.workflows_labeled(spark, sf).withColumnRenamed("risk_label", "predicted_risk")


def _trig_long(spark, sf, cfg=DEFAULT_RULE_CONFIG, pred=None):
    src = _labeled_as_predicted(spark, sf) if pred else tables.workflows(spark, sf)
    return R.triggers_long(src, cfg, pred).select(
        "workflow_id", "pos", F.col("rule_rank").cast("bigint").alias("rule_rank"), "rule_type", "severity", "message",
        "recommended_action",
    )


def _rule_query(rule: str):
    def q(spark, sf):
        pred = "predicted_risk" if rule == "high_risk_escalation" else None
        return _trig_long(spark, sf, pred=pred).where(F.col("rule_type") == rule).drop("pos")

    return q


_PRED_CTE = "pred as (select * exclude (risk_label), risk_label as predicted_risk from workflows_labeled)"
_TRIG_SELECT = f"select {TRIG_COLS.replace('rule_rank', 'cast(rule_rank as bigint) as rule_rank')} from trig"


def _long_sql(cfg, pred: bool) -> str:
    head = O.with_ctes("", labeled=pred).rstrip()
    if pred:
        head += ",\n" + _PRED_CTE + ",\n" + O.ENGINEERED_CTE.format(name="eng", src="pred").strip()
    else:
        head += ",\n" + O.ENGINEERED_CTE.format(name="eng", src="workflows").strip()
    head += ",\ntrig as (" + O.triggers_sql(cfg, "eng", "predicted_risk" if pred else None) + ")\n"
    return head


def _posexplode_sql(cfg, pred: bool) -> str:
    return _long_sql(cfg, pred) + (
        "select workflow_id, cast(row_number() over (partition by workflow_id order by rule_rank) - 1 as bigint) as pos, "
        "cast(rule_rank as bigint) as rule_rank, rule_type, severity, message, recommended_action from trig"
    )


for _key, _rule in (
    ("rule_sla_breach", "sla_breach"),
    ("rule_approaching_sla", "approaching_sla"),
    ("rule_high_error", "high_error"),
    ("rule_high_rework", "high_rework"),
    ("rule_manual_automation", "manual_automation_opportunity"),
    ("rule_backlog", "backlog_pressure"),
    ("rule_escalation", "high_risk_escalation"),
):
    _pred = _rule == "high_risk_escalation"
    register(_key, _long_sql(DEFAULT_RULE_CONFIG, _pred) + _TRIG_SELECT + f" where rule_type = '{_rule}'")(_rule_query(_rule))


register("rule_triggers_long", _posexplode_sql(DEFAULT_RULE_CONFIG, False))(lambda spark, sf: _trig_long(spark, sf))
register("rules_custom_config", _posexplode_sql(CUSTOM_CONFIG, False))(
    lambda spark, sf: _trig_long(spark, sf, CUSTOM_CONFIG)
)


@register(
    "risk_factors",
    _long_sql(DEFAULT_RULE_CONFIG, False)
    + "select e.workflow_id, coalesce((select string_agg(message, '; ' order by rule_rank) from trig t "
    "where t.workflow_id = e.workflow_id), 'No individual risk thresholds exceeded') as risk_factors from eng e",
)
def q_risk_factors(spark, sf):
    w = tables.workflows(spark, sf)
    from ..operators.features import engineer_features as _ef

    return _ef(w).select("workflow_id", F.array_join(R.risk_factors(), "; ").alias("risk_factors"))


@register(
    "rule_messages",
    O.with_ctes(
        "select workflow_id, "
        f"{O.sql_pct('sla_utilization')} as sla_pct, {O.sql_pct('rework_rate')} as rework_pct, "
        f"{O.sql_pct('manual_step_ratio')} as manual_pct, {O.sql_pct('automation_score')} as automation_pct, "
        f"cast({O.sql_int('error_count')} as varchar) as error_text, cast({O.sql_int('pending_items')} as varchar) as pending_text "
        "from eng",
        engineered="workflows",
    ),
)
def q_rule_messages(spark, sf):
    from ..functions.ratios import as_double
    from ..functions.text import int_text, percent_text

    e = engineer_features(tables.workflows(spark, sf))
    return e.select(
        "workflow_id",
        percent_text(as_double("sla_utilization")).alias("sla_pct"),
        percent_text(as_double("rework_rate")).alias("rework_pct"),
        percent_text(as_double("manual_step_ratio")).alias("manual_pct"),
        percent_text(as_double("automation_score")).alias("automation_pct"),
        int_text(F.col("error_count")).alias("error_text"),
        int_text(F.col("pending_items")).alias("pending_text"),
    )


# --- alerts and recommendations (A1-A8) ------------------------------------------

_ALERT_SELECT = (
    "select 'ALT-' || workflow_id || '-' || rule_type as alert_id, workflow_id, severity, rule_type as type, message, "
    f"recommended_action, '{FIXED_STAMP}' as generated_at from trig"
)


@register("alerts", _long_sql(DEFAULT_RULE_CONFIG, True) + _ALERT_SELECT)
def q_alerts(spark, sf):
    # Validated input has unique ids, so no dedup shuffle is needed.
    return A.generate_alerts(
        _labeled_as_predicted(spark, sf), "predicted_risk", generated_at=FIXED_STAMP, dedup=False
    )


def _two_copies(spark, sf):
    """The table twice: copy 1 has 1.5x elapsed hours, so other rules fire on the same ids."""
    w = tables.workflows(spark, sf)
    return w.withColumn("copy", F.lit(0)).unionByName(
        w.withColumn("elapsed_hours", F.col("elapsed_hours") * F.lit(1.5)).withColumn("copy", F.lit(1))
    )


_TWO_COPIES_CTE = (
    "dup as (select *, 0 as copy from workflows union all "
    "select * replace (elapsed_hours * 1.5e0 as elapsed_hours), 1 as copy from workflows)"
)


@register(
    "alerts_dedup",
    O.with_ctes("", extra=_TWO_COPIES_CTE).rstrip()
    + ",\n" + O.ENGINEERED_CTE.format(name="eng", src="dup").strip()
    + ",\ntrig0 as (" + O.triggers_sql(DEFAULT_RULE_CONFIG, "eng", None, extra_cols="copy") + "),\n"
    + "trig as (select * from (select *, row_number() over (partition by workflow_id, rule_type order by copy) rn "
    "from trig0) where rn = 1)\n" + _ALERT_SELECT,
)
def q_alerts_dedup(spark, sf):
    scored = R.with_triggers(_two_copies(spark, sf))
    return A.alerts_from_scored(scored, FIXED_STAMP, dedup=True, order_col="copy")


def _prediction_rows(spark, sf):
    """Two predictions per id: the label (pos 0), then an SLA stand-in (pos 1) that must win."""
    lab = tables.workflows_labeled(spark, sf)
    u = F.col("elapsed_hours") / F.col("sla_hours")
    stand_in = F.when(u >= 1, "high").when(u >= 0.8, "medium").otherwise("low")
    return lab.select("workflow_id", F.col("risk_label").alias("predicted_risk"), F.lit(0).alias("pos")).unionByName(
        lab.select("workflow_id", stand_in.alias("predicted_risk"), F.lit(1).alias("pos"))
    )


_PRED_ROWS_CTE = """
predictions as (
 select workflow_id, risk_label as predicted_risk, 0 as pos from workflows_labeled
 union all
 select workflow_id, case when elapsed_hours/sla_hours >= 1 then 'high' when elapsed_hours/sla_hours >= 0.8 then 'medium'
  else 'low' end, 1 from workflows_labeled),
latest as (select workflow_id, arg_max(predicted_risk, pos) as predicted_risk from predictions group by workflow_id),
pw as (select w.*, l.predicted_risk from workflows w left join latest l using (workflow_id))
"""


@register(
    "alerts_with_predictions",
    O.with_ctes("", labeled=True, extra=_PRED_ROWS_CTE).rstrip()
    + ",\n" + O.ENGINEERED_CTE.format(name="eng", src="pw").strip()
    + ",\ntrig as (" + O.triggers_sql(DEFAULT_RULE_CONFIG, "eng", "predicted_risk") + ")\n" + _ALERT_SELECT,
)
def q_alerts_with_predictions(spark, sf):
    return A.generate_alerts(
        tables.workflows(spark, sf), _prediction_rows(spark, sf), generated_at=FIXED_STAMP, dedup=False, order_col="pos"
    )


_CATEGORY_SQL = (
    "case rule_type when 'sla_breach' then 'escalate' when 'high_risk_escalation' then 'escalate' "
    "when 'approaching_sla' then 'review_sla' when 'high_error' then 'investigate_errors' "
    "when 'high_rework' then 'reduce_rework' when 'manual_automation_opportunity' then 'assess_automation' "
    "when 'backlog_pressure' then 'rebalance_workload' end"
)
_FALLBACK_SQL = (
    "select workflow_id, case when predicted_risk = 'medium' then 'monitor' else 'no_action' end as category, "
    "case when predicted_risk = 'medium' then 'Continue monitoring; no immediate action required' "
    "else 'No action needed at this time' end as message, "
    "case when predicted_risk = 'medium' then 'No rule thresholds triggered, but the model predicts medium risk' "
    "else 'No rule thresholds triggered and no elevated predicted risk' end as signal "
    "from eng e where not exists (select 1 from trig t where t.workflow_id = e.workflow_id)"
)


@register(
    "recommendations",
    _long_sql(DEFAULT_RULE_CONFIG, True)
    + f"select workflow_id, {_CATEGORY_SQL} as category, recommended_action as message, message as signal from trig "
    + "union all " + _FALLBACK_SQL,
)
def q_recommendations(spark, sf):
    return A.generate_recommendations(_labeled_as_predicted(spark, sf), "predicted_risk")


@register("recommendation_fallback", _long_sql(DEFAULT_RULE_CONFIG, True) + _FALLBACK_SQL)
def q_recommendation_fallback(spark, sf):
    recs = A.generate_recommendations(_labeled_as_predicted(spark, sf), "predicted_risk")
    return recs.where(F.col("category").isin("monitor", "no_action"))


# --- KPIs (K1-K9) --------------------------------------------------------------------


@register(
    "kpi_volume",
    O.with_ctes(
        "select 'total' as dimension, 'all' as value, count(*) as n from workflows "
        "union all select 'status', status, count(*) from workflows where status is not null group by status "
        "union all select 'department', department, count(*) from workflows where department is not null group by department "
        "union all select 'priority', priority, count(*) from workflows where priority is not null group by priority"
    ),
)
def q_kpi_volume(spark, sf):
    return kpis.volume_counts(tables.workflows(spark, sf))


_SLA_SQL = (
    "count(*) as total_workflows, coalesce(avg(sla_utilization), 0.0e0) as avg_sla_utilization, "
    "count_if(sla_utilization >= 1.0e0) as sla_breach_count, "
    "coalesce(count_if(sla_utilization >= 1.0e0) * 1.0e0 / nullif(count(*), 0), 0.0e0) as sla_breach_rate, "
    "count_if(sla_utilization >= 0.8e0 and sla_utilization < 1.0e0) as sla_approaching_count, "
    "coalesce(count_if(sla_utilization >= 0.8e0 and sla_utilization < 1.0e0) * 1.0e0 / nullif(count(*), 0), 0.0e0) "
    "as sla_approaching_rate"
)
_EFF_SQL = (
    "avg(manual_step_ratio) as avg_manual_step_ratio, avg(automation_score) as avg_automation_score, "
    "avg(completion_rate) as avg_completion_rate, avg(avg_handling_time_minutes) as avg_handling_time_minutes, "
    "avg(error_rate) as avg_error_rate, avg(rework_rate) as avg_rework_rate"
)


@register(
    "kpi_sla",
    O.with_ctes(
        "select round(avg_sla_utilization, 9) as avg_sla_utilization, sla_breach_count, round(sla_breach_rate, 9) as "
        "sla_breach_rate, sla_approaching_count, round(sla_approaching_rate, 9) as sla_approaching_rate from "
        f"(select {_SLA_SQL} from eng)",
        engineered="workflows",
    ),
)
def q_kpi_sla(spark, sf):
    k = kpis.sla_kpis(tables.workflows(spark, sf))
    return k.select(
        _r("avg_sla_utilization", 9), "sla_breach_count", _r("sla_breach_rate", 9), "sla_approaching_count",
        _r("sla_approaching_rate", 9),
    )


@register(
    "kpi_efficiency",
    O.with_ctes(
        "select " + ", ".join(f"round({c}, 6) as {c}" for c in kpis.EFFICIENCY_COLUMNS) + f" from (select {_EFF_SQL} from eng)",
        engineered="workflows",
    ),
)
def q_kpi_efficiency(spark, sf):
    k = kpis.efficiency_kpis(tables.workflows(spark, sf))
    return k.select(*[_r(c) for c in kpis.EFFICIENCY_COLUMNS])


@register(
    "kpi_risk_distribution",
    O.with_ctes(
        "select l.risk_label, count(w.risk_label) as n, "
        "round(coalesce(count(w.risk_label) * 1.0e0 / nullif((select count(*) from workflows_labeled), 0), 0.0e0), 9) as share "
        "from (values ('low'), ('medium'), ('high')) l(risk_label) left join workflows_labeled w on w.risk_label = l.risk_label "
        "group by l.risk_label",
        labeled=True,
    ),
)
def q_kpi_risk_distribution(spark, sf):
    d = kpis.risk_distribution(tables.workflows_labeled(spark, sf), "risk_label")
    return d.select("risk_label", "n", _r("share", 9))


def _summary_sql() -> str:
    names = ["total_workflows", *kpis.SLA_METRICS, *kpis.EFFICIENCY_COLUMNS]
    prefix = {n: "volume." if n == "total_workflows" else "sla." if n in kpis.SLA_METRICS else "efficiency." for n in names}
    risk = []
    for label in ("low", "medium", "high"):
        risk.append(f"count_if(risk_label = '{label}') as risk_count_{label}")
        risk.append(f"coalesce(count_if(risk_label = '{label}') * 1.0e0 / nullif(count(*), 0), 0.0e0) as risk_share_{label}")
    keys = [(n, prefix[n] + n) for n in names]
    for label in ("low", "medium", "high"):
        keys += [(f"risk_count_{label}", f"risk.counts.{label}"), (f"risk_share_{label}", f"risk.shares.{label}")]
    unpivot = " union all ".join(f"select '{k}' as metric, round(cast({c} as double), 6) as value from g" for c, k in keys)
    return O.with_ctes(
        unpivot, labeled=True, engineered="workflows_labeled",
        extra=f"g as (select {_SLA_SQL}, {_EFF_SQL}, {', '.join(risk)} from eng)",
    )


@register("kpi_summary", _summary_sql())
def q_kpi_summary(spark, sf):
    long = kpis.kpi_metrics_long(tables.workflows_labeled(spark, sf), label_col="risk_label")
    return long.select("metric", _r("value"))


@register("kpi_incremental", _summary_sql() + "".join(
    f" union all select 'count.{d}.' || {d}, cast(count(*) as double) from eng where {d} is not null group by 1" for d in kpis.VOLUME_DIMENSIONS
))
def q_kpi_incremental(spark, sf):
    """K1-K9 from saved states: the table arrives in four batches, each read once; one that is offered again is not counted twice."""
    path = scratch_path(spark, "kpi-state")
    arrived = scratch_path(spark, "kpi-batches")
    flows = tables.workflows_labeled(spark, sf)
    flows.withColumn("arrival", F.pmod(F.xxhash64("workflow_id"), F.lit(4))).write.partitionBy("arrival").parquet(arrived)
    for batch in ("0", "1", "2", "3", "2"):
        # folders of this name exist for values that a row has; a small table may lack one
        if IO.path_exists(spark, f"{arrived}/arrival={batch}"):
            kpi_state.add_batch(spark.read.parquet(f"{arrived}/arrival={batch}"), path, batch, "risk_label")
    state = kpi_state.read_state(spark, path)
    counts = kpi_state.categories_of_state(state).select(
        F.concat_ws(".", F.lit("count"), "dimension", "value").alias("metric"), F.col("workflow_count").cast("double").alias("value")
    )
    return kpi_state.metrics_of_state(state, labels=True).unionByName(counts).select("metric", _r("value"))


# --- data quality (V2-V10) ---------------------------------------------------------

from ..operators import quality as Q  # noqa: E402
from ..schema import CRITICAL_COLUMNS, NON_NEGATIVE_COLUMNS, UNIT_INTERVAL_COLUMNS  # noqa: E402


def _dq_checks_sql() -> list[tuple[int, str, str, str | None, str]]:
    out = []
    for i, c in enumerate(CRITICAL_COLUMNS):
        cond = f"{c} is null" + (f" or isnan({c})" if c in ("sla_hours", "elapsed_hours") else "")
        out.append((10 + i, "error", "null_critical_field", c, cond))
    for i, c in enumerate(NON_NEGATIVE_COLUMNS):
        out.append((20 + i, "error", "negative_value", c, f"coalesce({c} < 0, false)"))
    for i, c in enumerate(UNIT_INTERVAL_COLUMNS):
        out.append((30 + i, "error", "unit_interval_bounds", c, f"coalesce({c} < 0 or {c} > 1, false)"))
    out.append((40, "error", "impossible_sla", "sla_hours", "coalesce(sla_hours <= 0, false)"))
    out.append((50, "error", "inconsistent_timestamps", None, "coalesce(updated_at < created_at, false)"))
    out.append((60, "warning", "unknown_status", "status",
                "not coalesce(status in ('open', 'in_progress', 'on_hold', 'completed', 'cancelled'), false)"))
    return out


def _dq_counts_sql() -> str:
    parts = []
    for rank, sev, check, col, cond in _dq_checks_sql():
        over = f"count_if(coalesce({col} > 1, false))" if check == "unit_interval_bounds" else "0"
        c = "null" if col is None else f"'{col}'"
        parts.append(
            f"select cast({rank} as bigint) as check_rank, '{sev}' as severity, '{check}' as \"check\", {c} as \"column\", "
            f"count_if({cond}) as n, cast({over} as bigint) as n_over from workflows_dirty"
        )
    return "counts as (" + " union all ".join(parts) + ")"


def _dq_sql(body: str) -> str:
    return O.with_ctes(body, dirty=True, extra=_dq_counts_sql())


def _dirty(spark, sf):
    return tables.workflows_dirty(spark, sf)


register("dq_duplicate_ids", O.with_ctes(
    "select coalesce(workflow_id, 'nan') as workflow_id, count(*) as n from workflows_dirty group by 1 having count(*) > 1",
    dirty=True,
))(lambda spark, sf: Q.duplicate_ids(_dirty(spark, sf)))


def _counts_of(check: str, cols: tuple[str, ...]):
    def q(spark, sf):
        c = Q.check_counts(_dirty(spark, sf)).where((F.col("check") == check) & (F.col("n") > 0))
        return c.select(*cols)

    return q


for _key, _check, _cols in (
    ("dq_null_critical", "null_critical_field", ("column", "n")),
    ("dq_negative", "negative_value", ("column", "n")),
    ("dq_unit_interval", "unit_interval_bounds", ("column", "n", "n_over")),
    ("dq_impossible_sla", "impossible_sla", ("n",)),
    ("dq_timestamp_order", "inconsistent_timestamps", ("n",)),
):
    _sel = ", ".join('"column"' if c == "column" else c for c in _cols)
    register(_key, _dq_sql(f"select {_sel} from counts where \"check\" = '{_check}' and n > 0"))(_counts_of(_check, _cols))


register("dq_unknown_status", O.with_ctes(
    "select coalesce(status, 'nan') as value, count(*) as n from workflows_dirty "
    "where not coalesce(status in ('open', 'in_progress', 'on_hold', 'completed', 'cancelled'), false) group by 1",
    dirty=True,
))(lambda spark, sf: Q.unknown_status_values(_dirty(spark, sf)))


def _violations_sql() -> str:
    parts = []
    for rank, _sev, check, col, cond in _dq_checks_sql():
        c = "cast(null as varchar)" if col is None else f"'{col}'"
        parts.append(
            f"select cast({rank} as bigint) as check_rank, '{check}' as \"check\", {c} as \"column\", "
            f"coalesce(workflow_id, 'nan') as workflow_id from workflows_dirty where {cond}"
        )
    return O.with_ctes(" union all ".join(parts), dirty=True)


register("dq_violations", _violations_sql())(lambda spark, sf: Q.violations(_dirty(spark, sf)))


def _issue_report_sql() -> str:
    dup_vals = "select coalesce(workflow_id, 'nan') as v from workflows_dirty group by 1 having count(*) > 1"
    msg = (
        "case \"check\" "
        "when 'null_critical_field' then 'Column ''' || \"column\" || ''' has ' || n || ' null value(s)' "
        "when 'negative_value' then 'Column ''' || \"column\" || ''' has ' || n || ' negative value(s)' "
        "when 'unit_interval_bounds' then 'Column ''' || \"column\" || ''' has ' || n || ' value(s) outside [0, 1]' || "
        "case when n_over > 0 then ' (' || n_over || '" + Q.OVER_ONE_HINT + "' else '' end "
        "when 'impossible_sla' then 'Column ''sla_hours'' has ' || n || ' value(s) <= 0' "
        "when 'inconsistent_timestamps' then n || ' row(s) have updated_at before created_at' "
        "when 'unknown_status' then 'Unrecognized status value(s) in ' || n || ' row(s)' end"
    )
    body = (
        "select cast(1 as bigint) as check_rank, 'error' as severity, 'duplicate_workflow_id' as \"check\", "
        f"'workflow_id' as \"column\", (select count(*) from ({dup_vals})) as n, "
        f"'Duplicate workflow_id values found: ' || (select count(*) from ({dup_vals})) || ' id(s)' as message "
        f"where (select count(*) from ({dup_vals})) > 0 "
        f"union all select check_rank, severity, \"check\", \"column\", n, {msg} as message from counts where n > 0"
    )
    return _dq_sql(body)


register("dq_issue_values", O.with_ctes(
    "select 'duplicate_workflow_id' as \"check\", coalesce(workflow_id, 'nan') as value, count(*) as n from workflows_dirty "
    "group by 2 having count(*) > 1 union all "
    "select 'unknown_status', coalesce(status, 'nan'), count(*) from workflows_dirty "
    "where not coalesce(status in ('open', 'in_progress', 'on_hold', 'completed', 'cancelled'), false) group by 2",
    dirty=True,
))(lambda spark, sf: Q.issue_values(_dirty(spark, sf)))

register("dq_issue_report", _issue_report_sql())(lambda spark, sf: Q.issue_report(_dirty(spark, sf), materialize=True))


# --- report views (J1-J11, P12, P13) and metrics (M8-M10) -------------------------------

from ..operators import evaluation as EV  # noqa: E402
from ..operators import views as V  # noqa: E402

SEL_RISK = ("high", "medium")
SEL_DEPARTMENT = ("AUTOMOBILE", "BUILDING", "MACHINERY")
SEL_PRIORITY = ("urgent", "high", "medium")

_PREDS_CTE = """
eng as (select * from ({eng}) ),
trig as ({trig}),
preds as (
 select we.workflow_id,
  case when draw < el/(el+em+eh) then 'low' when draw < (el+em)/(el+em+eh) then 'medium' else 'high' end as predicted_risk,
  round(el/(el+em+eh), 9) as risk_probability_low, round(em/(el+em+eh), 9) as risk_probability_medium,
  round(eh/(el+em+eh), 9) as risk_probability_high,
  coalesce((select string_agg(message, '; ' order by rule_rank) from trig t where t.workflow_id = we.workflow_id),
   'No individual risk thresholds exceeded') as risk_factors
 from we),
enriched as (select p.*, w.department, w.status, w.priority from preds p left join workflows w using (workflow_id)),
filtered as (select * from enriched where predicted_risk in ('high', 'medium')
  and department in ('AUTOMOBILE', 'BUILDING', 'MACHINERY') and status is not null
  and priority in ('urgent', 'high', 'medium'))
"""


def _views_sql(body: str, with_alerts: bool = False) -> str:
    eng_inner = O.ENGINEERED_CTE.format(name="x", src="workflows").strip()
    eng_inner = eng_inner[eng_inner.index("(") + 1: eng_inner.rindex(")")]
    extra = _PREDS_CTE.format(eng=eng_inner, trig=O.triggers_sql(DEFAULT_RULE_CONFIG, "eng", None))
    if with_alerts:
        extra += (
            ",\npeng as (select e.*, p.predicted_risk from eng e join preds p using (workflow_id)),\n"
            "ptrig as (" + O.triggers_sql(DEFAULT_RULE_CONFIG, "peng", "predicted_risk") + "),\n"
            "alerts as (select 'ALT-' || workflow_id || '-' || rule_type as alert_id, workflow_id, severity, "
            "rule_type as type, message, recommended_action, '" + FIXED_STAMP + "' as generated_at from ptrig),\n"
            "recs as (select workflow_id, " + _CATEGORY_SQL + " as category, recommended_action as message, "
            "message as signal from ptrig union all " + _FALLBACK_SQL.replace("from eng e", "from peng e").replace(
                "from trig t", "from ptrig t") + ")"
        )
    return O.with_ctes(body, labeled=True, extra=extra)


def _saved_outputs(spark, sf):
    """The run outputs that a report view reads (predictions, raw workflows, alerts, recommendations): each
    that it asks for is written as Parquet to the shared folder and read again, as the views reload saved
    files. Nothing outlives the query that asked."""
    return _LazyOutputs(spark, sf)


class _LazyOutputs:
    def __init__(self, spark, sf):
        self.spark, self.sf, self.done = spark, sf, {}

    def _lookup(self):
        return self["predictions"].select("workflow_id", "predicted_risk")

    def _build(self, name):
        spark, sf = self.spark, self.sf
        if name == "predictions":
            return tables.standin_predictions(spark, sf, self["workflows"])
        if name == "workflows":
            return tables.workflows(spark, sf)
        if name == "alerts":
            return A.generate_alerts(self["workflows"], self._lookup(), generated_at=FIXED_STAMP, dedup=False)
        if name == "recommendations":
            return A.generate_recommendations(self["workflows"], self._lookup())
        raise KeyError(name)

    def __getitem__(self, name):
        if name not in self.done:
            path = scratch_path(self.spark, f"outputs-{name}")
            self._build(name).write.parquet(path)
            self.done[name] = self.spark.read.parquet(path)
        return self.done[name]


def _enriched(spark, sf, out=None):
    out = out or _saved_outputs(spark, sf)
    return V.enrich_predictions(out["predictions"], out["workflows"])


def _filtered(spark, sf, out=None):
    return V.filter_predictions(_enriched(spark, sf, out), SEL_RISK, SEL_DEPARTMENT, None, SEL_PRIORITY)


def _restricted(name):
    """An output's rows of the filtered workflows; both are read from the same saved run."""

    def q(spark, sf):
        out = _saved_outputs(spark, sf)
        return V.restrict_to_ids(out[name], _filtered(spark, sf, out))

    return q


def _view_alerts(spark, sf):
    return _saved_outputs(spark, sf)["alerts"]


def _view_recs(spark, sf):
    return _saved_outputs(spark, sf)["recommendations"]


register("predictions_enriched", _views_sql("select * from enriched"))(_enriched)
register("filter_predictions", _views_sql("select * from filtered"))(_filtered)
register("filter_options", _views_sql(
    "select 'department' as \"column\", department as value from enriched where department is not null group by 2 "
    "union all select 'status', status from enriched where status is not null group by 2 "
    "union all select 'priority', priority from enriched where priority is not null group by 2"
))(lambda spark, sf: V.filter_options(_enriched(spark, sf)))
register("alerts_filtered", _views_sql(
    "select * from alerts where workflow_id in (select workflow_id from filtered)", with_alerts=True
))(_restricted("alerts"))
register("recommendations_filtered", _views_sql(
    "select * from recs where workflow_id in (select workflow_id from filtered)", with_alerts=True
))(_restricted("recommendations"))
register("alert_severity_counts", _views_sql(
    "select severity, count(*) as n from alerts group by severity", with_alerts=True
))(lambda spark, sf: V.alert_severity_counts(_view_alerts(spark, sf)))
register("recommendation_category_counts", _views_sql(
    "select category, count(*) as n from recs group by category", with_alerts=True
))(lambda spark, sf: V.recommendation_category_counts(_view_recs(spark, sf)))
register("risk_monitor", _views_sql(
    "select workflow_id, department, status, priority, predicted_risk, risk_probability_low, risk_probability_medium, "
    "risk_probability_high, risk_factors from filtered"
))(lambda spark, sf: V.risk_monitor(_filtered(spark, sf)))


@register("executive_overview", _views_sql(
    "select (select count(*) from workflows) as total_workflows, "
    "round((select count_if(sla_utilization >= 1.0e0) * 1.0e0 / count(*) from eng), 9) as sla_breach_rate, "
    "count(*) as filtered_workflows, count_if(predicted_risk = 'high') as high_risk_filtered, "
    "count_if(predicted_risk = 'low') as risk_low, count_if(predicted_risk = 'medium') as risk_medium, "
    "count_if(predicted_risk = 'high') as risk_high from filtered"
))
def q_executive_overview(spark, sf):
    out = _saved_outputs(spark, sf)
    every = engineer_features(out["workflows"]).agg(*kpis.global_kpi_columns())
    filtered = V.filter_predictions(V.enrich_predictions(out["predictions"], out["workflows"]), SEL_RISK, SEL_DEPARTMENT, None, SEL_PRIORITY)
    return V.executive_overview(every.select("total_workflows", _r("sla_breach_rate", 9)), filtered)


def _label_vs_standin(spark, sf):
    lab = tables.workflows_labeled(spark, sf)
    u = F.col("elapsed_hours") / F.col("sla_hours")
    return lab.withColumn("stand_in", F.when(u >= 1, "high").when(u >= 0.8, "medium").otherwise("low"))


_STANDIN_CTE = (
    "scored as (select risk_label, case when elapsed_hours/sla_hours >= 1 then 'high' "
    "when elapsed_hours/sla_hours >= 0.8 then 'medium' else 'low' end as stand_in from workflows_labeled)"
)


@register("confusion_matrix", O.with_ctes(
    "select l.actual, count_if(s.stand_in = 'low') as low, count_if(s.stand_in = 'medium') as medium, "
    "count_if(s.stand_in = 'high') as high from (values ('low'), ('medium'), ('high')) l(actual) "
    "left join scored s on s.risk_label = l.actual group by l.actual",
    labeled=True, extra=_STANDIN_CTE,
))
def q_confusion_matrix(spark, sf):
    return V.confusion_matrix_view(EV.confusion_long(_label_vs_standin(spark, sf), "risk_label", "stand_in"))


def _metrics_sql() -> str:
    labels = ("low", "medium", "high")
    cnt = ["count(*) as n_total", "count_if(risk_label = stand_in) as n_correct"]
    for c in labels:
        cnt += [f"count_if(risk_label = '{c}' and stand_in = '{c}') as tp_{c}", f"count_if(risk_label = '{c}') as sup_{c}",
                f"count_if(stand_in = '{c}') as pred_{c}"]

    def d(n, m):
        return f"coalesce({n} * 1.0e0 / nullif({m}, 0), 0.0e0)"

    prec = {c: d(f"tp_{c}", f"pred_{c}") for c in labels}
    rec = {c: d(f"tp_{c}", f"sup_{c}") for c in labels}
    f1 = {c: d(f"2 * tp_{c}", f"sup_{c} + pred_{c}") for c in labels}
    tot = "(" + " + ".join(f"sup_{c}" for c in labels) + ")"

    def macro(m):
        return "(" + " + ".join(m[c] for c in labels) + ") / 3.0e0"

    def weighted(m):
        return d("(" + " + ".join(f"{m[c]} * sup_{c}" for c in labels) + ")", tot)

    sel = [
        f"round({d('n_correct', 'n_total')}, 9) as accuracy",
        f"round({macro(prec)}, 9) as precision_macro", f"round({macro(rec)}, 9) as recall_macro",
        f"round({macro(f1)}, 9) as f1_macro", f"round({weighted(prec)}, 9) as precision_weighted",
        f"round({weighted(rec)}, 9) as recall_weighted", f"round({weighted(f1)}, 9) as f1_weighted",
    ] + [f"sup_{c} as support_{c}" for c in labels]
    return O.with_ctes(f"select {', '.join(sel)} from (select {', '.join(cnt)} from scored)", labeled=True, extra=_STANDIN_CTE)


@register("classification_metrics", _metrics_sql())
def q_classification_metrics(spark, sf):
    m = EV.metrics_frame(_label_vs_standin(spark, sf), "risk_label", "stand_in")
    return m.select(*[_r(c, 9) for c in EV.METRIC_NAMES], *[f"support_{c}" for c in ("low", "medium", "high")])


# --- sources and sinks (S1, S2, S4, S5, S7) ----------------------------------------------

from ..session import scratch_path, written  # noqa: E402
from ..sources import files as IO  # noqa: E402
from ..sources import runs  # noqa: E402


@register("scan_workflows", O.with_ctes("select *, cast(0 as bigint) as n_unparsed from workflows"))
def q_scan_workflows(spark, sf):
    """Round trip through the CSV scanner: write the table as CSV text, scan it back typed;
    ``n_unparsed`` counts the rescued text cells of each row (none for this table)."""
    from ..schema import LONG_COLUMNS, REQUIRED_COLUMNS

    path = scratch_path(spark, "workflows-csv")
    IO._write_csv(tables.workflows(spark, sf), path)
    back = IO.load_workflow_data(spark, path, "csv")
    back = back.withColumns({c: F.col(c).cast("bigint") for c in LONG_COLUMNS})  # whole numbers in this table
    return back.select(*REQUIRED_COLUMNS, F.coalesce(F.size(IO.UNPARSED), F.lit(0)).cast("bigint").alias("n_unparsed"))


@register("parse_timestamps", O.with_ctes(
    "select workflow_id, case when cast(substr(workflow_id, 4) as bigint) % 13 = 0 then null else created_at end "
    "as created_at, updated_at from workflows"
))
def q_parse_timestamps(spark, sf):
    w = tables.workflows(spark, sf)
    k = tables.workflow_key(w)
    text = w.select(
        "workflow_id",
        F.when(k % 13 == 0, F.lit("not a date")).otherwise(F.col("created_at").cast("string")).alias("created_at"),
        F.col("updated_at").cast("string").alias("updated_at"),
    )
    return IO.parse_timestamps(text)


@register("predictions_flat", _views_sql("select * from preds"))
def q_predictions_flat(spark, sf):
    p = tables.standin_predictions(spark, sf)
    nested = p.select(
        "workflow_id",
        "predicted_risk",
        F.create_map(*[x for k in ("low", "medium", "high") for x in (F.lit(k), F.col(f"risk_probability_{k}"))]).alias(
            "risk_probability"
        ),
        F.split("risk_factors", "; ").alias("risk_factors"),
    )
    return IO.predictions_flat(nested)


@register("alerts_csv_roundtrip", _long_sql(DEFAULT_RULE_CONFIG, True) + _ALERT_SELECT)
def q_alerts_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "alerts-csv")
    IO.save_alerts(q_alerts(spark, sf), path)
    return IO._read_csv(spark, path, IO.ALERTS_SCHEMA)


@register("kpi_summary_json", _long_sql(DEFAULT_RULE_CONFIG, True) + (
    "select 'total_workflows' as item, null as value, cast(count(*) as double) as number from eng "
    "union all select 'sla_breach_count', null, cast(count_if(sla_utilization >= 1.0e0) as double) from eng "
    "union all select 'risk_high', null, cast(count_if(predicted_risk = 'high') as double) from eng "
    "union all select 'status', status, cast(count(*) as double) from eng where status is not null group by 2 "
    "union all select 'department', department, cast(count(*) as double) from eng where department is not null group by 2 "
    "union all select 'priority', priority, cast(count(*) as double) from eng where priority is not null group by 2"
))
def q_kpi_summary_json(spark, sf):
    """Document and category rows, saved and read again."""
    path = scratch_path(spark, "kpi") + ".json"
    scored = _labeled_as_predicted(spark, sf)
    IO.save_json(spark, kpis.build_kpi_summary(scored, "predicted_risk"), path)
    IO.save_kpi_categories(kpis.category_table(scored), path)
    doc = spark.read.option("multiLine", True).json(path)
    number = lambda name, c: F.struct(F.lit(name).alias("item"), F.lit(None).cast("string").alias("value"), F.col(c).cast("double").alias("number"))
    scalars = F.array(
        number("total_workflows", "volume.total_workflows"), number("sla_breach_count", "sla.sla_breach_count"), number("risk_high", "risk.counts.high")
    )
    rows = spark.read.schema(IO.CATEGORIES_SCHEMA).json(IO._categories_path(path))
    return doc.select(F.inline(scalars)).unionByName(
        rows.select(F.col("dimension").alias("item"), "value", F.col("workflow_count").cast("double").alias("number"))
    )


# --- preprocessing, split, weights, models (F1-F5, M1-M7, M12, J10, L1) ---------------------

from ..operators import models as M  # noqa: E402
from ..operators import preprocessing as P  # noqa: E402
from ..operators.selection import exact_medians  # noqa: E402
from ..schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES, RISK_LABELS  # noqa: E402

def _portable_key(df):
    return (tables.workflow_key(df) * F.lit(2654435761) + F.lit(42)) % F.lit(4294967296)


_PORTABLE_KEY_SQL = "(cast(substr(workflow_id, 4) as bigint) * 2654435761 + 42) % 4294967296"


@register("prep_medians", O.with_ctes(
    " union all ".join(f"select '{c}' as feature, round(cast(median({c}) as double), 9) as median from eng" for c in NUMERIC_FEATURES),
    engineered="workflows",
))
def q_prep_medians(spark, sf):
    meds = exact_medians(engineer_features(tables.workflows(spark, sf)), list(NUMERIC_FEATURES))
    return spark.createDataFrame([(c, meds[c]) for c in NUMERIC_FEATURES], "feature string, median double").select(
        "feature", _r("median", 9)
    )


@register("prep_scaled", O.with_ctes(
    " union all ".join(
        f"select '{c}' as feature, round(avg(coalesce({c}, (select median({c}) from eng))), 6) as mean, "
        f"round(stddev_pop(coalesce({c}, (select median({c}) from eng))), 6) as std from eng"
        for c in NUMERIC_FEATURES
    ),
    engineered="workflows",
))
def q_prep_scaled(spark, sf):
    s = P.fit_statistics(engineer_features(tables.workflows(spark, sf)), list(NUMERIC_FEATURES), [])
    rows = [(c, s["mean"][c], s["scale"][c]) for c in NUMERIC_FEATURES]
    return spark.createDataFrame(rows, "feature string, mean double, std double").select("feature", _r("mean"), _r("std"))


@register("prep_modes", O.with_ctes(
    " union all ".join(
        f"select * from (select '{c}' as feature, {c} as mode from workflows where {c} is not null group by {c} "
        f"order by count(*) desc, {c} asc limit 1)"
        for c in CATEGORICAL_FEATURES
    )
))
def q_prep_modes(spark, sf):
    return P.category_modes(tables.workflows(spark, sf), list(CATEGORICAL_FEATURES))


def _fitted_prep(spark, sf):
    w = engineer_features(tables.workflows(spark, sf)).select("workflow_id", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES)
    return w, P.WorkflowPreprocessor(materialize=False).fit(written(w, "features"))


@register("prep_onehot", O.with_ctes(
    " union all ".join(
        f"select workflow_id, '{c}' as feature, cast(dense_rank() over (order by {c}) - 1 as bigint) as slot from workflows"
        for c in CATEGORICAL_FEATURES
    )
))
def q_prep_onehot(spark, sf):
    from pyspark.ml.functions import vector_to_array

    w, prep = _fitted_prep(spark, sf)
    arr = prep.transform(w).select("workflow_id", vector_to_array("features").alias("v"))
    stats = prep.stats()
    start = len(NUMERIC_FEATURES) + 1
    blocks = []
    for c in CATEGORICAL_FEATURES:
        width = len(stats["categories"][c])
        slot = F.array_position(F.slice("v", start, width), F.lit(1.0)) - 1
        blocks.append(F.struct(F.lit(c).alias("feature"), slot.alias("slot")))
        start += width
    return arr.select("workflow_id", F.inline(F.array(*blocks)))


@register("prep_feature_slots", O.with_ctes(
    " union all ".join(
        f"select '{c}' as feature, 0.0e0 as mean, case when stddev_pop(coalesce({c}, (select median({c}) from eng))) > 0 then 1.0e0 else 0.0e0 end as square from eng"
        for c in NUMERIC_FEATURES
    ) + " union all " + " union all ".join(
        f"select '{c}=' || {c}, round(count(*) * 1.0e0 / (select count(*) from eng), 6), round(count(*) * 1.0e0 / (select count(*) from eng), 6) "
        f"from eng where {c} is not null group by {c}"
        for c in CATEGORICAL_FEATURES
    ),
    engineered="workflows",
))
def q_prep_feature_slots(spark, sf):
    """mean and mean square of every slot of the feature vector over all rows, by slot name."""
    from pyspark.ml.functions import vector_to_array

    w, prep = _fitted_prep(spark, sf)
    slots = prep.transform(w).select(F.posexplode(vector_to_array("features")).alias("i", "x"))
    per = slots.groupBy("i").agg(F.round(F.abs(F.avg("x")), 6).alias("mean"), F.round(F.avg(F.col("x") * F.col("x")), 6).alias("square"))
    names = F.array(*[F.lit(n) for n in prep.vector_layout()])
    return per.select(F.get(names, F.col("i")).alias("feature"), "mean", "square")


@register("prep_features", O.with_ctes(
    "select count(*) as n_rows, 16 + count(distinct department) + count(distinct status) + count(distinct priority) "
    "as vector_size, count(*) as n_finite from workflows"
))
def q_prep_features(spark, sf):
    from pyspark.ml.functions import vector_to_array

    w, prep = _fitted_prep(spark, sf)
    v = prep.transform(w).select(vector_to_array("features").alias("v"))
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("v")).cast("bigint").alias("vector_size"),
        F.count_if(finite).alias("n_finite"),
    )


_ALLOC_CTE = """
cnt as (select risk_label, count(*) as n_c from workflows_labeled group by 1),
tot as (select sum(n_c) as n, sum(n_c) - cast(ceil(0.2e0 * sum(n_c)) as bigint) as n_train from cnt),
alloc0 as (select risk_label, n_c, n_train * n_c * 1.0e0 / n as ex, floor(n_train * n_c * 1.0e0 / n) as fl from cnt, tot),
alloc as (select risk_label, cast(fl as bigint) + case when row_number() over (order by ex - fl desc, risk_label)
  <= (select n_train from tot) - (select sum(fl) from alloc0) then 1 else 0 end as k_c from alloc0),
ranked as (select workflow_id, risk_label, k, row_number() over (partition by risk_label order by skey, workflow_id) as rn
  from (select *, cast(substr(workflow_id, 4) as bigint) as k, {key} as skey from workflows_labeled)),
splits as (select r.workflow_id, r.risk_label, r.k, case when rn <= k_c then 'train' else 'test' end as split
  from ranked r join alloc using (risk_label))
""".format(key=_PORTABLE_KEY_SQL)


def _portable_split(spark, sf):
    lab = written(tables.workflows_labeled(spark, sf), "labeled")
    return M.stratified_split(lab, 0.2, order_key=_portable_key(lab))


@register("stratified_split", O.with_ctes("select workflow_id, split from splits", labeled=True, extra=_ALLOC_CTE))
def q_stratified_split(spark, sf):
    lab = tables.workflows_labeled(spark, sf)
    return M.with_split(lab, 0.2, order_key=_portable_key(lab)).select("workflow_id", "split")


@register("class_weights", O.with_ctes(
    "select risk_label, n_c as n, round((select sum(n_c) from cnt) * 1.0e0 / ((select count(*) from cnt) * n_c), 9) "
    "as weight from cnt",
    labeled=True, extra="cnt as (select risk_label, count(*) as n_c from workflows_labeled group by 1)",
))
def q_class_weights(spark, sf):
    counts = M.class_counts(tables.workflows_labeled(spark, sf))
    w = M.balanced_weights(counts)
    rows = [(c, counts[c], w[c]) for c in sorted(counts)]
    return spark.createDataFrame(rows, "risk_label string, n bigint, weight double").select("risk_label", "n", _r("weight", 9))


_DUMMY_U_SQL = "((k * 7919 + 13) % 10007) / 10007.0e0"


@register("dummy_predictions", O.with_ctes(
    f"select workflow_id, case when {_DUMMY_U_SQL} < p_high then 'high' when {_DUMMY_U_SQL} < p_high + p_low then 'low' "
    "else 'medium' end as predicted_risk from splits, pri where split = 'test'",
    labeled=True,
    extra=_ALLOC_CTE.strip() + ",\npri as (select count_if(risk_label = 'high') * 1.0e0 / count(*) as p_high, "
    "count_if(risk_label = 'low') * 1.0e0 / count(*) as p_low from splits where split = 'train')",
))
def q_dummy_predictions(spark, sf):
    train, test = _portable_split(spark, sf)
    k = tables.workflow_key(test)
    test = test.withColumn("u", ((k * F.lit(7919) + F.lit(13)) % F.lit(10007)) / F.lit(10007.0))
    model = M.dummy_pipeline(uniform_col="u").fit(train)
    return M.predict(model, test).select("workflow_id", "predicted_risk")


@register("dummy_strategies", O.with_ctes(
    "select workflow_id, 'most_frequent' as strategy, top as predicted_risk, 1.0e0 as probability from splits, pri where split = 'test' "
    "union all select workflow_id, 'prior', top, round(top_share, 9) from splits, pri where split = 'test' "
    f"union all select workflow_id, 'uniform', case when {_DUMMY_U_SQL} < 1.0e0 / 3 then 'high' when {_DUMMY_U_SQL} < 2.0e0 / 3 then 'low' "
    "else 'medium' end, round(1.0e0 / 3, 9) from splits where split = 'test'",
    labeled=True,
    extra=_ALLOC_CTE.strip() + ",\npri as (select risk_label as top, count(*) * 1.0e0 / (select count(*) from splits where split = 'train') as top_share "
    "from splits where split = 'train' group by 1 order by count(*) desc, 1 limit 1)",
))
def q_dummy_strategies(spark, sf):
    """M5: the other strategies, saved and loaded (S8): prediction and its probability for every test row."""
    train, test = _portable_split(spark, sf)
    k = tables.workflow_key(test)
    test = test.withColumn("u", ((k * F.lit(7919) + F.lit(13)) % F.lit(10007)) / F.lit(10007.0))
    out = None
    for strategy in ("most_frequent", "prior", "uniform"):
        path = scratch_path(spark, f"dummy-{strategy}")
        IO.save_model(M.dummy_pipeline("u", strategy).fit(train), path)
        p = M.predict(IO.load_model(spark, path), test).select(
            "workflow_id", F.lit(strategy).alias("strategy"), "predicted_risk",
            F.round(F.element_at("risk_probability", F.col("predicted_risk")), 9).alias("probability"),
        )
        out = p if out is None else out.unionByName(p)
    return out


def _trained(spark, sf):
    """Folder of the models trained on this table: random_forest, logistic_regression, metadata.json.

    It lies in the shared folder under a signature of the table's files, so that the model-backed queries
    share one training and a changed table is trained anew; metadata.json is written last."""
    from ..session import ensure_checkpoint_dir
    from .train import train_and_evaluate

    base = f"{ensure_checkpoint_dir(spark)}/opsrisk-trained/{tables.signature(spark, sf)}"
    if not IO.is_complete(spark, f"{base}/metadata.json"):
        result = train_and_evaluate(tables.workflows_labeled(spark, sf))
        IO.save_model(result.model, f"{base}/random_forest")
        IO.save_model(result.baseline_models["logistic_regression"], f"{base}/logistic_regression")
        IO.save_json(spark, result.metadata, f"{base}/metadata.json")
    return base


def training_metadata(spark, sf) -> dict:
    """Metadata document of the queries' training."""
    return IO.load_json(spark, f"{_trained(spark, sf)}/metadata.json")


def _model_rows(spark, sf, name):
    """Counts over a saved model's predictions for all labelled workflows, and whether they are better than a constant:
    a constant has at most one right class, so its F1 macro is at most 1/3."""
    from .pipeline import score

    path = scratch_path(spark, f"scored-{name}")
    model = IO.load_model(spark, f"{_trained(spark, sf)}/{name}")
    cols = ("workflow_id", "risk_label", "predicted_risk", "risk_probability", "risk_factors")
    score(tables.workflows_labeled(spark, sf), model).select(*cols).write.parquet(path)
    scored = spark.read.parquet(path)
    above = EV.evaluate_predictions(scored, "risk_label", "predicted_risk").f1_macro > 1 / 3
    total = F.aggregate(F.map_values("risk_probability"), F.lit(0.0), lambda a, x: a + x)
    # the predicted class is the likeliest; of equally likely ones the first by name
    likeliest = F.array_max(F.transform(F.map_entries("risk_probability"), lambda e: F.struct(e["value"].alias("p"), (-F.array_position(F.array(*[F.lit(x) for x in sorted(RISK_LABELS)]), e["key"])).alias("k"))))
    predicted = F.struct(F.element_at("risk_probability", F.col("predicted_risk")).alias("p"), (-F.array_position(F.array(*[F.lit(x) for x in sorted(RISK_LABELS)]), F.col("predicted_risk"))).alias("k"))
    return scored.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("predicted_risk").isin(*RISK_LABELS)).alias("n_valid_label"),
        F.count_if(F.abs(total - F.lit(1.0)) < F.lit(1e-6)).alias("n_prob_sum_one"),
        F.count_if(predicted == likeliest).alias("n_likeliest"),
        F.count_if(F.size("risk_factors") > 0).alias("n_with_factors"),
        F.count_distinct("predicted_risk").alias("n_predicted_labels"),
        F.lit(above).alias("above_constant"),
    )


_INVARIANT_SQL = O.with_ctes(
    "select count(*) as n_rows, count(*) as n_valid_label, count(*) as n_prob_sum_one, count(*) as n_likeliest, count(*) as n_with_factors, "
    "count(distinct risk_label) as n_predicted_labels, true as above_constant from workflows_labeled",
    labeled=True,
)


@register("rf_predictions", _INVARIANT_SQL)
def q_rf_predictions(spark, sf):
    return _model_rows(spark, sf, "random_forest")


@register("lr_predictions", _INVARIANT_SQL)
def q_lr_predictions(spark, sf):
    return _model_rows(spark, sf, "logistic_regression")


@register("train_report", O.with_ctes(
    "select n - cast(ceil(0.2e0 * n) as bigint) as n_train_rows, cast(ceil(0.2e0 * n) as bigint) as n_test_rows, "
    "3 as n_labels, 2 as n_baselines, 200 as n_trees, 30 as max_depth, true as forest_above_dummy from (select count(*) as n from workflows_labeled)",
    labeled=True,
))
def q_train_report(spark, sf):
    md = training_metadata(spark, sf)
    forest = IO.load_model(spark, f"{_trained(spark, sf)}/random_forest").stages[-2]
    above = md["test_metrics"]["f1_macro"] > md["baseline_comparison"]["dummy"]["f1_macro"]
    return spark.createDataFrame(
        [(md["n_train_rows"], md["n_test_rows"], len(md["risk_labels"]), len(md["baseline_comparison"]),
          forest.getNumTrees, forest.getMaxDepth(), above)],
        "n_train_rows bigint, n_test_rows bigint, n_labels int, n_baselines int, n_trees int, max_depth int, forest_above_dummy boolean",
    )


@register("model_comparison", "select * from (values ('logistic_regression', true, true), ('dummy', true, false), "
          "('random_forest (primary)', true, true)) t(model, metrics_in_range, above_dummy)")
def q_model_comparison(spark, sf):
    md = training_metadata(spark, sf)
    v = V.model_comparison(spark, md)
    names = ("accuracy", "f1_macro", "f1_weighted")
    ok, above = F.lit(True), F.lit(True)
    for c in names:
        ok = ok & (F.col(c) >= 0) & (F.col(c) <= 1)
        above = above & (F.col(c) > F.lit(md["baseline_comparison"]["dummy"][c]))
    return v.select("model", ok.alias("metrics_in_range"), above.alias("above_dummy"))


@register("pipeline_counts", _long_sql(DEFAULT_RULE_CONFIG, False) + (
    "select (select count(*) from workflows) as n_predictions, (select count(*) from trig) as n_rule_alerts, "
    "(select count(*) from workflows) as total_workflows"
))
def q_pipeline_counts(spark, sf):
    from .pipeline import run_pipeline

    res = run_pipeline(spark, tables.workflows(spark, sf), model_path=f"{_trained(spark, sf)}/random_forest",
                       generated_at=FIXED_STAMP)
    n_pred = res.predictions.agg(F.count(F.lit(1)).alias("n_predictions"))
    n_alerts = res.alerts.where(F.col("type") != "high_risk_escalation").agg(F.count(F.lit(1)).alias("n_rule_alerts"))
    total = res.kpi_summary["volume"]["total_workflows"]
    both = n_pred.select("n_predictions", F.lit(None).cast("bigint").alias("n_rule_alerts")).unionByName(
        n_alerts.select(F.lit(None).cast("bigint").alias("n_predictions"), "n_rule_alerts")
    )
    return both.agg(F.max("n_predictions").alias("n_predictions"), F.max("n_rule_alerts").alias("n_rule_alerts")).withColumn(
        "total_workflows", F.lit(total).cast("bigint")
    )


@register("pipeline_alerts", ORACLE["alerts_dedup"])
def q_pipeline_alerts(spark, sf):
    """L1 with repeated ids: the rule alerts of a run over two copies of every workflow, row by row."""
    from .pipeline import run_pipeline

    twice = _two_copies(spark, sf).drop("copy")
    res = run_pipeline(spark, twice, model_path=f"{_trained(spark, sf)}/random_forest", generated_at=FIXED_STAMP)
    return res.alerts.where(F.col("type") != "high_risk_escalation")


@register("recommendations_csv_roundtrip", ORACLE["recommendations"])
def q_recommendations_csv_roundtrip(spark, sf):
    """Recommendations saved as CSV and read again."""
    path = scratch_path(spark, "recommendations-csv")
    IO.save_recommendations(q_recommendations(spark, sf), path)
    return IO._read_csv(spark, path, IO.RECOMMENDATIONS_SCHEMA)


@register("saved_run_alerts", ORACLE["pipeline_alerts"])
def q_saved_run_alerts(spark, sf):
    """A run's four outputs saved, reloaded as a whole, and the rule alerts read from them."""
    from .pipeline import output_paths, run_pipeline, save_outputs

    twice = _two_copies(spark, sf).drop("copy")
    res = run_pipeline(spark, twice, model_path=f"{_trained(spark, sf)}/random_forest", generated_at=FIXED_STAMP)
    paths = output_paths(scratch_path(spark, "run"))
    save_outputs(spark, res, paths)
    return IO.load_outputs(spark, paths)["alerts"].where(F.col("type") != "high_risk_escalation")


@register(
    "saved_run_versions",
    f"select 1::bigint as run, * from ({_long_sql(DEFAULT_RULE_CONFIG, True)}{_ALERT_SELECT}) "
    f"union all select 2::bigint as run, * from ({_long_sql(CUSTOM_CONFIG, True)}{_ALERT_SELECT})",
)
def q_saved_run_versions(spark, sf):
    """Two runs under other thresholds published one after the other; both are read, the first by its number."""
    base = scratch_path(spark, "versions")
    flows = _labeled_as_predicted(spark, sf)
    first = None
    for cfg, fmt in ((DEFAULT_RULE_CONFIG, "csv"), (CUSTOM_CONFIG, "parquet")):
        alerts = A.generate_alerts(flows, "predicted_risk", cfg, FIXED_STAMP, dedup=False)
        run = runs.write_table(spark, runs.start(base), "alerts", "alerts", alerts, fmt)
        runs.commit(spark, run)
        first = first or runs.open_run(spark, base)  # held while the second is published
    newest = runs.open_run(spark, base)
    read = lambda r: runs.read_table(spark, r, "alerts").select(F.lit(r.number).cast("bigint").alias("run"), "*")
    return read(first).unionByName(read(newest))


@register("custom_risk_factors", O.with_ctes(
    "select workflow_id, 'medium' as predicted_risk, case when coalesce(error_count > 5, false) then 'many errors' else 'no remark' end as risk_factors from workflows"
))
def q_custom_risk_factors(spark, sf):
    """A caller's model and a caller's factor function."""
    from .pipeline import predict_workflows

    w = tables.workflows(spark, sf)
    model = M.dummy_pipeline(strategy="most_frequent").fit(w.withColumn("risk_label", F.lit("medium")))
    factors = lambda cfg: F.array(F.when(F.col("error_count") > cfg.high_error_threshold, "many errors").otherwise("no remark"))
    got = predict_workflows(spark, w, model=model, risk_factor_fn=factors)
    return got.select("workflow_id", "predicted_risk", F.array_join("risk_factors", "; ").alias("risk_factors"))


# --- risk score and soft labels (P10, P11) ----------------------------------------------------


@register("risk_score", O.with_ctes("select workflow_id, round(risk_score, 9) as risk_score from ws", labeled=True))
def q_risk_score(spark, sf):
    s = tables.with_risk_score(tables.workflows(spark, sf))
    return s.select("workflow_id", _r("risk_score", 9))


@register("soft_labels", O.with_ctes("select workflow_id, risk_label from workflows_labeled", labeled=True))
def q_soft_labels(spark, sf):
    return tables.workflows_labeled(spark, sf).select("workflow_id", "risk_label")
