"""DuckDB-runnable SQL for every registered query (the correctness oracle).

Each statement starts from the driver tables and re-derives the workflow
views as CTEs, so the oracle is independent of the Spark code. Doubles that
come out of aggregates or transcendental functions are rounded on both sides.
"""

from __future__ import annotations

# --- fixture views -----------------------------------------------------------

WORKFLOWS_CTE = """
li as (
 select l_orderkey,
  count(*) n_lines,
  cast(sum(case when l_returnflag='R' then 1 else 0 end) as bigint) n_r,
  cast(sum(case when l_returnflag<>'N' then 1 else 0 end) as bigint) manual_steps,
  cast(sum(case when l_returnflag='N' then 1 else 0 end) as bigint) automated_steps,
  cast(sum(l_quantity) as bigint) qty,
  cast(sum(case when l_linestatus='O' then l_quantity else 0 end) as bigint) open_qty,
  cast(sum(case when l_linestatus='F' then 1 else 0 end) as double) n_f,
  cast(sum(case when l_discount<=0.03 then 1 else 0 end) as double) n_lowdisc,
  max(l_shipdate) last_ship
 from lineitem group by l_orderkey),
workflows as (
select concat('WF-', cast(o_orderkey as varchar)) workflow_id,
 case o_orderkey % 3 when 0 then 'Invoice Processing' when 1 then 'Vendor Approval' else 'Order Fulfillment' end workflow_name,
 c_mktsegment department,
 case when o_orderkey % 20 = 0 then 'cancelled' when o_orderkey % 10 = 1 then 'on_hold' when o_orderstatus='O' then 'open' when o_orderstatus='P' then 'in_progress' else 'completed' end status,
 case substr(o_orderpriority,1,1) when '1' then 'urgent' when '2' then 'high' when '3' then 'medium' else 'low' end priority,
 cast(24*(1+o_orderkey%7) as double) sla_hours,
 cast((o_orderkey*37)%(28*(1+o_orderkey%7)) as double) elapsed_hours,
 manual_steps, automated_steps,
 n_f/n_lines automation_score,
 manual_steps error_count, n_r*3 rework_count, qty transaction_volume,
 5.0e0*qty/n_lines avg_handling_time_minutes,
 open_qty pending_items, n_lowdisc/n_lines completion_rate,
 o_orderdate created_at, greatest(o_orderdate,last_ship) updated_at
from orders join li on o_orderkey=l_orderkey join customer on o_custkey=c_custkey)
"""

LABELED_CTE = """
wk as (select *, cast(substr(workflow_id,4) as bigint) k,
  elapsed_hours/sla_hours u0, manual_steps*1.0e0/(manual_steps+automated_steps) m0,
  error_count*1.0e0/transaction_volume er0, rework_count*1.0e0/transaction_volume rr0,
  pending_items*1.0e0/transaction_volume bp0 from workflows),
ws as (select *, 1.0e0/(1.0e0+exp(-(2.2e0*(u0-0.7e0)+1.8e0*(m0-0.5e0)+7.5e0*er0+7.5e0*rr0+2.4e0*bp0
  -1.5e0*(automation_score-0.5e0)-1.0e0*(completion_rate-0.5e0)-1.2e0))) risk_score,
  (k*7919 % 1000)/1000.0e0+0.0005e0 draw from wk),
we as (select *, exp(-abs(risk_score-0.15e0)/0.35e0) el, exp(-abs(risk_score-0.50e0)/0.35e0) em,
  exp(-abs(risk_score-0.85e0)/0.35e0) eh from ws),
workflows_labeled as (
select * exclude (k, u0, m0, er0, rr0, bp0, risk_score, draw, el, em, eh),
  case when draw < el/(el+em+eh) then 'low' when draw < (el+em)/(el+em+eh) then 'medium' else 'high' end risk_label
from we)
"""

DIRTY_CTE = """
dk as (select *, cast(substr(workflow_id,4) as bigint) k from workflows),
workflows_dirty as (
select case when k%97=0 then 'WF-DUP' when k%101=0 then null else workflow_id end workflow_id,
  workflow_name, department,
  case when k%71=0 then 'mystery_status' when k%67=0 then null else status end status, priority,
  case when k%89=0 then 0.0e0 when k%83=0 then -5.0e0 else sla_hours end sla_hours,
  case when k%53=0 then null else elapsed_hours end elapsed_hours, manual_steps, automated_steps,
  case when k%73=0 then -0.1e0 else automation_score end automation_score,
  case when k%59=0 then -1 else error_count end error_count, rework_count,
  case when k%47=0 then 0 else transaction_volume end transaction_volume,
  avg_handling_time_minutes, pending_items,
  case when k%79=0 then 90.0e0 else completion_rate end completion_rate, created_at,
  case when k%61=0 then created_at - interval '1' day else updated_at end updated_at
from dk)
"""

# Engineered ratios (P1-P7) over a view named by {src}.
ENGINEERED_CTE = """
{name} as (
select *,
 coalesce(case when isfinite(elapsed_hours*1.0e0/nullif(sla_hours,0)) then elapsed_hours*1.0e0/nullif(sla_hours,0) end, 0.0e0) sla_utilization,
 coalesce(case when isfinite(manual_steps*1.0e0/nullif(manual_steps+automated_steps,0)) then manual_steps*1.0e0/nullif(manual_steps+automated_steps,0) end, 0.0e0) manual_step_ratio,
 coalesce(case when isfinite(error_count*1.0e0/nullif(transaction_volume,0)) then error_count*1.0e0/nullif(transaction_volume,0) end, 0.0e0) error_rate,
 coalesce(case when isfinite(rework_count*1.0e0/nullif(transaction_volume,0)) then rework_count*1.0e0/nullif(transaction_volume,0) end, 0.0e0) rework_rate,
 coalesce(case when isfinite(pending_items*1.0e0/nullif(transaction_volume,0)) then pending_items*1.0e0/nullif(transaction_volume,0) end, 0.0e0) backlog_pressure
from {src})
"""


def with_ctes(body: str, *, labeled: bool = False, dirty: bool = False, engineered: str | None = None, extra: str = "") -> str:
    """``with`` the fixture views (+ an engineered view over ``engineered``) then ``body``."""
    parts = [WORKFLOWS_CTE.strip()]
    if labeled:
        parts.append(LABELED_CTE.strip())
    if dirty:
        parts.append(DIRTY_CTE.strip())
    if engineered:
        parts.append(ENGINEERED_CTE.format(name="eng", src=engineered).strip())
    if extra:
        parts.append(extra.strip())
    return "with " + ",\n".join(parts) + "\n" + body.strip()


# --- rules in SQL ---------------------------------------------------------------

_ACTIONS = {
    "sla_breach": "Escalate to the process owner and expedite remaining steps immediately",
    "approaching_sla": "Monitor closely and prioritize remaining steps before the SLA is breached",
    "high_error": "Investigate the root cause of the elevated error count",
    "high_rework": "Review rework triggers and quality checkpoints",
    "manual_automation_opportunity": "Assess this workflow for automation to reduce manual effort",
    "backlog_pressure": "Rebalance workload to reduce the pending item backlog",
    "high_risk_escalation": "Escalate to an operations manager for review",
}


def sql_pct(x: str) -> str:
    r = f"round_even(({x})*100.0e0, 0)"
    return (
        f"(case when ({x}) is null or isnan({x}) then 'nan%' when ({x}) = 'infinity'::double then 'inf%' "
        f"when ({x}) = '-infinity'::double then '-inf%' else "
        f"(case when {r} = 0 and starts_with(cast(({x}) as varchar), '-') then '-' else '' end) || "
        f"cast(cast({r} as bigint) as varchar) || '%' end)"
    )


def sql_int(x: str) -> str:
    return f"cast(trunc(cast({x} as double)) as bigint)"


def _lit(v: float) -> str:
    return f"{float(v)!r}e0" if "e" not in repr(float(v)) else repr(float(v))


def triggers_sql(cfg, src: str = "eng", pred: str | None = None, extra_cols: str = "") -> str:
    """Long-form triggers (one row per fired rule) over an engineered view."""
    warn, err, rew, man, auto, back = (
        cfg.sla_warning_threshold,
        cfg.high_error_threshold,
        cfg.high_rework_rate,
        cfg.high_manual_ratio,
        cfg.low_automation_threshold,
        cfg.backlog_threshold,
    )
    p = lambda v: format(v, ".0%")
    sel = "select workflow_id, " + (extra_cols + ", " if extra_cols else "") + "{rank} rule_rank, '{rule}' rule_type, '{sev}' severity, {msg} message, '{act}' recommended_action from {src} where {cond}"
    parts = [
        sel.format(rank=1, rule="sla_breach", sev="critical", src=src, act=_ACTIONS["sla_breach"],
                   msg=f"'SLA breached: utilization at ' || {sql_pct('sla_utilization')} || ' of the allotted window'",
                   cond="sla_utilization >= 1.0e0"),
        sel.format(rank=2, rule="approaching_sla", sev="warning", src=src, act=_ACTIONS["approaching_sla"],
                   msg=f"'SLA utilization ' || {sql_pct('sla_utilization')} || ' at or above the {p(warn)} warning threshold'",
                   cond=f"sla_utilization < 1.0e0 and sla_utilization >= {_lit(warn)}"),
        sel.format(rank=3, rule="high_error", sev="warning", src=src, act=_ACTIONS["high_error"],
                   msg=f"'Error count ' || {sql_int('error_count')} || ' at or above threshold {err}'",
                   cond=f"error_count >= {_lit(err)}"),
        sel.format(rank=4, rule="high_rework", sev="warning", src=src, act=_ACTIONS["high_rework"],
                   msg=f"'Rework rate ' || {sql_pct('rework_rate')} || ' at or above the {p(rew)} threshold'",
                   cond=f"rework_rate >= {_lit(rew)}"),
        sel.format(rank=5, rule="manual_automation_opportunity", sev="info", src=src,
                   act=_ACTIONS["manual_automation_opportunity"],
                   msg=f"'Manual step ratio ' || {sql_pct('manual_step_ratio')} || ' / automation score ' || "
                   f"{sql_pct('automation_score')} || ' indicate an automation opportunity'",
                   cond=f"(coalesce(manual_step_ratio >= {_lit(man)}, false) or coalesce(automation_score <= {_lit(auto)}, false))"),
        sel.format(rank=6, rule="backlog_pressure", sev="warning", src=src, act=_ACTIONS["backlog_pressure"],
                   msg=f"'Pending items ' || {sql_int('pending_items')} || ' at or above backlog threshold {back}'",
                   cond=f"pending_items >= {_lit(back)}"),
    ]
    if pred:
        parts.append(
            sel.format(rank=7, rule="high_risk_escalation", sev="critical", src=src, act=_ACTIONS["high_risk_escalation"],
                       msg="'Model predicts high risk for this workflow'", cond=f"{pred} = 'high'")
        )
    return "\nunion all\n".join(parts)
