"""Row rules R1-R6 against a plain-Python model of the spec (conditions, order, message text)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st

from opsrisk.operators.rules import with_triggers
from opsrisk.schema import LABELED_WORKFLOW_SCHEMA, RuleConfig

CFG = RuleConfig()


def _ratio(n, d):
    if n is None or d is None or math.isnan(n) or math.isnan(d) or d == 0:
        return 0.0
    r = n / d
    return 0.0 if math.isnan(r) or math.isinf(r) else r


def _ge(x, t):
    return x is not None and not math.isnan(x) and x >= t


HUGE = "<huge>"  # beyond 2**53 percent only a non-null number is promised (see README)


def _pct(x):
    """Python's '.0%' below 2**53 percent."""
    if x is None or math.isnan(x):
        return "nan%"
    if abs(x * 100) >= 2**53:
        return HUGE
    return format(x, ".0%")


def _same(got: str | None, want: str) -> bool:
    if HUGE not in want:
        return got == want
    head, tail = want.split(HUGE, 1)
    return got is not None and got.startswith(head) and got.endswith(tail) and HUGE not in tail


def model(r):
    u = _ratio(r["elapsed_hours"], r["sla_hours"])
    steps = None if r["manual_steps"] is None or r["automated_steps"] is None else r["manual_steps"] + r["automated_steps"]
    m = _ratio(r["manual_steps"], steps)
    rr = _ratio(r["rework_count"], r["transaction_volume"])
    a = r["automation_score"]
    pct = _pct
    out = []
    if u >= 1.0:
        out.append(("sla_breach", f"SLA breached: utilization at {pct(u)} of the allotted window"))
    elif u >= CFG.sla_warning_threshold:
        out.append(("approaching_sla", f"SLA utilization {pct(u)} at or above the {CFG.sla_warning_threshold:.0%} warning threshold"))
    if _ge(r["error_count"], CFG.high_error_threshold):
        out.append(("high_error", f"Error count {int(r['error_count'])} at or above threshold {CFG.high_error_threshold}"))
    if rr >= CFG.high_rework_rate:
        out.append(("high_rework", f"Rework rate {pct(rr)} at or above the {CFG.high_rework_rate:.0%} threshold"))
    if m >= CFG.high_manual_ratio or (a is not None and not math.isnan(a) and a <= CFG.low_automation_threshold):
        out.append(("manual_automation_opportunity",
                    f"Manual step ratio {pct(m)} / automation score {pct(a)} indicate an automation opportunity"))
    if _ge(r["pending_items"], CFG.backlog_threshold):
        out.append(("backlog_pressure", f"Pending items {int(r['pending_items'])} at or above backlog threshold {CFG.backlog_threshold}"))
    return out


_small = st.one_of(st.none(), st.integers(0, 200))
_pos = st.one_of(st.none(), st.sampled_from([0.0, float("nan")]), st.floats(0, 300, allow_nan=False))
_row = st.fixed_dictionaries({
    "sla_hours": _pos, "elapsed_hours": _pos, "manual_steps": _small, "automated_steps": _small,
    "automation_score": st.one_of(st.none(), st.just(float("nan")), st.floats(0, 1), st.sampled_from([0.3, 0.295])),
    "error_count": _small, "rework_count": _small, "transaction_volume": _small, "pending_items": _small,
})


@settings(max_examples=5, deadline=None)
@given(st.lists(_row, min_size=30, max_size=120))
def test_rules_match_model(spark, rows):
    cols = [f.name for f in LABELED_WORKFLOW_SCHEMA.fields]
    data = [tuple({**r, "workflow_id": str(i)}.get(c) for c in cols) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, LABELED_WORKFLOW_SCHEMA)
    got = {r["workflow_id"]: [(t["rule_type"], t["message"]) for t in r["triggers"]]
           for r in with_triggers(df).select("workflow_id", "triggers").collect()}
    for i, r in enumerate(rows):
        want = model(r)
        have = got[str(i)]
        assert [t for t, _ in have] == [t for t, _ in want], r
        assert all(_same(h, w) for (_, h), (_, w) in zip(have, want)), (r, have, want)
