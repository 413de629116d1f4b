"""Report views over pipeline outputs.

All are lazy DataFrame functions. Joins are keyed on workflow_id and left to
the planner: AQE broadcasts a side only when its measured size is under the
broadcast threshold, else sort-merge with skew splitting.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RISK_LABELS, WORKFLOW_ID

FILTER_DIMENSIONS = ("department", "status", "priority")
MONITOR_COLUMNS = (
    "workflow_id",
    "department",
    "status",
    "priority",
    "predicted_risk",
    "risk_probability_low",
    "risk_probability_medium",
    "risk_probability_high",
    "risk_factors",
)


def enrich_predictions(predictions: DataFrame, workflows: DataFrame | None) -> DataFrame:
    """Left join of department/status/priority by id; unchanged when the raw table is absent."""
    if workflows is None:
        return predictions
    dims = workflows.select(WORKFLOW_ID, *FILTER_DIMENSIONS)
    return predictions.join(dims, WORKFLOW_ID, "left")


def _in(col: str, values: Iterable[str] | None) -> Column:
    """Membership in a selected set; None means every option (still excludes null); empty → nothing."""
    if values is None:
        return F.col(col).isNotNull()
    vals = list(values)
    if not vals:
        return F.lit(False)
    return F.coalesce(F.col(col).isin(*vals), F.lit(False))


def filter_predictions(
    df: DataFrame,
    risk: Sequence[str] | None = None,
    department: Sequence[str] | None = None,
    status: Sequence[str] | None = None,
    priority: Sequence[str] | None = None,
) -> DataFrame:
    """Keep rows whose risk and (present) dimension values are all selected."""
    cond = _in("predicted_risk", list(RISK_LABELS) if risk is None else risk)
    for col, sel in (("department", department), ("status", status), ("priority", priority)):
        if col in df.columns:
            cond = cond & _in(col, sel)
    return df.where(cond)


def filter_options(df: DataFrame) -> DataFrame:
    """Distinct non-null values per filter dimension present, as (column, value), sorted."""
    dims = [d for d in FILTER_DIMENSIONS if d in df.columns]
    pairs = F.array(*[F.struct(F.lit(d).alias("column"), F.col(d).cast("string").alias("value")) for d in dims])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.column", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("column", "value")
    )


def restrict_to_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose workflow_id is in ``ids`` (left semi join; duplicates in ids are harmless)."""
    return df.join(ids.select(WORKFLOW_ID), WORKFLOW_ID, "left_semi")


def executive_overview(workflows_kpis: DataFrame, filtered: DataFrame) -> DataFrame:
    """J5+J6 in one row: unfiltered total and breach rate, filtered count, high count, per-label counts.

    ``workflows_kpis`` is a 1-row frame with total_workflows and sla_breach_rate."""
    f = filtered.agg(
        F.count(F.lit(1)).alias("filtered_workflows"),
        *[F.count_if(F.col("predicted_risk") == F.lit(label)).alias(f"risk_{label}") for label in RISK_LABELS],
    ).withColumn("high_risk_filtered", F.col("risk_high"))
    # Both sides are single rows: a union + max merges them without a join.
    k = workflows_kpis.select("total_workflows", "sla_breach_rate")
    cols = ["total_workflows", "sla_breach_rate", "filtered_workflows", "high_risk_filtered"] + [f"risk_{x}" for x in RISK_LABELS]
    both = k.unionByName(f, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in cols])


def risk_monitor(filtered: DataFrame, top_k: int | None = None) -> DataFrame:
    """J7+P13: display columns present (fixed order), sorted by high-risk probability
    descending (else workflow_id descending), nulls last; ``top_k`` keeps the head only."""
    cols = [c for c in MONITOR_COLUMNS if c in filtered.columns]
    key = "risk_probability_high" if "risk_probability_high" in filtered.columns else WORKFLOW_ID
    # workflow_id breaks ties: a deterministic order, and the range partitioner can
    # spread a hot probability value over many tasks instead of one
    order = [F.col(key).desc_nulls_last()] + ([F.col(WORKFLOW_ID).desc()] if key != WORKFLOW_ID else [])
    out = filtered.select(*cols).orderBy(*order)
    return out.limit(top_k) if top_k is not None else out


def alert_severity_counts(alerts: DataFrame) -> DataFrame:
    """(severity, n)."""
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    """Alerts sorted by severity text. Severity has three values, so (workflow_id,
    type) are added as tiebreaks: range partitions then split each severity evenly."""
    keys = ["severity"] + [c for c in (WORKFLOW_ID, "type") if c in alerts.columns]
    return alerts.orderBy(*keys)


def recommendation_category_counts(recs: DataFrame) -> DataFrame:
    """(category, n)."""
    return recs.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def model_comparison(spark: SparkSession, metadata: dict) -> DataFrame:
    """Baselines then the primary model: model, accuracy, f1_macro, f1_weighted."""
    rows = [
        (name, float(m["accuracy"]), float(m["f1_macro"]), float(m["f1_weighted"]))
        for name, m in metadata["baseline_comparison"].items()
    ]
    t = metadata["test_metrics"]
    rows.append(("random_forest (primary)", float(t["accuracy"]), float(t["f1_macro"]), float(t["f1_weighted"])))
    return spark.createDataFrame(rows, "model string, accuracy double, f1_macro double, f1_weighted double")


def confusion_matrix_view(cm_long: DataFrame) -> DataFrame:
    """(actual, low, medium, high) from long (actual, predicted, n) cells."""
    return (
        cm_long.groupBy("actual")
        .pivot("predicted", list(RISK_LABELS))
        .agg(F.sum("n"))
        .na.fill(0, list(RISK_LABELS))
    )
