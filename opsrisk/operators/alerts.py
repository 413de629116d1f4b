"""Alerts and recommendations (A1-A8): rule triggers exploded into rows.

Both outputs come from one ``triggers`` array per workflow (row rules, then
the escalation rule on the predicted risk), so features and rules are
evaluated once per row however many outputs are built from them.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import (
    ALERT_COLUMNS,
    CATEGORY_BY_RULE,
    DEFAULT_RULE_CONFIG,
    MONITOR,
    MONITOR_ACTION,
    MONITOR_SIGNAL,
    NO_ACTION,
    NO_ACTION_ACTION,
    NO_ACTION_SIGNAL,
    RECOMMENDATION_COLUMNS,
    WORKFLOW_ID,
    RuleConfig,
)
from .rules import with_triggers


def run_timestamp() -> str:
    """One UTC ISO-8601 stamp per run (same format as ``datetime.isoformat``)."""
    return datetime.now(timezone.utc).isoformat()


def latest_prediction(predictions: DataFrame, order_col: str | None = None) -> DataFrame:
    """A4: one predicted risk per workflow id; the last row (by ``order_col``) wins.

    Without ``order_col`` there is no last row: an id with several predictions fails the job.
    Both aggregate partially on the map side, so a hot id costs one row per task."""
    if order_col is None:
        one = predictions.groupBy(WORKFLOW_ID).agg(F.count(F.lit(1)).alias("n"), F.max("predicted_risk").alias("p"))
        several = F.raise_error(F.concat(F.lit("several predictions and no order column for workflow "), F.col(WORKFLOW_ID)))
        return one.select(WORKFLOW_ID, F.when(F.col("n") > 1, several.cast("string")).otherwise(F.col("p")).alias("predicted_risk"))
    return predictions.groupBy(WORKFLOW_ID).agg(F.max_by("predicted_risk", order_col).alias("predicted_risk"))


def attach_predictions(df: DataFrame, predictions: DataFrame, order_col: str | None = None) -> DataFrame:
    """Left join of the latest prediction per id; missing ids get null (no escalation)."""
    base = df.drop("predicted_risk") if "predicted_risk" in df.columns else df
    return base.join(latest_prediction(predictions, order_col), WORKFLOW_ID, "left")


def alert_rows(scored: DataFrame, generated_at: str, keep: tuple[str, ...] = ()) -> DataFrame:
    t = F.col("t")
    # explode_outer + filter: see rules.triggers_long (no inferred size() filter).
    exploded = scored.select(WORKFLOW_ID, *keep, F.explode_outer("triggers").alias("t")).where(F.col("t").isNotNull())
    return exploded.select(
        F.concat(F.lit("ALT-"), F.col(WORKFLOW_ID), F.lit("-"), t["rule_type"]).alias("alert_id"),
        F.col(WORKFLOW_ID),
        t["severity"].alias("severity"),
        t["rule_type"].alias("type"),
        t["message"].alias("message"),
        t["recommended_action"].alias("recommended_action"),
        F.lit(generated_at).alias("generated_at"),
        *keep,
    )


def alerts_from_scored(
    scored: DataFrame, generated_at: str | None = None, dedup: bool = False, order_col: str | None = None
) -> DataFrame:
    """A1-A3 over a frame that already has ``triggers``.

    ``dedup`` keeps the first alert per (workflow_id, type) in ``order_col``
    order; skip it when ids are known unique (validated input)."""
    stamp = generated_at or run_timestamp()
    if not dedup:
        return alert_rows(scored, stamp).select(*ALERT_COLUMNS)
    if order_col is None:
        raise ValueError("dedup needs an order column that fixes which duplicate row comes first")
    rows = alert_rows(scored, stamp, keep=(order_col,))
    first = rows.groupBy(WORKFLOW_ID, "type").agg(
        F.min_by(F.struct(*ALERT_COLUMNS), F.col(order_col)).alias("a")
    )
    return first.select("a.*")


def generate_alerts(
    df: DataFrame,
    predictions: DataFrame | str | None = None,
    cfg: RuleConfig = DEFAULT_RULE_CONFIG,
    generated_at: str | None = None,
    dedup: bool = True,
    order_col: str | None = None,
) -> DataFrame:
    """A2: alerts for every rule that fires, one run stamp for all.

    ``predictions`` is a column name already on ``df``, or a (workflow_id,
    predicted_risk[, order_col]) frame looked up by id (A4: the last row in
    ``order_col`` order wins), or None (no R7). ``order_col`` on ``df`` fixes
    which duplicate row comes first for the dedup (A3); without it the rows are
    numbered as ``df`` delivers them, before any join: the scan order of a scanned table.
    """
    dedup_col = order_col if order_col in df.columns else None
    if dedup and dedup_col is None:
        dedup_col = "_row_pos"
        df = df.withColumn(dedup_col, F.monotonically_increasing_id())
    base, pred_col = _with_prediction(df, predictions, order_col)
    return alerts_from_scored(with_triggers(base, cfg, pred_col), generated_at, dedup, dedup_col)


def _with_prediction(df: DataFrame, predictions, order_col: str | None):
    if predictions is None:
        return df, None
    if isinstance(predictions, str):
        return df, predictions
    return attach_predictions(df, predictions, order_col if order_col in predictions.columns else None), "predicted_risk"


def _category_map() -> Column:
    return F.create_map(*[x for k, v in CATEGORY_BY_RULE.items() for x in (F.lit(k), F.lit(v))])


def recommendation_items(predicted_risk: Column | None) -> Column:
    """Array of (category, message, signal), at least one per row."""
    cmap = _category_map()
    recs = F.transform(
        F.col("triggers"),
        lambda t: F.struct(
            cmap[t["rule_type"]].alias("category"),
            t["recommended_action"].alias("message"),
            t["message"].alias("signal"),
        ),
    )
    medium = predicted_risk.eqNullSafe(F.lit("medium")) if predicted_risk is not None else F.lit(False)
    fallback = F.when(
        medium,
        F.struct(F.lit(MONITOR).alias("category"), F.lit(MONITOR_ACTION).alias("message"), F.lit(MONITOR_SIGNAL).alias("signal")),
    ).otherwise(
        F.struct(F.lit(NO_ACTION).alias("category"), F.lit(NO_ACTION_ACTION).alias("message"), F.lit(NO_ACTION_SIGNAL).alias("signal"))
    )
    return F.when(F.size("triggers") == 0, F.array(fallback)).otherwise(recs)


def recommendations_from_scored(scored: DataFrame, predicted_risk: str | None = None) -> DataFrame:
    pred = F.col(predicted_risk) if predicted_risk else None
    # Never empty, so explode_outer only avoids the inferred size() filter.
    return scored.select(WORKFLOW_ID, F.explode_outer(recommendation_items(pred)).alias("r")).select(
        WORKFLOW_ID, "r.category", "r.message", "r.signal"
    ).select(*RECOMMENDATION_COLUMNS)


def generate_recommendations(
    df: DataFrame, predictions: DataFrame | str | None = None, cfg: RuleConfig = DEFAULT_RULE_CONFIG, order_col: str | None = None
) -> DataFrame:
    """Every row yields ≥1 recommendation; not deduplicated."""
    base, pred_col = _with_prediction(df, predictions, order_col)
    scored = with_triggers(base, cfg, pred_col)
    return recommendations_from_scored(scored, pred_col)
