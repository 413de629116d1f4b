"""Incremental KPIs (K1-K9): a mergeable state, saved for each input batch.

The state of any set of rows is a small table: one row for each value of status,
department, priority and risk label, and one for all rows, with counts and sums.
States of disjoint sets add up, so a new file costs a scan of that file only;
the KPIs come from the sum of all saved states.

Sums are decimals (12 places), which add up to the same number in any order and
any cut: the KPIs of merged states equal those of the whole table exactly.
Values that no such decimal holds (infinite, or beyond 1e16) are summed apart as
doubles.

A batch is saved under its name, once: its folder counts when it was written to
its end, a batch that is there already is not added again, and one that died
half way is written anew.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ratios import as_double
from ..schema import DEFAULT_RULE_CONFIG, RISK_LABELS, RuleConfig
from ..sources.files import _fs_path, is_complete, path_exists
from .features import ensure_features
from .kpis import EFFICIENCY_COLUMNS, SLA_METRICS, VOLUME_DIMENSIONS, _breach, _rate

TOTAL, RISK = "total", "risk"
_MEANS = ("sla_utilization", *EFFICIENCY_COLUMNS.values())
_DECIMAL = "decimal(28,12)"
_COUNTS = ("n", "breach", "approaching", *[f"n_{c}" for c in _MEANS])
STATE_SCHEMA = T.StructType(
    [T.StructField("dimension", T.StringType()), T.StructField("value", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in _COUNTS]
    + [T.StructField(f"s_{c}", T.DecimalType(38, 12)) for c in _MEANS]
    + [T.StructField(f"x_{c}", T.DoubleType()) for c in _MEANS]
)


def partial_state(df: DataFrame, label_col: str | None = None, cfg: RuleConfig = DEFAULT_RULE_CONFIG) -> DataFrame:
    """State of the rows of ``df`` (STATE_SCHEMA): one pass, folded on the map side.

    ``cfg`` must be the same for all states that are merged. Null values of a dimension have no row; the row of ``total`` counts all. An
    empty table has no rows. Of values that are null or not a number neither count nor sum is kept, as in an average.
    """
    breach, approaching = _breach(cfg)
    pair = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
    pairs = [pair(TOTAL, F.lit("all")), *[pair(d, F.col(d)) for d in VOLUME_DIMENSIONS]]
    pairs += [pair(RISK, F.col(label_col))] if label_col is not None else []
    values = [as_double(c).alias(c) for c in _MEANS]
    flat = ensure_features(df).select(F.explode(F.array(*pairs)).alias("p"), breach.alias("b"), approaching.alias("a"), *values)
    exact = {c: F.col(c).try_cast(_DECIMAL) for c in _MEANS}
    return (
        flat.select("p.dimension", "p.value", "b", "a", *_MEANS)
        .where(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("b").alias("breach"),
            F.count_if("a").alias("approaching"),
            *[F.count(c).alias(f"n_{c}") for c in _MEANS],
            *[F.sum(exact[c]).cast("decimal(38,12)").alias(f"s_{c}") for c in _MEANS],
            *[F.sum(F.when(exact[c].isNull(), F.col(c))).alias(f"x_{c}") for c in _MEANS],
        )
    )


def merge_states(state: DataFrame) -> DataFrame:
    """Rows of several states (a union of them) added up; the result is a state again."""
    sums = [F.sum(c).alias(c) for c in _COUNTS] + [F.sum(f"s_{c}").cast("decimal(38,12)").alias(f"s_{c}") for c in _MEANS]
    return state.groupBy("dimension", "value").agg(*sums, *[F.sum(f"x_{c}").alias(f"x_{c}") for c in _MEANS])


def _mean(c: str) -> Column:
    total = F.coalesce(F.col(f"s_{c}").cast("double"), F.lit(0.0)) + F.coalesce(F.col(f"x_{c}"), F.lit(0.0))
    return F.when(F.col(f"n_{c}") > 0, total / F.col(f"n_{c}"))


def metrics_of_state(state: DataFrame, labels: bool = False) -> DataFrame:
    """K9's (metric, value) rows of a state, the rows of kpis.kpi_metrics_long; ``labels``: with the risk labels' counts and shares."""
    per_label = [(label, F.when((F.col("dimension") == RISK) & (F.col("value") == label), F.col("n"))) for label in RISK_LABELS]
    total = F.col("dimension") == TOTAL
    kept = [*_COUNTS, *[f"s_{c}" for c in _MEANS], *[f"x_{c}" for c in _MEANS]]
    # one row: of the total and of each label there is one row at most
    one = merge_states(state).agg(
        *[F.max(F.when(total, F.col(c))).alias(c) for c in kept], *[F.coalesce(F.max(c), F.lit(0)).alias(f"risk_{label}") for label, c in per_label]
    )
    one = one.withColumns({c: F.coalesce(c, F.lit(0)) for c in _COUNTS})
    sla = (F.coalesce(_mean("sla_utilization"), F.lit(0.0)), F.col("breach"), _rate(F.col("breach"), F.col("n")), F.col("approaching"), _rate(F.col("approaching"), F.col("n")))
    pairs = [("volume.total_workflows", F.col("n")), *zip((f"sla.{m}" for m in SLA_METRICS), sla)]
    pairs += [(f"efficiency.{m}", _mean(c)) for m, c in EFFICIENCY_COLUMNS.items()]
    for label in RISK_LABELS if labels else ():
        pairs += [(f"risk.counts.{label}", F.col(f"risk_{label}")), (f"risk.shares.{label}", _rate(F.col(f"risk_{label}"), F.col("n")))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in pairs])))


def categories_of_state(state: DataFrame) -> DataFrame:
    """K2-K4, K8 of a state: the rows of kpis.category_table."""
    rows = merge_states(state).where(F.col("dimension").isin(*VOLUME_DIMENSIONS))
    return rows.select("dimension", "value", F.col("n").alias("workflow_count"), _mean("sla_utilization").alias("avg_sla_utilization"), _mean("error_rate").alias("avg_error_rate"))


# --- saved states


def _batch_path(path: str, batch: str) -> str:
    return f"{path.rstrip('/')}/{quote('b-' + batch, safe='-._')}"


def add_batch(df: DataFrame, path: str, batch: str, label_col: str | None = None, cfg: RuleConfig = DEFAULT_RULE_CONFIG) -> bool:
    """Save the state of ``df`` under the name ``batch``; False, without a scan, if that batch is there already."""
    at = _batch_path(path, batch)
    if is_complete(df.sparkSession, at):
        return False
    partial_state(df, label_col, cfg).write.mode("overwrite").parquet(at)
    return True


def saved_batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches that were written to their end, in name order."""
    if not path_exists(spark, path):
        return []
    fs, p = _fs_path(spark, path)
    found = [s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(f for f in found if path_exists(spark, f"{f}/_SUCCESS"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The saved states of all complete batches, added up; without a batch it has no rows."""
    done = saved_batches(spark, path)
    if not done:
        return spark.createDataFrame([], STATE_SCHEMA)
    return merge_states(spark.read.schema(STATE_SCHEMA).parquet(*done))
