"""Workflow tables derived from the driver's order tables.

The order tables have no workflow table, so one is derived: one workflow per
order that has lines, with lines summarised per order. Plan shape:

    lineitem ──(partial agg by l_orderkey)──┐
                                            ├─ join on order key (lineitem side already
    orders (pruned to 5 cols) ──────────────┘  hash-partitioned by the agg: one shuffle)
                                            └─ join customer on custkey (AQE: broadcast
                                               when the customer side is small, else SMJ
                                               with skew splitting)

A hot order key (a third of all lines on one order) is folded map-side by the
partial aggregate, so no task ever holds the hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import portable_uniform, risk_score, soft_label

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def signature(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("orders", "lineitem", "customer")) -> str:
    """Text that changes with the files of these tables (their paths, lengths and times; contents are not read)."""
    paths = [f"{sf_dir.rstrip('/')}/{n}.parquet" for n in names]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    one = files.agg(F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{one['n']}-{one['x'] & (2**64 - 1):016x}"


def _line_summary(lineitem: DataFrame) -> DataFrame:
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    return lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(rf == "R").alias("n_r"),
        F.count_if(rf != "N").alias("manual_steps"),
        F.count_if(rf == "N").alias("automated_steps"),
        F.sum("l_quantity").cast("bigint").alias("qty"),
        F.sum(F.when(ls == "O", F.col("l_quantity")).otherwise(F.lit(0.0))).cast("bigint").alias("open_qty"),
        F.count_if(ls == "F").cast("double").alias("n_f"),
        F.count_if(F.col("l_discount") <= F.lit(0.03)).cast("double").alias("n_lowdisc"),
        F.max("l_shipdate").alias("last_ship"),
    )


def workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived workflow table (18 contract columns, contract types)."""
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )
    # null keys never join; left in, they would all be shuffled to one task
    orders = orders.where("o_orderkey is not null and o_custkey is not null")
    li = li.where("l_orderkey is not null")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    lines = _line_summary(li)
    j = orders.join(lines, orders.o_orderkey == lines.l_orderkey).join(
        customer, orders.o_custkey == customer.c_custkey
    )
    k = F.col("o_orderkey")
    sla_mult = F.lit(1) + k % 7
    first = F.substring("o_orderpriority", 1, 1)
    return j.select(
        F.concat(F.lit("WF-"), k.cast("string")).alias("workflow_id"),
        F.when(k % 3 == 0, "Invoice Processing")
        .when(k % 3 == 1, "Vendor Approval")
        .otherwise("Order Fulfillment")
        .alias("workflow_name"),
        F.col("c_mktsegment").alias("department"),
        F.when(k % 20 == 0, "cancelled")
        .when(k % 10 == 1, "on_hold")
        .when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderstatus") == "P", "in_progress")
        .otherwise("completed")
        .alias("status"),
        F.when(first == "1", "urgent")
        .when(first == "2", "high")
        .when(first == "3", "medium")
        .otherwise("low")
        .alias("priority"),
        (F.lit(24) * sla_mult).cast("double").alias("sla_hours"),
        ((k * 37) % (F.lit(28) * sla_mult)).cast("double").alias("elapsed_hours"),
        F.col("manual_steps").cast("bigint").alias("manual_steps"),
        F.col("automated_steps").cast("bigint").alias("automated_steps"),
        (F.col("n_f") / F.col("n_lines")).alias("automation_score"),
        F.col("manual_steps").cast("bigint").alias("error_count"),
        (F.col("n_r") * 3).cast("bigint").alias("rework_count"),
        F.col("qty").alias("transaction_volume"),
        (F.lit(5.0) * F.col("qty") / F.col("n_lines")).alias("avg_handling_time_minutes"),
        F.col("open_qty").alias("pending_items"),
        (F.col("n_lowdisc") / F.col("n_lines")).alias("completion_rate"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
        F.greatest(F.col("o_orderdate"), F.col("last_ship")).cast("timestamp_ntz").alias("updated_at"),
    )


def workflow_key(df: DataFrame) -> F.Column:
    """Integer key of a derived workflow id ('WF-<n>')."""
    return F.substring(F.col("workflow_id"), 4, 40).try_cast("bigint")


# fixed value: recentring of the fixture's score (its volumes differ from the
# generator's)
FIXTURE_SCORE_OFFSET = -1.2


def fixture_score_terms() -> dict[str, F.Column]:
    """Signals of the fixture score, as plain ratios of the raw columns."""
    u = F.col("elapsed_hours") / F.col("sla_hours")
    m = F.col("manual_steps") * F.lit(1.0) / (F.col("manual_steps") + F.col("automated_steps"))
    v = F.col("transaction_volume")
    return {
        "sla_utilization": u,
        "manual_step_ratio": m,
        "error_rate": F.col("error_count") * F.lit(1.0) / v,
        "rework_rate": F.col("rework_count") * F.lit(1.0) / v,
        "backlog_pressure": F.col("pending_items") * F.lit(1.0) / v,
        "automation_score": F.col("automation_score"),
        "completion_rate": F.col("completion_rate"),
    }


def with_risk_score(df: DataFrame, offset: float = FIXTURE_SCORE_OFFSET) -> DataFrame:
    return df.withColumn("risk_score", risk_score(fixture_score_terms(), offset))


def workflows_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows plus a weak ``risk_label`` from the score and a portable draw."""
    base = with_risk_score(workflows(spark, sf_dir))
    draw = portable_uniform(workflow_key(base))
    return base.withColumn(
        "risk_label", soft_label(F.col("risk_score"), draw)
    ).drop("risk_score")


def workflows_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflows with deterministic defects for every validation check."""
    base = workflows(spark, sf_dir)
    k = workflow_key(base)
    c = F.col
    return base.select(
        F.when(k % 97 == 0, F.lit("WF-DUP")).when(k % 101 == 0, F.lit(None)).otherwise(c("workflow_id")).alias("workflow_id"),
        "workflow_name",
        "department",
        F.when(k % 71 == 0, F.lit("mystery_status")).when(k % 67 == 0, F.lit(None)).otherwise(c("status")).alias("status"),
        "priority",
        F.when(k % 89 == 0, F.lit(0.0)).when(k % 83 == 0, F.lit(-5.0)).otherwise(c("sla_hours")).alias("sla_hours"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(c("elapsed_hours")).alias("elapsed_hours"),
        "manual_steps",
        "automated_steps",
        F.when(k % 73 == 0, F.lit(-0.1)).otherwise(c("automation_score")).alias("automation_score"),
        F.when(k % 59 == 0, F.lit(-1).cast("bigint")).otherwise(c("error_count")).alias("error_count"),
        "rework_count",
        F.when(k % 47 == 0, F.lit(0).cast("bigint")).otherwise(c("transaction_volume")).alias("transaction_volume"),
        "avg_handling_time_minutes",
        "pending_items",
        F.when(k % 79 == 0, F.lit(90.0)).otherwise(c("completion_rate")).alias("completion_rate"),
        "created_at",
        F.when(k % 61 == 0, c("created_at") - F.expr("INTERVAL 1 DAY")).otherwise(c("updated_at")).alias("updated_at"),
    )


__all__ = [
    "TABLES",
    "read_table",
    "workflows",
    "workflows_labeled",
    "workflows_dirty",
    "workflow_key",
    "with_risk_score",
    "standin_predictions",
]


def standin_predictions(spark: SparkSession, sf_dir: str, flows: DataFrame | None = None) -> DataFrame:
    """Prediction-shaped frame without a model, for exact checks of the report views, of ``flows`` (default: derived anew).

    predicted_risk is the soft label; the probabilities are the soft label's
    class distribution (rounded to 9 places); risk_factors are the rule texts."""
    from ..functions.scoring import CLASS_CENTRES, TEMPERATURE
    from ..operators.features import engineer_features
    from ..operators.rules import risk_factors

    base = engineer_features(with_risk_score(workflows(spark, sf_dir) if flows is None else flows))
    s = F.col("risk_score")
    e = {k: F.exp(-F.abs(s - F.lit(c)) / F.lit(TEMPERATURE)) for k, c in CLASS_CENTRES.items()}
    total = e["low"] + e["medium"] + e["high"]
    return base.select(
        "workflow_id",
        soft_label(s, portable_uniform(workflow_key(base))).alias("predicted_risk"),
        *[F.round(e[k] / total, 9).alias(f"risk_probability_{k}") for k in ("low", "medium", "high")],
        F.array_join(risk_factors(), "; ").alias("risk_factors"),
    )
