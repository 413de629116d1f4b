"""Session helpers: a tuned builder for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "opsrisk") -> SparkSession:
    """Session for tests, bench and jobs run by hand.

    On a cluster, pass master=None and let spark-submit decide; partition counts
    then come from the cluster conf (AQE coalesces small shuffles anyway).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The rule and score projections are wide; inferring constraints over
        # them is super-linear in expression size (seconds of optimizer time
        # per query) and adds no useful filter to these plans.
        .config("spark.sql.constraintPropagation.enabled", "false")
        .config("spark.driver.memory", os.environ.get("OPSRISK_DRIVER_MEMORY", "4g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if not master or not master.startswith("local"):
        builder = _cluster_profile(builder)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Cluster sizing (100 TB class inputs). Scans split at 256 MB; shuffles start
# wide (AQE coalesces small ones down to ~256 MB partitions), so a partition
# of the widest stage (the line summary by order key) fits an executor core's
# memory without spilling; skewed partitions (a hot key) are split by AQE.
CLUSTER_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.shuffle.partitions": "4096",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def _cluster_profile(builder):
    """Defaults for a cluster run; anything set by spark-submit wins (set only if absent)."""
    from pyspark import SparkConf

    present = dict(SparkConf().getAll())
    for k, v in CLUSTER_DEFAULTS.items():
        if k not in present:
            builder = builder.config(k, v)
    return builder


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, creating a local one only when unset.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that setting
    always wins. Only when nothing is set (tests, local runs) do we make one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="opsrisk-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/opsrisk-scratch/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder and read back, cutting its lineage.

    As Parquet, so that a later pass reads only the columns it needs; a frame with a column of no type is checkpointed."""
    spark = df.sparkSession
    if any(isinstance(f.dataType, NullType) for f in df.schema):
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
