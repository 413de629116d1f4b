"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# White space of the contracts: the ASCII blanks only (bytes.split() splits on the same six).
BLANKS = r"[\x20\x09-\x0D]+"


_PACKAGE = "opsrisk_package.zip"
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once for each application).

    Also bounds the bytes of an Arrow batch: ten thousand long texts in one would not fit a worker.
    """
    sc = spark.sparkContext
    bytes_conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bytes_conf) == "67108864b":  # Spark's default; a user's own setting stays
        spark.conf.set(bytes_conf, f"{BATCH_BYTES}b")
    if any(f.endswith(_PACKAGE) for f in sc.listFiles):
        return
    root = Path(__file__).resolve().parents[2]
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='opsrisk-')}/{_PACKAGE.removesuffix('.zip')}", "zip", root, "opsrisk")
    sc.addPyFile(made)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the cluster's shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Array of the contract's words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Key of a document row: its id (a null id sorts before all others) and a hash of its text.

    Rows equal in both are repeated rows of one document.
    """
    return [
        F.coalesce(doc_id.cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()).alias("_h"),
    ]
