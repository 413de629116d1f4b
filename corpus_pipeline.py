"""Corpus pipeline: five operators of opsrisk.llm over the table documents.

Each stage's result is written as Parquet to the shared folder and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from opsrisk.llm import bpe, jaccard, mixing, quality, suffix  # noqa: E402
from opsrisk.llm.queries import public_ranks  # noqa: E402
from opsrisk.llm.shared import saved  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every near-duplicate class."""
    return jaccard.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that stand earlier; n_chars counts what is left."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    got = suffix.remove_repeats(docs, carry=others)
    new = {c: F.col(f"carried.c{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(*[new[c].alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    return bpe.encode_documents(docs, *public_ranks())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", byte_bpe),
]

# The estimates, recall-bound search, rounding and tokens of the stages are no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
