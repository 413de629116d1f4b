"""engineer_features (P7) and prepare_feature_frame (P8): one narrow projection each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.ratios import engineered_columns
from ..schema import ENGINEERED_COLUMNS, FEATURE_COLUMNS


def engineer_features(df: DataFrame) -> DataFrame:
    """Input columns unchanged plus the five ratios (replacing same-named columns)."""
    return df.withColumns(engineered_columns())


def has_features(df: DataFrame) -> bool:
    return all(c in df.columns for c in ENGINEERED_COLUMNS)


def ensure_features(df: DataFrame) -> DataFrame:
    """Engineer once: a frame that already carries the ratios passes through."""
    return df if has_features(df) else engineer_features(df)


def prepare_feature_frame(df: DataFrame) -> DataFrame:
    """The 19 model features in fixed order (16 numeric, then 3 categorical); leakage columns dropped."""
    return engineer_features(df).select(*FEATURE_COLUMNS)
