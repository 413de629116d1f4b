"""Per-SparkContext memo for Column expressions that are costly to build.

A Column is an unresolved expression, reusable in any plan of the same
session; building the rule expressions takes ~1,000 py4j calls, so each
distinct (expression, config) is built once per SparkContext.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable

from pyspark import SparkContext
from pyspark.sql import Column

_CACHE: dict = {}


def cached_column(key: Hashable, build: Callable[[], Column]) -> Column:
    sc = SparkContext._active_spark_context
    if sc is None:
        return build()
    k = (id(sc), sc.applicationId, key)
    col = _CACHE.get(k)
    if col is None:
        col = _CACHE[k] = build()
    return col
