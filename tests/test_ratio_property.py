"""ratio = n / d, and 0.0 when either side is missing/NaN, d == 0, or the result is ±inf/NaN."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsrisk.functions.ratios import safe_ratio

_num = st.one_of(
    st.none(),
    st.sampled_from([0.0, -0.0, float("nan"), float("inf"), float("-inf"), 1e308, -1e-308]),
    st.floats(-1e6, 1e6, allow_nan=False),
)


def _expected(n, d):
    if n is None or d is None or math.isnan(n) or math.isnan(d) or d == 0:
        return 0.0
    r = n / d
    return 0.0 if math.isnan(r) or math.isinf(r) else r


def _py_div(n, d):
    try:
        return _expected(n, d)
    except OverflowError:
        return 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(_num, _num), min_size=20, max_size=150))
def test_safe_ratio_matches_rule(spark, pairs):
    df = spark.createDataFrame(pairs, "n double, d double")
    got = [r[0] for r in df.select(safe_ratio("n", "d")).collect()]
    want = [_py_div(n, d) for n, d in pairs]
    assert got == want
