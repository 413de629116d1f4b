import random

from pyspark.sql import functions as F

from opsrisk.operators import selection


def test_kth_values_match_sorting(spark):
    rnd = random.Random(7)
    vals = [rnd.random() for _ in range(3000)] + [0.5] * 1500  # a hot value holding a third
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    ranks = [0, 1, 1499, 2250, 2999, 4499]
    got = selection.kth_values(df, {"x": F.col("x")}, {"x": ranks}, max_distinct=200, accuracy=1000)["x"]
    assert got == {k: s[k] for k in ranks}


def test_exact_median_even_and_odd(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 1), (10.0, 3), (None, 2), (float("nan"), 4)], "a double, b long")
    m = selection.exact_medians(df, ["a", "b"])
    assert m["a"] == 2.0  # 1, 2, 10 (null and NaN skipped)
    assert m["b"] == 3.0  # 1..5


def test_median_all_missing(spark):
    df = spark.createDataFrame([(None,)], "a double")
    assert selection.exact_medians(df, ["a"]) == {"a": None}


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=4, deadline=None)
@given(
    st.lists(st.one_of(st.integers(-50, 50).map(float), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=600),
    st.lists(st.floats(0, 1), min_size=1, max_size=4),
)
def test_kth_values_property(spark, vals, qs):
    """Any data (many ties or none), any ranks: equal to sorting, with tiny brackets forcing rounds."""
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    ranks = sorted({min(len(s) - 1, int(q * len(s))) for q in qs})
    got = selection.kth_values(df, {"x": F.col("x")}, {"x": ranks}, max_distinct=8, accuracy=50, materialize=False)["x"]
    assert got == {k: s[k] for k in ranks}


def test_kth_of_any_type_over_ranges(spark):
    vals = [f"w{i:04d}" for i in range(900)] + ["w0100"] * 450 + [None] * 3
    df = spark.createDataFrame([(v,) for v in vals], "x string").repartition(5)
    s = sorted(vals, key=lambda v: (v is not None, v or ""))
    for k in (1, 3, 4, 104, 300, 553, 554, 1353):
        assert selection.kth_of_any_type(df, "x", k) == s[k - 1]
