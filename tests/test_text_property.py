"""Message number formatting equals Python's on many random values (one Spark job)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opsrisk.functions.text import int_text, percent_text

_values = st.lists(
    st.one_of(
        st.floats(min_value=-50, max_value=50, allow_nan=False, allow_infinity=False),
        st.integers(min_value=-5000, max_value=5000).map(lambda i: i / 1000.0),  # many exact .5 ties
        st.integers(min_value=0, max_value=400).map(lambda i: i / 800.0),
    ),
    min_size=50,
    max_size=200,
)


@settings(max_examples=5, deadline=None)
@given(_values)
def test_percent_matches_python(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(percent_text(F.col("x"))).collect()]
    assert got == [format(v, ".0%") for v in values]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=20, max_size=100))
def test_int_text_truncates_like_python(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(int_text(F.col("x"))).collect()]
    assert got == [str(int(v)) for v in values]
