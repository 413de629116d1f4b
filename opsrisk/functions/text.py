"""Message formatting as Column expressions.

Percent text follows Python's ``format(x, '.0%')``: x·100 rounded half-to-even,
``nan%`` for a missing value, ``inf%`` / ``-inf%`` for infinities. Integer text
follows ``int(x)``: truncation toward zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def percent_text(x: Column) -> Column:
    scaled = F.bround(x * F.lit(100.0), 0)
    # Exact (as Python) below 2^53 %; from 1e38 on, where no decimal holds the value,
    # the shortest-repr digits padded with zeros (Python prints the exact binary expansion).
    digits = F.when(F.abs(scaled) < F.lit(1e38), scaled.try_cast("decimal(38,0)").cast("string")).otherwise(
        F.format_string("%.0f", scaled)
    )
    # Python prints a negative value that rounds to zero, and -0.0 itself, as "-0%";
    # the text form carries the sign bit that a comparison with 0 loses.
    sign = F.when((scaled == 0) & F.startswith(x.cast("string"), F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit("nan%"))
        .when(x == F.lit(_INF), F.lit("inf%"))
        .when(x == F.lit(-_INF), F.lit("-inf%"))
        .otherwise(F.concat(sign, digits, F.lit("%")))
    )


def int_text(x: Column) -> Column:
    """``str(int(x))``: integer columns print exactly; doubles truncate toward zero.
    A double beyond the long range (NaN-free) prints its %.0f digits instead of null."""
    as_long = x.try_cast("bigint").cast("string")
    return F.coalesce(as_long, F.when(x.isNotNull(), F.format_string("%.0f", x.cast("double"))))


def python_percent(value: float) -> str:
    """Driver-side twin for threshold literals."""
    return format(value, ".0%")
