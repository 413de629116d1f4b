"""Null-safe numeric helpers and the five engineered ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def as_double(c: Column | str) -> Column:
    """Lenient numeric view of a column: garbage → null, NaN → null.

    Spark's ANSI cast raises on text and keeps NaN comparable (NaN >= 1 is
    true), so every numeric read in a comparison goes through here.
    """
    col = F.col(c) if isinstance(c, str) else c
    # nanvl references the value once, which keeps nested expressions small
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """numerator / denominator, 0.0 when either side is missing, d == 0 or the result is ±inf/NaN."""
    r = F.try_divide(as_double(numerator), as_double(denominator))
    # NaN compares above +inf in Spark, so `abs(r) < inf` rejects NaN, ±inf and null at once
    return F.coalesce(F.when(F.abs(r) < F.lit(_INF), r), F.lit(0.0))


def sla_utilization() -> Column:
    return safe_ratio("elapsed_hours", "sla_hours")


def manual_step_ratio() -> Column:
    # Both sides are coerced before the sum (pandas would add first).
    total = as_double("manual_steps") + as_double("automated_steps")
    return safe_ratio("manual_steps", total)


def error_rate() -> Column:
    return safe_ratio("error_count", "transaction_volume")


def rework_rate() -> Column:
    return safe_ratio("rework_count", "transaction_volume")


def backlog_pressure() -> Column:
    return safe_ratio("pending_items", "transaction_volume")


def engineered_columns() -> dict[str, Column]:
    """The five operational ratios, in contract order."""
    from .memo import cached_column

    builders = {
        "sla_utilization": sla_utilization,
        "manual_step_ratio": manual_step_ratio,
        "error_rate": error_rate,
        "rework_rate": rework_rate,
        "backlog_pressure": backlog_pressure,
    }
    return {name: cached_column(("ratio", name), fn) for name, fn in builders.items()}
