"""Risk score and soft labelling of a workflow table (P10, P11), plus portable uniforms.

The score is a sigmoid of a weighted sum of operational signals; the soft
label turns it into one of the three classes by comparing a per-row uniform
draw with the cumulative softmax of distance-to-centre logits. The draw is an
input column, so the result is reproducible and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: score weights and centres (term → (weight, centre)); class
# centres and temperature of the soft labelling
SCORE_TERMS = {
    "sla_utilization": (2.2, 0.7),
    "manual_step_ratio": (1.8, 0.5),
    "error_rate": (7.5, 0.0),
    "rework_rate": (7.5, 0.0),
    "backlog_pressure": (2.4, 0.0),
    "automation_score": (-1.5, 0.5),
    "completion_rate": (-1.0, 0.5),
}
CLASS_CENTRES = {"low": 0.15, "medium": 0.50, "high": 0.85}
TEMPERATURE = 0.35


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def risk_score(terms: dict[str, Column], offset: Column | float = 0.0, noise: Column | None = None) -> Column:
    """sigmoid(Σ weight·(signal − centre) + offset + noise) over the given signal columns."""
    total = F.lit(offset) if not isinstance(offset, Column) else offset
    acc = None
    for name, (weight, centre) in SCORE_TERMS.items():
        sig = terms[name]
        term = F.lit(weight) * (sig - F.lit(centre)) if centre else F.lit(weight) * sig
        acc = term if acc is None else acc + term
    acc = acc + total
    if noise is not None:
        acc = acc + noise
    return sigmoid(acc)


def soft_label(score: Column, draw: Column) -> Column:
    """Sample low/medium/high from softmax(−|score − centre| / T) with the uniform ``draw``."""
    e = {k: F.exp(-F.abs(score - F.lit(c)) / F.lit(TEMPERATURE)) for k, c in CLASS_CENTRES.items()}
    total = e["low"] + e["medium"] + e["high"]
    return (
        F.when(draw < e["low"] / total, F.lit("low"))
        .when(draw < (e["low"] + e["medium"]) / total, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def portable_uniform(key: Column, multiplier: int = 7919, modulus: int = 1000) -> Column:
    """A pseudo-uniform in (0, 1) from an integer key that any SQL engine can recompute."""
    return (key * F.lit(multiplier) % F.lit(modulus)) / F.lit(float(modulus)) + F.lit(0.5 / modulus)


def hash_uniform(key: Column, seed: int) -> Column:
    """Uniform in [0, 1) from a 64-bit hash of (key, seed): stable across partitionings."""
    h = F.xxhash64(key, F.lit(seed))
    return (h.bitwiseAND(F.lit((1 << 53) - 1))).cast("double") / F.lit(float(1 << 53))
