"""Data-quality checks.

Plan: V1 is a schema check (no job). V3-V8 counts come from ONE aggregate
pass (``count_if`` per check and column, partial aggregation on the map side),
then an ``inline`` of one struct per check into issue rows. V2 (duplicate ids) is one ``groupBy`` on the
id; its map-side partial count folds a hot id to one row per task. Violating
ids stay distributed in a long ``violations`` frame (V9); messages hold counts
only, the values behind them are frames too.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import as_double
from ..sources.files import UNPARSED
from ..schema import (
    CRITICAL_COLUMNS,
    DATETIME_COLUMNS,
    NON_NEGATIVE_COLUMNS,
    REQUIRED_COLUMNS,
    UNIT_INTERVAL_COLUMNS,
    VALID_STATUSES,
    WORKFLOW_ID,
)

log = logging.getLogger(__name__)
ERROR, WARNING = "error", "warning"

# fixed values: message texts of the checks
OVER_ONE_HINT = (
    " value(s) exceed 1 -- check whether the source uses a 0-100 percentage scale instead of the expected 0-1 fraction)"
)


def missing_required_columns(df: DataFrame) -> list[str]:
    """V1: required columns absent from the frame, in contract order."""
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def _ts(c: str, df: DataFrame) -> Column:
    """Timestamp view of a column: strings are parsed leniently (bad value → null)."""
    col = F.col(c)
    if dict(df.dtypes)[c] == "string":
        return col.try_cast("timestamp_ntz")
    return col


def _id_text() -> Column:
    return F.coalesce(F.col(WORKFLOW_ID).cast("string"), F.lit("nan"))


def _unknown_status() -> Column:
    return ~F.coalesce(F.col("status").isin(*VALID_STATUSES), F.lit(False))


@dataclass(frozen=True)
class Check:
    rank: int
    severity: str
    check: str
    column: str | None
    condition: Column  # row-level, never null


def row_checks(df: DataFrame) -> list[Check]:
    """V3-V8 as row conditions, in report order."""
    checks: list[Check] = []
    for i, c in enumerate(CRITICAL_COLUMNS):
        cond = (_ts(c, df) if c in DATETIME_COLUMNS else F.col(c)).isNull()
        if c not in DATETIME_COLUMNS and dict(df.dtypes)[c] in ("double", "float"):
            cond = cond | F.isnan(F.col(c))
            if UNPARSED in df.columns:
                # text that did not parse is not a missing value (it reaches the
                # numeric checks as "not a number", which no check flags)
                cond = cond & ~F.coalesce(F.map_contains_key(F.col(UNPARSED), F.lit(c)), F.lit(False))
        checks.append(Check(10 + i, ERROR, "null_critical_field", c, cond))
    for i, c in enumerate(NON_NEGATIVE_COLUMNS):
        checks.append(Check(20 + i, ERROR, "negative_value", c, F.coalesce(as_double(c) < 0, F.lit(False))))
    for i, c in enumerate(UNIT_INTERVAL_COLUMNS):
        x = as_double(c)
        checks.append(Check(30 + i, ERROR, "unit_interval_bounds", c, F.coalesce((x < 0) | (x > 1), F.lit(False))))
    checks.append(Check(40, ERROR, "impossible_sla", "sla_hours", F.coalesce(as_double("sla_hours") <= 0, F.lit(False))))
    checks.append(
        Check(50, ERROR, "inconsistent_timestamps", None,
              F.coalesce(_ts("updated_at", df) < _ts("created_at", df), F.lit(False)))
    )
    checks.append(Check(60, WARNING, "unknown_status", "status", _unknown_status()))
    return checks


STATUS_TEXT = "_status_text"


def check_flags(df: DataFrame) -> DataFrame:
    """One narrow row per input row: id text, status text and one boolean per check.

    Every report branch reads this same projection, so the source is scanned
    once per job (identical subtrees share their exchanges) and, when the
    caller persists it, exactly once."""
    cols = [_id_text().alias(WORKFLOW_ID), F.coalesce(F.col("status").cast("string"), F.lit("nan")).alias(STATUS_TEXT)]
    cols += [ch.condition.alias(f"f{ch.rank}") for ch in row_checks(df)]
    cols += [F.coalesce(as_double(c) > 1, F.lit(False)).alias(f"o{30 + i}") for i, c in enumerate(UNIT_INTERVAL_COLUMNS)]
    return df.select(*cols)


_CHECK_META = [(10 + i, ERROR, "null_critical_field", c) for i, c in enumerate(CRITICAL_COLUMNS)]
_CHECK_META += [(20 + i, ERROR, "negative_value", c) for i, c in enumerate(NON_NEGATIVE_COLUMNS)]
_CHECK_META += [(30 + i, ERROR, "unit_interval_bounds", c) for i, c in enumerate(UNIT_INTERVAL_COLUMNS)]
_CHECK_META += [(40, ERROR, "impossible_sla", "sla_hours"), (50, ERROR, "inconsistent_timestamps", None),
                (60, WARNING, "unknown_status", "status")]


def _flags(df: DataFrame) -> DataFrame:
    return df if STATUS_TEXT in df.columns else check_flags(df)


def violations(df: DataFrame) -> DataFrame:
    """V9: one row per (violating row, check): check_rank, check, column, workflow_id (null id → 'nan').

    Distributed and whole; duplicate ids (V2) are in :func:`duplicate_ids`."""
    f = _flags(df)
    items = [
        F.when(F.col(f"f{rank}"), F.struct(F.lit(rank).alias("check_rank"), F.lit(check).alias("check"),
                                            F.lit(col).cast("string").alias("column")))
        for rank, _sev, check, col in _CHECK_META
    ]
    return (
        f.select(WORKFLOW_ID, F.explode_outer(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("v"))
        .where(F.col("v").isNotNull())
        .select(F.col("v.check_rank").cast("bigint").alias("check_rank"), "v.check", "v.column", WORKFLOW_ID)
    )


def duplicate_ids(df: DataFrame) -> DataFrame:
    """V2: (workflow_id, n) for every id seen more than once; null ids group together as 'nan'."""
    return _flags(df).groupBy(WORKFLOW_ID).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def unknown_status_values(df: DataFrame) -> DataFrame:
    """V8 values: (value, n) of unrecognised statuses; null shows as 'nan'."""
    return (
        _flags(df).where(F.col("f60"))
        .groupBy(F.col(STATUS_TEXT).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def check_counts(df: DataFrame) -> DataFrame:
    """V3-V8 counts from one aggregate pass: (check_rank, severity, check, column, n, n_over)."""
    f = _flags(df)
    aggs = [F.count_if(F.col(f"f{rank}")).alias(f"c{rank}") for rank, *_ in _CHECK_META]
    aggs += [F.count_if(F.col(f"o{30 + i}")).alias(f"o{30 + i}") for i in range(len(UNIT_INTERVAL_COLUMNS))]
    one = f.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(rank).cast("bigint").alias("check_rank"),
                F.lit(sev).alias("severity"),
                F.lit(check).alias("check"),
                F.lit(col).cast("string").alias("column"),
                F.col(f"c{rank}").alias("n"),
                (F.col(f"o{rank}") if check == "unit_interval_bounds" else F.lit(0).cast("bigint")).alias("n_over"),
            )
            for rank, sev, check, col in _CHECK_META
        ]
    )
    return one.select(F.inline(rows))


def issue_values(df: DataFrame) -> DataFrame:
    """Every value behind the duplicate-id and unknown-status issues: (check, value, n), complete at any size."""
    flags = _flags(df)
    return (
        duplicate_ids(flags).select(F.lit("duplicate_workflow_id").alias("check"), F.col(WORKFLOW_ID).alias("value"), "n")
        .unionByName(unknown_status_values(flags).select(F.lit("unknown_status").alias("check"), "value", "n"))
    )


def _count_message(check: str) -> Column:
    n = F.col("n").cast("string")
    col = F.col("column")
    if check == "null_critical_field":
        return F.concat(F.lit("Column '"), col, F.lit("' has "), n, F.lit(" null value(s)"))
    if check == "negative_value":
        return F.concat(F.lit("Column '"), col, F.lit("' has "), n, F.lit(" negative value(s)"))
    if check == "unit_interval_bounds":
        hint = F.when(F.col("n_over") > 0, F.concat(F.lit(" ("), F.col("n_over").cast("string"), F.lit(OVER_ONE_HINT)))
        return F.concat(F.lit("Column '"), col, F.lit("' has "), n, F.lit(" value(s) outside [0, 1]"), F.coalesce(hint, F.lit("")))
    if check == "impossible_sla":
        return F.concat(F.lit("Column 'sla_hours' has "), n, F.lit(" value(s) <= 0"))
    if check == "inconsistent_timestamps":
        return F.concat(n, F.lit(" row(s) have updated_at before created_at"))
    if check == "unknown_status":
        return F.concat(F.lit("Unrecognized status value(s) in "), n, F.lit(" row(s)"))
    raise ValueError(check)


def issue_report(df: DataFrame, materialize: bool = False) -> DataFrame:
    """V10 as a frame: (check_rank, severity, check, column, n, message), only checks that found something.

    Missing required columns short-circuit to the single V1 issue. With
    ``materialize`` the narrow per-row flags are checkpointed first, so the
    source is scanned once however many branches read them."""
    missing = [] if STATUS_TEXT in df.columns else missing_required_columns(df)
    spark = df.sparkSession
    if missing:
        return spark.createDataFrame(
            [(0, ERROR, "required_columns", None, len(missing), f"Missing required columns: {missing}")],
            "check_rank bigint, severity string, check string, column string, n bigint, message string",
        )
    df = _flags(df)
    if materialize:
        # The report reads the flags in several branches; a checkpoint in the
        # shared folder makes that one scan of the source.
        from ..session import ensure_checkpoint_dir

        ensure_checkpoint_dir(spark)
        df = df.checkpoint(eager=True)
    dup = duplicate_ids(df).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).cast("bigint").alias("check_rank"), F.lit(ERROR).alias("severity"), F.lit("duplicate_workflow_id").alias("check"),
        F.lit(WORKFLOW_ID).alias("column"), "n",
        F.concat(F.lit("Duplicate workflow_id values found: "), F.col("n").cast("string"), F.lit(" id(s)")).alias("message"),
    )
    msg = F.lit(None).cast("string")
    for check in ("null_critical_field", "negative_value", "unit_interval_bounds", "impossible_sla", "inconsistent_timestamps", "unknown_status"):
        msg = F.when(F.col("check") == check, _count_message(check)).otherwise(msg)
    counted = check_counts(df).select("check_rank", "severity", "check", "column", "n", msg.alias("message"))
    return dup.unionByName(counted).where(F.col("n") > 0)


@dataclass
class ValidationIssue:
    severity: str
    check: str
    message: str
    column: str | None = None
    n: int = 0


@dataclass
class ValidationResult:
    """Driver-side summary (≤ 21 issues); violating ids stay in ``violations``."""

    issues: list[ValidationIssue] = field(default_factory=list)
    violations: DataFrame | None = None
    duplicates: DataFrame | None = None

    @property
    def errors(self) -> list[ValidationIssue]:
        return [i for i in self.issues if i.severity == ERROR]

    @property
    def warnings(self) -> list[ValidationIssue]:
        return [i for i in self.issues if i.severity == WARNING]

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def summary(self) -> str:
        if not self.issues:
            return "No validation issues found."
        return "\n".join(f"{i.severity.upper()} [{i.check}]: {i.message}" for i in self.issues)

    def workflow_ids(self, check: str, column: str | None = None) -> DataFrame:
        """Ids behind one issue (distributed): sorted distinct ids for duplicates, else one per violating row."""
        if check == "duplicate_workflow_id":
            return self.duplicates.select(WORKFLOW_ID)
        v = self.violations.where(F.col("check") == check)
        if column is not None:
            v = v.where(F.col("column") == column)
        return v.select(WORKFLOW_ID)


def validate_workflow_data(df: DataFrame) -> ValidationResult:
    """Run the checks, return the issue list (one small collect of ≤ 21 rows)."""
    missing = missing_required_columns(df)
    if missing:
        return ValidationResult([ValidationIssue(ERROR, "required_columns", f"Missing required columns: {missing}", None, len(missing))])
    flags = check_flags(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = issue_report(flags).orderBy("check_rank").collect()
    finally:
        flags.unpersist()
    issues = [ValidationIssue(r["severity"], r["check"], r["message"], r["column"], int(r["n"])) for r in rows]
    return ValidationResult(issues, violations(df), duplicate_ids(df))


def validate_or_raise(df: DataFrame) -> DataFrame:
    """Log warnings, raise ``ValueError`` with the summary on any error, else return ``df``."""
    result = validate_workflow_data(df)
    for w in result.warnings:
        log.warning("%s: %s", w.check, w.message)
    if not result.is_valid:
        raise ValueError(f"Workflow data failed validation:\n{result.summary()}")
    return df
